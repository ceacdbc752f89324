"""Changes to stored tables, each a new DataFrame of the table's next state."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import clean_file_name
from ledgerfold.operators.joins import join_hot
from ledgerfold.sources.files import Upload, write_periods
from ledgerfold.sources.gates import file_verdicts


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch, allowMissingColumns=True)


def delete_by_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the rows whose key columns are listed; the columns of ``keys`` are the key."""
    return join_hot(df, keys.distinct(), keys.columns, "left_anti")


def delete_file(df: DataFrame, file_column: str, *file_names: str) -> DataFrame:
    """Drop the rows of the named files; rows that came from no file stay."""
    return df.where(~F.coalesce(F.col(file_column).isin(*file_names), F.lit(False)))


def cascade_delete(
    parent: DataFrame, child: DataFrame, keys: DataFrame, foreign_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Delete parents by key, and the children that point at them."""
    (key,) = keys.columns
    children = keys.withColumnRenamed(key, foreign_key or key)
    return delete_by_key(parent, keys), delete_by_key(child, children)


def replace_by_file(target: DataFrame, batch: DataFrame, file_column: str) -> DataFrame:
    """A file loaded again takes the place of its earlier rows."""
    return append(delete_by_key(target, batch.select(file_column)), batch)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the batch rows whose key is not stored yet; blanks in a key equal blanks.

    Repeats within the batch count once. With further columns beside the key, the
    smallest combination of them is kept, so the result does not hang on row order.
    """
    rest = [c for c in batch.columns if c not in keys]
    if rest:
        once = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(
            *keys, "_rest.*"
        )
    else:
        once = batch.distinct()
    stored = target.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [once[k].eqNullSafe(stored[f"_{k}"]) for k in keys]
    return append(target, once.join(stored, same, "left_anti"))


@dataclass(frozen=True)
class Load:
    """Outcome of an import: the table's next state, its new rows, and every file's verdict."""

    table: DataFrame
    accepted: DataFrame
    files: DataFrame
    replaced: DataFrame


@dataclass(frozen=True)
class Judged:
    """An upload after the gates: rows to load, every file's verdict, the accepted file names."""

    accepted: DataFrame
    files: DataFrame
    names: DataFrame


@dataclass(frozen=True)
class FileKind:
    """How the files of a fact are named and judged."""

    table: str
    file_column: str
    amount: str
    created: str
    must_be_zero: bool


TRIAL_BALANCE = FileKind("trial_balance", "tb_file_name", "tb_amount", "tb_date_create", True)
INTERCO = FileKind("interco", "rpt_file_name", "rpt_amount", "rpt_date_create", False)


def judged(
    upload: Upload, books, kind: FileKind, loaded_at: datetime | None = None, aside: str | None = None
) -> Judged:
    """Judge every file of an upload by itself: header, readable cells, open period, zero sum.

    With ``aside`` the verdicts are written to that new folder, so that they are reached once,
    and few of them meet the rows without a shuffle of these.
    """
    rows = upload.rows
    verdicts = file_verdicts(
        rows, books.period, books.company, kind.file_column, kind.amount, kind.must_be_zero,
        upload.files,
    )
    if aside is not None:
        verdicts.write.parquet(aside)
        verdicts = rows.sparkSession.read.schema(verdicts.schema).parquet(aside)
    key = "file_path" if "file_path" in rows.columns else "file_name"
    passed = verdicts.where(F.col("reason").isNull())
    now = F.current_timestamp() if loaded_at is None else F.lit(loaded_at)
    accepted = (
        join_hot(rows, passed.select(key), [key], "left_semi")
        .withColumn(kind.file_column, clean_file_name("file_name"))
        .drop("file_name", "file_path", "unreadable")
    )
    if kind.created not in accepted.columns:
        accepted = accepted.withColumn(kind.created, now.cast("timestamp_ntz"))
    files = verdicts.select(kind.file_column, "file_rows", "file_total", "reason")
    if upload.rejected is not None:
        malformed = upload.rejected.select(
            clean_file_name("file_name").alias(kind.file_column), "reason"
        )
        files = files.unionByName(malformed, allowMissingColumns=True)
    return Judged(accepted, files, passed.select(kind.file_column))


def _load(target, upload, books, kind: FileKind, loaded_at: datetime | None) -> Load:
    new = judged(upload, books, kind, loaded_at)
    replaced = join_hot(target, new.names, [kind.file_column], "left_semi")
    table = append(delete_by_key(target, new.names), new.accepted)
    return Load(table, new.accepted, new.files, replaced)


def import_tb(books, upload: Upload, loaded_at: datetime | None = None) -> Load:
    """Load trial-balance files: header, readable cells, open period and zero sum are checked
    per file, and only then do the accepted files replace their earlier rows. Rows are stamped
    with ``loaded_at``, or else with the current time."""
    return _load(books.trial_balance, upload, books, TRIAL_BALANCE, loaded_at)


def import_interco(books, upload: Upload, loaded_at: datetime | None = None) -> Load:
    """Load intercompany files: as trial balances, but they need not sum to zero."""
    return _load(books.interco, upload, books, INTERCO, loaded_at)


def store_load(load: Load, path: str) -> None:
    """Write the next state of the touched periods only, in a fact stored by period.

    Touched are the periods of new rows and of the rows they replace. Storing the same import
    again gives the same state. This is for a folder that plain Parquet readers share, where a
    period that loses all its rows, as its only file moves to another, cannot be emptied: such
    an import is turned down. A `generations.Store` takes it, and makes the change at once.
    """
    touched = (
        load.accepted.select("period_code").union(load.replaced.select("period_code")).distinct()
    )
    rows = join_hot(load.table, touched, ["period_code"], "left_semi")
    emptied = join_hot(touched, rows.select("period_code").distinct(), ["period_code"], "left_anti")
    gone = [row[0] for row in emptied.limit(3).collect()]
    if gone:
        raise ValueError(f"files moved and left periods without rows, as {gone}: use a Store")
    write_periods(rows, path)
