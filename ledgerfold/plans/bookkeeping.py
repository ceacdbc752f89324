"""Imports, deletions and postings on stored books, and reports from the sums kept of them.

Every operation is one change of a `Store`: facts, the account-level sums, the ledger of stored
files and the highest journal numbers move on together, or not at all. An operation reads the
periods that it touches, never the whole history.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.facts import journal_fact, long_fact
from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.journals import Posting, last_numbers, post_journals, update_journals
from ledgerfold.operators.mapping import map_to_groups
from ledgerfold.operators.scope import companies_under, in_period
from ledgerfold.schemas import TABLES
from ledgerfold.sources.files import Upload
from ledgerfold.sources.generations import NO_PERIOD, Change, Store, StoredBooks, with_codes
from ledgerfold.sources.store import (
    INTERCO,
    TRIAL_BALANCE,
    FileKind,
    append,
    cascade_delete,
    delete_by_key,
    judged,
)

#: Companies of a group that are handed to a scan as a list; larger groups are joined alone.
LISTED = 1_000


def row_digest(kind: FileKind) -> Column:
    """Digest of a file's rows in one period: the sum of their hashes, so in any order.

    The time of loading is no part of it.
    """
    names = [n for n in TABLES[kind.table].names if n not in (kind.created, kind.file_column)]
    return F.sum(F.xxhash64(*names).cast("decimal(38,0)")).cast("string")


def file_periods(rows: DataFrame, kind: FileKind) -> DataFrame:
    """For each file, the rows and digest of each of its periods, as the ledger keeps them."""
    return (
        rows.where(F.col(kind.file_column).isNotNull())
        .groupBy(F.col(kind.file_column).alias("file_name"), "period_code")
        .agg(F.count(F.lit(1)).alias("file_rows"), row_digest(kind).alias("digest"))
        .groupBy("file_name")
        .agg(F.sort_array(F.collect_list(F.struct("period_code", "file_rows", "digest"))).alias("periods"))
    )


def store_books(store: Store, books) -> int:
    """Put all facts into a new store, with their sums, ledger and journal marks."""
    change = store.begin(books.company)
    files = None
    for kind in (TRIAL_BALANCE, INTERCO):
        if getattr(books, kind.table) is None:
            continue
        change.replace(kind.table, getattr(books, kind.table), [])
        own = file_periods(change.table(kind.table), kind).withColumn(
            "table_name", F.lit(kind.table)
        )
        files = own if files is None else files.unionByName(own)
    if books.journal_header is not None:
        change.replace("journal_header", books.journal_header, [])
        change.replace("journal_line", books.journal_line, [])
        _advance(change, change.table("journal_header"))
    if files is not None:
        change.files(files)
    _refresh(change, books, None)
    return change.commit()


def _refresh(change: Change, master, periods: Sequence[str | None] | None) -> None:
    """Sum the facts of the touched periods anew, as they are after the change."""
    change.replace("account_fact", long_fact(change.books(master, periods)), periods or [])


def _advance(change: Change, headers: DataFrame) -> None:
    """Raise the highest journal number of the headers' parents."""
    marks = last_numbers(headers).where("last_number is not null")
    change.add("journal_marks", marks.withColumn("period_code", F.lit(NO_PERIOD)))


@dataclass(frozen=True)
class StoredLoad:
    """An import's outcome: the version it made (None where nothing changed), every file's
    verdict, and the periods that were written."""

    version: int | None
    files: DataFrame
    periods: tuple


def next_rows(change: Change, kind: FileKind, names: DataFrame, periods, new=None) -> DataFrame:
    """The touched periods without the rows of the named files, and with the new rows."""
    kept = delete_by_key(change.table(kind.table, periods), names)
    return kept if new is None else append(kept, new)


def import_files(
    store: Store, books, upload: Upload, kind: FileKind, loaded_at: datetime | None = None
) -> StoredLoad:
    """Load files: those accepted take the place of their earlier rows, in whichever periods.

    Where a file was stored before is looked up in the ledger, and only those periods and the
    new rows' are read and written. Verdicts, accepted rows and changed files are put aside
    in the store's `staged` folder one after the other, so that an upload is read, judged and digested once. Files that are stored with the same rows
    already are left as they are; if that is all of them, nothing is written.
    """
    spark, column = store.spark, kind.file_column
    change = store.begin(books.company)
    staged = f"{store.root}/staged/{uuid.uuid4().hex}"
    verdict = judged(upload, books, kind, loaded_at, f"{staged}-verdicts")
    verdict.accepted.write.parquet(staged)
    accepted = spark.read.schema(verdict.accepted.schema).parquet(staged)
    fresh = file_periods(accepted, kind)
    known = store.files(kind.table, change.version - 1).select(
        "file_name", F.col("periods").alias("_before")
    )
    changed = join_hot(fresh, known, ["file_name"], "left").where(
        F.col("_before").isNull() | (F.col("_before") != F.col("periods"))
    )
    # read four times below: the digests of all rows are taken once
    changed.write.parquet(f"{staged}-files")
    changed = spark.read.schema(changed.schema).parquet(f"{staged}-files")
    both = F.concat(F.col("periods"), F.coalesce("_before", F.array().cast(known.schema[1].dataType)))
    periods = tuple(
        row[0]
        for row in changed.select(F.explode(both["period_code"]).alias("p")).distinct().collect()
    )
    if not periods:
        return StoredLoad(None, verdict.files, ())
    names = changed.select(F.col("file_name").alias(column))
    new = join_hot(accepted, names, [column], "left_semi")
    change.replace(kind.table, next_rows(change, kind, names, periods, new), periods)
    change.files(changed.withColumn("table_name", F.lit(kind.table)))
    _refresh(change, books, periods)
    return StoredLoad(change.commit(), verdict.files, periods)


def delete_files(store: Store, books, kind: FileKind, *file_names: str) -> int | None:
    """Remove files by name, from whichever periods hold them; None where none is stored."""
    change = store.begin(books.company)
    found = store.files(kind.table, change.version - 1).where(
        F.col("file_name").isin(*file_names)
    )
    periods = [
        row[0] for row in found.select(F.explode("periods.period_code")).distinct().collect()
    ]
    if not periods:
        return None
    names = found.select(F.col("file_name").alias(kind.file_column))
    change.replace(kind.table, next_rows(change, kind, names, periods), periods)
    gone = found.select(
        F.lit(kind.table).alias("table_name"),
        "file_name",
        F.filter("periods", lambda _: F.lit(False)).alias("periods"),
    )
    change.files(gone)
    _refresh(change, books, periods)
    return change.commit()


def post_batch(
    store: Store, books, headers: DataFrame, lines: DataFrame, order_key: str, batch: str, **options
) -> Posting | None:
    """Post journals as `post_journals` does, once for each batch key; None if it was posted.

    The next numbers come from the highest kept for each parent, not from the headers stored.
    New journals are added to their periods, and their amounts to the account-level sums.
    """
    if store.holds(batch):
        return None
    change = store.begin(books.company)
    marks = change.table("journal_marks").groupBy("parent_company_code").agg(
        F.max("last_number").alias("last_number")
    )
    posting = post_journals(headers, lines, None, order_key, marks=marks, **options)
    change.add("journal_header", posting.headers)
    change.add("journal_line", posting.lines)
    own = {
        name: store.read(name, [f for f in change.folders(name) if f.change == change.id])
        for name in ("journal_header", "journal_line")
    }
    fact = journal_fact(own["journal_header"], own["journal_line"])
    keys = ["company_code", "period_code", "account_code", "source"]
    change.add("account_fact", fact.groupBy(*keys).agg(F.sum("amount").alias("amount")))
    _advance(change, own["journal_header"])
    change.commit(batch)
    return posting


def _journal_periods(change: Change, numbers: DataFrame) -> list:
    """The periods of some journals, by their headers."""
    named = numbers.select("journal_no").distinct()
    found = join_hot(change.table("journal_header"), named, ["journal_no"], "left_semi")
    return [row[0] for row in found.select("period_code").distinct().collect()]


def replace_lines(store: Store, books, batch: DataFrame) -> int | None:
    """Replace the lines of stored journals, those that balance; None where none is stored.

    Only the journals' periods are read and written. Columns that the batch lacks are left blank.
    """
    change = store.begin(books.company)
    lacking = [f for f in TABLES["journal_line"] if f.name not in (*batch.columns, "period_code")]
    batch = batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})
    periods = _journal_periods(change, batch)
    if not periods:
        return None
    lines, headers = (change.table(n, periods) for n in ("journal_line", "journal_header"))
    change.replace("journal_line", update_journals(lines, batch, headers), periods)
    _refresh(change, books, periods)
    return change.commit()


def delete_journals(store: Store, books, numbers: DataFrame) -> int | None:
    """Remove journals with their lines; their numbers are not given again."""
    change = store.begin(books.company)
    periods = _journal_periods(change, numbers)
    if not periods:
        return None
    headers, lines = cascade_delete(
        change.table("journal_header", periods),
        change.table("journal_line", periods),
        numbers.select("journal_no"),
    )
    change.replace("journal_header", headers, periods)
    change.replace("journal_line", lines, periods)
    _refresh(change, books, periods)
    return change.commit()


def kept_fact(books: StoredBooks, parent: str | None = None, period: str | None = None) -> DataFrame:
    """The account-level sums with their groups: pass it to a statement as ``fact=``.

    Equals `mapped_fact`, without reading a trial balance, journal or intercompany row.
    """
    books = of_tenant(books, parent)
    companies = companies_under(books.company, parent)
    rows = join_hot(
        in_period(books.account_fact, period), companies.select("company_code"), ["company_code"],
        "left_semi",
    )
    return map_to_groups(rows, companies, books.coa, books.fs_group)


def of_tenant(books, parent: str | None):
    """Books whose facts are cut to one group of companies by a list that reaches the scan.

    The codes are listed up to a bound; a larger group, or all groups, are left to the joins
    that follow in any case.
    """
    if parent is None:
        return books
    rows = companies_under(books.company, parent).select("company_code").distinct().limit(LISTED + 1)
    codes = sorted(row[0] for row in rows.collect() if row[0] is not None)
    return books if len(codes) > LISTED else with_codes(books, codes)

