"""Stored tables that change as a whole: a log of changes over folders that are never rewritten.

A store is a folder:

    <table>/change=<id>/period_code=<period>/   rows written by one change
    files/change=<id>/                          what the change did to stored files
    log/                                        one small file for each finished change

A change writes its rows into folders of its own, and is made by one file that is added to the
log: from then on it says which folders hold a period. Until that file is there, readers see the
state before, all of it; a change that failed on its way leaves folders that nobody reads. A
change either replaces a period, to nothing if it has no rows left, or adds rows to it. Several
tables change together, so facts and the sums kept of them never disagree.

Earlier versions stay readable until their folders are removed (``superseded`` lists them).
Writers work one at a time; of two that were at work at once, the later to finish fails with
`ChangeConflict`, and nothing of it is seen.

Within a period, rows are dealt to files by group of companies, and are in order of group and
company within each, so that a report of one group reads the few files and pages that hold it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.operators.journals import NUMBER_MARK
from ledgerfold.schemas import ACCOUNT_FACT, JOURNAL_MARKS, TABLES
from ledgerfold.sources.books import STORED_BY_PERIOD, Books

#: Tables of a store: the facts, the sums kept of them, and the highest journal numbers.
STORED = {
    **{name: TABLES[name] for name in STORED_BY_PERIOD},
    "account_fact": ACCOUNT_FACT,
    "journal_marks": JOURNAL_MARKS,
}
#: The period of tables that have none.
NO_PERIOD = "-"

LOG = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("change", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("period_code", T.StringType()),
        T.StructField("adds", T.BooleanType()),
        T.StructField("has_rows", T.BooleanType()),
        T.StructField("batch", T.StringType()),
    ]
)
PERIOD_OF_FILE = T.StructType(
    [
        T.StructField("period_code", T.StringType()),
        T.StructField("file_rows", T.LongType()),
        T.StructField("digest", T.StringType()),
    ]
)
FILES = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("periods", T.ArrayType(PERIOD_OF_FILE)),
    ]
)
#: Bytes of a row group, small enough that one group of companies fills few.
ROW_GROUP = 16 << 20

#: Parts, at least, to which a written table is dealt; Spark joins small ones.
DEALT = 200


class ChangeConflict(RuntimeError):
    """Another change was made since this one began."""


def _among(column: Column, values: Iterable[str | None]) -> Column:
    given = [v for v in values if v is not None]
    found = column.isin(given)
    return found | column.isNull() if None in values else found


@dataclass(frozen=True)
class Folder:
    """One period's rows of one change."""

    change: str
    period_code: str | None


class Store:
    """Tables under one folder, as of their latest version or an earlier one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        """A new store without rows. The folder must not hold one yet."""
        first = [(0, "", None, None, None, False, None)]
        spark.createDataFrame([], FILES).write.parquet(f"{root}/files/change=none")
        spark.createDataFrame(first, LOG).coalesce(1).write.parquet(f"{root}/log")
        return cls(spark, root)

    def log(self, version: int | None = None) -> DataFrame:
        """The changes made; of two of one version, the earlier counts."""
        rows = (
            self.spark.read.schema(LOG)
            .parquet(f"{self.root}/log")
            .select("*", F.col("_metadata.file_modification_time").alias("_at"))
        )
        first = F.min(F.struct("_at", "change")).over(Window.partitionBy("version"))
        made = rows.withColumn("_made", first["change"]).where(F.col("change") == F.col("_made"))
        made = made.drop("_at", "_made")
        return made if version is None else made.where(F.col("version") <= version)

    def version(self) -> int:
        return self.log().agg(F.max("version")).first()[0]

    def holds(self, batch: str) -> bool:
        """Whether a change of that batch key was made."""
        return not self.log().where(F.col("batch") == batch).isEmpty()

    def all_folders(self, version: int | None = None) -> dict[str, list[Folder]]:
        """The folders that hold each table: one for a period, more where rows were added."""
        rows = self.log(version).where("table_name is not null")
        replaced = F.max(F.when(~F.col("adds"), F.col("version"))).over(
            Window.partitionBy("table_name", "period_code")
        )
        valid = rows.withColumn("_replaced", F.coalesce(replaced, F.lit(0))).where(
            "has_rows and version >= _replaced"
        )
        found = defaultdict(list)
        for table, change, period in valid.select("table_name", "change", "period_code").collect():
            found[table].append(Folder(change, period))
        return found

    def folders(self, table: str, version: int | None = None) -> list[Folder]:
        return self.all_folders(version)[table]

    def superseded(self, version: int | None = None) -> DataFrame:
        """Folders that no reader of the version, or a later one, needs."""
        used = [
            (table, f.change, f.period_code)
            for table, folders in self.all_folders(version).items()
            for f in folders
        ]
        names = "table_name string, change string, period_code string"
        there = self.log(version).where("has_rows").select("table_name", "change", "period_code")
        return there.exceptAll(self.spark.createDataFrame(used, names))

    def read(self, table: str, folders: Sequence[Folder]) -> DataFrame:
        """The rows of folders. Both the change and the period are partition filters."""
        schema = STORED[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        periods = defaultdict(list)
        for folder in folders:
            periods[folder.change].append(folder.period_code)
        base = f"{self.root}/{table}"
        rows = (
            self.spark.read.schema(T.StructType([*schema.fields, T.StructField("change", T.StringType())]))
            .option("basePath", base)
            .parquet(*(f"{base}/change={change}" for change in sorted(periods)))
        )
        own = [
            (F.col("change") == change) & _among(F.col("period_code"), periods[change])
            for change in sorted(periods)
        ]
        return rows.where(reduce(or_, own)).select(*schema.names)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.read(name, self.folders(name, version))

    def files(self, table: str, version: int | None = None) -> DataFrame:
        """The stored files of a table: file_name, the rows and digest by period, and the version
        that stored them."""
        made = self.log(version).select("version", "change").distinct()
        latest = (
            self.spark.read.schema(
                T.StructType([*FILES.fields, T.StructField("change", T.StringType())])
            )
            .parquet(f"{self.root}/files")
            .where(F.col("table_name") == table)
            .join(made, "change")
            .groupBy("file_name")
            .agg(F.max(F.struct("version", "periods")).alias("_last"))
            .select("file_name", "_last.periods", "_last.version")
        )
        return latest.where(F.size("periods") > 0)

    def books(self, master, version: int | None = None) -> StoredBooks:
        """The master tables given, with the stored facts."""
        found = self.all_folders(version)
        return _books(master, lambda name: self.read(name, found[name]))

    def begin(self, company: DataFrame | None = None) -> Change:
        return Change(self, company)


@dataclass(frozen=True)
class StoredBooks(Books):
    """Books whose facts come from a store, and the sums kept of them by account."""

    account_fact: DataFrame | None = None
    by_tenant: bool = True


def _books(master, table) -> StoredBooks:
    names = ("company", "period", "coa", "fs_group")
    return StoredBooks(
        **{name: getattr(master, name) for name in names},
        **{name: table(name) for name in (*STORED_BY_PERIOD, "account_fact")},
    )


class Change:
    """Rows to be written, of any tables, that count once ``commit`` has returned."""

    def __init__(self, store: Store, company: DataFrame | None):
        self.store, self.company = store, company
        self.version = store.version() + 1
        self.id = uuid.uuid4().hex
        self._rows: list[tuple] = []
        self._folders = store.all_folders(self.version - 1)

    def folders(self, table: str) -> list[Folder]:
        """As of after this change."""
        return self._folders[table]

    def table(self, name: str, periods: Sequence[str | None] | None = None) -> DataFrame:
        """A table as of after this change, or some of its periods."""
        folders = self.folders(name)
        if periods is not None:
            folders = [f for f in folders if f.period_code in periods]
        return self.store.read(name, folders)

    def books(self, master, periods: Sequence[str | None] | None = None) -> StoredBooks:
        return _books(master, lambda name: self.table(name, periods))

    def _written(self, name: str, df: DataFrame) -> list[str | None]:
        """Write rows in the layout of the store; the periods that have some."""
        schema = STORED[name]
        path = f"{self.store.root}/{name}/change={self.id}"
        rows = df.select(
            *(
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            )
        )
        dealt, order = ["period_code"], ["period_code"]
        if "journal_no" in schema.names:  # numbers begin with the parent's code
            rows = rows.withColumn("_parent", F.substring_index("journal_no", NUMBER_MARK, 1))
            dealt, order = [*dealt, "_parent"], [*order, "journal_no"]
        elif self.company is not None and "company_code" in schema.names:
            parents = self.company.select("company_code", F.col("parent_company").alias("_parent"))
            rows = rows.join(parents, "company_code", "left")
            dealt, order = [*dealt, "_parent"], [*order, "_parent", "company_code"]
        # The rows are made once, as no bounds of ranges are sampled; a group of companies with
        # much of a period is split over many files as the query runs, small ones share a file.
        parts = max(DEALT, int(self.store.spark.conf.get("spark.sql.shuffle.partitions")))
        (
            rows.hint("rebalance", parts, *dealt)
            .sortWithinPartitions(*order)
            .select(*schema.names)
            .write.partitionBy("period_code")
            .option("parquet.block.size", ROW_GROUP)
            .parquet(path)
        )
        there = (
            self.store.spark.read.schema(schema).parquet(path).select("period_code").distinct()
        )
        return [row[0] for row in there.collect()]

    def replace(self, table: str, df: DataFrame, periods: Iterable[str | None]) -> None:
        """The rows take the place of all rows of the periods, also where they are none."""
        found = self._written(table, df)
        touched = list(dict.fromkeys([*periods, *found]))
        kept = [f for f in self.folders(table) if f.period_code not in touched]
        self._folders[table] = [*kept, *(Folder(self.id, p) for p in found)]
        self._rows += [(self.version, self.id, table, p, False, p in found) for p in touched]

    def add(self, table: str, df: DataFrame) -> list[str | None]:
        """Further rows of a table; the periods that got some."""
        found = self._written(table, df)
        self._folders[table] = [*self.folders(table), *(Folder(self.id, p) for p in found)]
        self._rows += [(self.version, self.id, table, p, True, True) for p in found]
        return found

    def files(self, df: DataFrame) -> None:
        """Note what files are stored as of now; a file without periods is gone."""
        df.select(*FILES.names).write.parquet(f"{self.store.root}/files/change={self.id}")

    def commit(self, batch: str | None = None) -> int:
        """Make the change, and return its version."""
        rows = self._rows or [(self.version, self.id, None, None, None, False)]
        if batch is not None and self.store.holds(batch):
            raise ChangeConflict(f"batch {batch!r} was posted meanwhile")
        log = self.store.spark.createDataFrame([(*row, batch) for row in rows], LOG)
        log.coalesce(1).write.mode("append").parquet(f"{self.store.root}/log")
        made = self.store.log().where(F.col("version") == self.version).select("change").first()
        if made is None or made[0] != self.id:
            raise ChangeConflict(f"version {self.version} was made by another writer")
        return self.version


def compact(store: Store, table: str, company: DataFrame | None = None) -> int | None:
    """Bring periods to which rows were added into one folder each; no row changes."""
    by_period = defaultdict(int)
    for folder in store.folders(table):
        by_period[folder.period_code] += 1
    many = [period for period, n in by_period.items() if n > 1]
    if not many:
        return None
    change = store.begin(company)
    rows = change.table(table, many)
    if table == "account_fact":
        keys = [n for n in ACCOUNT_FACT.names if n != "amount"]
        rows = rows.groupBy(*keys).agg(F.sum("amount").alias("amount"))
    change.replace(table, rows, many)
    return change.commit()


def with_codes(books, codes: Sequence[str]):
    """Books whose facts are cut to companies by a list, which reaches the Parquet reader.

    The list goes in runs of ten, each of which the reader compares with a row group's bounds
    code by code; longer ones it takes as one range.
    """
    runs = [list(codes[k : k + 10]) for k in range(0, len(codes), 10)] or [[]]
    wanted = reduce(or_, (F.col("company_code").isin(run) for run in runs))
    names = ("trial_balance", "interco", "journal_header", "account_fact")
    cut = {n: getattr(books, n) for n in names if getattr(books, n, None) is not None}
    return replace(books, **{n: df.where(wanted) for n, df in cut.items()})
