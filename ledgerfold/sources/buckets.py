"""Journal headers and lines stored together: both bucketed by journal number.

Headers and lines that belong together are in buckets of the same number, sorted, so joining
them, and summing lines by journal, moves no row. The tables are registered in the session's
catalog under a prefix, which is where Spark keeps a table's buckets; another session registers
them again with `open_journals`.

A bucket is read by one task. Choose so many that a bucket of average size is small; where one
journal holds a large part of all lines, the tables stored by period are the ones to join, as
their shuffle can split it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.schemas import TABLES

JOURNAL_TABLES = ("journal_header", "journal_line")
KEY = "journal_no"


def _table(prefix: str, name: str) -> str:
    return f"{prefix}_{name}"


def write_journals(books, root: str, prefix: str, buckets: int) -> None:
    """Store a books' journals under a new folder; every bucket of a table is one file."""
    for name in JOURNAL_TABLES:
        df: DataFrame = getattr(books, name)
        columns = [c for c in TABLES[name].names if c in df.columns]
        (
            df.select(*columns)
            .repartition(buckets, KEY)
            .write.bucketBy(buckets, KEY)
            .sortBy(KEY)
            .option("path", f"{root}/{name}")
            .format("parquet")
            .saveAsTable(_table(prefix, name))
        )


def open_journals(spark: SparkSession, root: str, prefix: str, buckets: int) -> None:
    """Register tables that another session has stored."""
    for name in JOURNAL_TABLES:
        there = set(spark.read.parquet(f"{root}/{name}").columns)
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name] if f.name in there
        )
        spark.sql(
            f"create table if not exists `{_table(prefix, name)}` ({columns}) using parquet"
            f" clustered by ({KEY}) sorted by ({KEY}) into {buckets} buckets location '{root}/{name}'"
        )


def with_journals(books, spark: SparkSession, prefix: str):
    """The books, with the journals of the bucketed tables."""
    return replace(books, **{name: spark.table(_table(prefix, name)) for name in JOURNAL_TABLES})


def journal_sums(books) -> DataFrame:
    """Debit, credit and number of lines of each journal with its header, moving no row."""
    totals = books.journal_line.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("debit").alias("sum_debit"),
        F.sum("credit").alias("sum_credit"),
    )
    return books.journal_header.join(totals, KEY)
