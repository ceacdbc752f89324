"""The tables of a consolidation, as lazily evaluated DataFrames."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.schemas import TABLES
from ledgerfold.sources.files import write_facts

STORED_BY_PERIOD = ("trial_balance", "interco", "journal_header", "journal_line")


@dataclass(frozen=True)
class Books:
    """One DataFrame per table; a table that is not there stays None."""

    company: DataFrame | None = None
    period: DataFrame | None = None
    coa: DataFrame | None = None
    fs_group: DataFrame | None = None
    trial_balance: DataFrame | None = None
    interco: DataFrame | None = None
    journal_header: DataFrame | None = None
    journal_line: DataFrame | None = None
    plan: DataFrame | None = None
    subscription: DataFrame | None = None
    user: DataFrame | None = None
    group: DataFrame | None = None
    user_group: DataFrame | None = None
    content_type: DataFrame | None = None
    admin_log: DataFrame | None = None


def write_books(books, root: str, *names: str) -> None:
    """Store tables under a new folder, the facts by period, with their declared columns.

    Nothing is overwritten: a changed state goes to a folder of its own, and readers
    move over to it once it is complete.
    """
    for name in names or tuple(f.name for f in fields(Books)):
        table = getattr(books, name)
        if table is None:
            continue
        table = table.select(*(c for c in TABLES[name].names if c in table.columns))
        if name in STORED_BY_PERIOD:
            write_facts(table, f"{root}/{name}")
        else:
            table.write.mode("errorifexists").parquet(f"{root}/{name}")


def read_books(spark: SparkSession, root: str, *names: str) -> Books:
    """Open stored tables under ``root`` with their declared schemas (all, or those named)."""
    wanted = names or tuple(f.name for f in fields(Books))
    return Books(
        **{name: spark.read.schema(TABLES[name]).parquet(f"{root}/{name}") for name in wanted}
    )
