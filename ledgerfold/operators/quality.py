"""Data-quality rules: each returns the rows, or keys, that break it."""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import zero_if_null
from ledgerfold.operators.joins import join_hot
from ledgerfold.schemas import MAX_LENGTHS


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count; keys with a null are exempt."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
    )


def check_one_open(period: DataFrame) -> DataFrame:
    """Companies with more than one open period."""
    return (
        period.where((F.col("period_status") == "Open") & F.col("company_code").isNotNull())
        .groupBy("company_code")
        .agg(F.count(F.lit(1)).alias("open_periods"))
        .where("open_periods > 1")
    )


def check_orphans(
    child: DataFrame, parent: DataFrame, keys: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Child rows pointing at no parent row; a null pointer points nowhere and is no orphan."""
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    known = parent.select(*(F.col(p).alias(c) for c, p in pairs.items())).distinct()
    pointing = child.dropna(subset=list(pairs))
    return join_hot(pointing, known, list(pairs), "left_anti").select(*child.columns)


def check_domain(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the allowed ones."""
    return df.where(~F.col(column).isin(*values))


def check_range(
    df: DataFrame, columns: Sequence[str] = ("debit", "credit"), low=0, digits: int = 13
) -> DataFrame:
    """Rows with an amount below the bound or too long for the money type."""
    broken = [(F.col(c) < low) | (F.abs(c) >= 10**digits) for c in columns]
    return df.where(reduce(or_, broken))


def check_required(
    df: DataFrame, required: Sequence[str] = (), max_lengths: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows with a required value missing or a text too long, and which columns those are.

    Lengths default to those of the data model, for the columns the table has.
    """
    limits = MAX_LENGTHS if max_lengths is None else max_lengths
    faults = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    faults += [
        F.when(F.length(c) > size, F.lit(c)) for c, size in limits.items() if c in df.columns
    ]
    return df.withColumn("faults", F.concat_ws(",", *faults)).where(F.col("faults") != "")


def journal_totals(line: DataFrame, key: str = "journal_no") -> DataFrame:
    """Debit and credit of each journal."""
    return line.groupBy(key).agg(
        F.sum(zero_if_null("debit")).alias("sum_debit"),
        F.sum(zero_if_null("credit")).alias("sum_credit"),
    )


def filled_lines(line: DataFrame) -> DataFrame:
    """Lines on which something was entered."""
    return line.dropna(how="all", subset=["account_code", "debit", "credit"])


def check_balanced(line: DataFrame, key: str = "journal_no") -> DataFrame:
    """Journals whose debit and credit differ by a cent or more; blank lines do not count."""
    return (
        journal_totals(filled_lines(line), key)
        .withColumn("difference", F.round(F.col("sum_debit") - F.col("sum_credit"), 2))
        .where("difference <> 0")
    )


def check_journal_scope(
    header: DataFrame, line: DataFrame, period: DataFrame, company: DataFrame, coa: DataFrame
) -> DataFrame:
    """Journals outside their parent's books: one row per journal, rule and offending value.

    The period must be open for the parent, the company must belong to the parent, and
    every account must be in the parent's own chart. Lines shrink to one row per journal
    and account before they meet the headers.
    """
    opened = period.where(F.col("period_status") == "Open").select(
        F.col("company_code").alias("parent_company_code"), "period_code"
    )
    members = company.select(
        F.col("parent_company").alias("parent_company_code"), "company_code"
    )
    charted = coa.select(F.col("company_code").alias("parent_company_code"), "account_code")
    used = (
        line.select("journal_no", "account_code")
        .distinct()
        .join(header.select("journal_no", "parent_company_code"), "journal_no")
    )

    def outside(df: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
        keys = ["parent_company_code", column]
        return join_hot(df, allowed.distinct(), keys, "left_anti").select(
            "journal_no", F.lit(column).alias("rule"), F.col(column).alias("value")
        )

    return (
        outside(header, opened, "period_code")
        .unionByName(outside(header, members, "company_code"))
        .unionByName(outside(used, charted, "account_code"))
    )
