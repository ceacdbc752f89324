"""The long fact: every source in one shape, summed to account level before any mapping.

A row is (company, period, account, source, amount). One amount per row keeps the first
and largest aggregation down to a single decimal sum; reports pick sources afterwards.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import zero_if_null
from ledgerfold.functions.amounts import journal_amount, zero
from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.scope import companies_under, in_period
from ledgerfold.schemas import RECLASSIFY, TAKE_EQUITY

SOURCES = ("tb", "rpt", "recl", "te")
SEPARATE = ("tb", "recl")
FACT_KEYS = ("company_code", "period_code", "account_code")


def journal_source(journal_type="journal_type") -> Column:
    """Reclassification, equity pick-up, or neither."""
    kind = F.col(journal_type)
    return F.when(kind == RECLASSIFY, "recl").when(kind == TAKE_EQUITY, "te").otherwise("none")


def trial_balance_fact(tb: DataFrame) -> DataFrame:
    return tb.select(
        *FACT_KEYS, F.lit("tb").alias("source"), zero_if_null("tb_amount").alias("amount")
    )


def interco_fact(interco: DataFrame, *more: str) -> DataFrame:
    return interco.select(
        *FACT_KEYS, *more, F.lit("rpt").alias("source"), zero_if_null("rpt_amount").alias("amount")
    )


def journal_fact(header: DataFrame, line: DataFrame) -> DataFrame:
    """Journal lines with the company, period and type of their header.

    The amount is always derived from debit and credit, as it is when a line is saved.
    """
    headers = header.select(
        "journal_no", "company_code", "period_code", journal_source().alias("source")
    )
    lines = line.select("journal_no", "account_code", journal_amount().alias("amount"))
    return headers.join(lines, "journal_no").select(*FACT_KEYS, "source", "amount")


def stack(*facts: DataFrame) -> DataFrame:
    """Facts on top of each other by column name, columns a source lacks left null."""
    stacked, *others = facts
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked


def measure(*sources: str, when: Column | None = None) -> Column:
    """Sum of the amounts of the given sources, zero where there are none."""
    counted = F.col("source").isin(*sources)
    if when is not None:
        counted = counted & when
    return F.sum(F.when(counted, F.col("amount")).otherwise(zero()))


def sum_sources(df: DataFrame, *keys) -> DataFrame:
    """One row per key with the four sources as columns."""
    return df.groupBy(*keys).agg(*(measure(name).alias(name) for name in SOURCES))


def split_journals(header: DataFrame, line: DataFrame, *keys) -> DataFrame:
    """Journal amounts per key as reclassification and as equity pick-up."""
    return journal_fact(header, line).groupBy(*keys).agg(
        measure("recl").alias("reclass_amount"), measure("te").alias("take_eq_amount")
    )


def long_fact(books, parent: str | None = None, period: str | None = None) -> DataFrame:
    """One row per company, period, account and source.

    Each source is cut to the scope before anything else happens to it, journal lines
    through their headers. A source that is not there counts as zero.
    """
    companies = companies_under(books.company, parent).select("company_code")

    def scoped(df: DataFrame) -> DataFrame:
        return join_hot(in_period(df, period), companies, ["company_code"], "left_semi")

    facts = []
    if books.trial_balance is not None:
        facts.append(trial_balance_fact(scoped(books.trial_balance)))
    if books.journal_header is not None and books.journal_line is not None:
        lines = books.journal_line
        if "period_code" in lines.columns:  # stored by period, so that this prunes
            lines = in_period(lines, period)
        facts.append(journal_fact(scoped(books.journal_header), lines))
    if books.interco is not None:
        facts.append(interco_fact(scoped(books.interco)))
    if not facts:
        raise ValueError("no trial balance, journal or intercompany table to consolidate")
    return stack(*facts).groupBy(*FACT_KEYS, "source").agg(F.sum("amount").alias("amount"))


def consolidate(df: DataFrame, *keys) -> DataFrame:
    """The four sources per key, with the separate and consolidated totals."""
    return df.groupBy(*keys).agg(
        *(measure(name).alias(name) for name in SOURCES),
        measure(*SEPARATE).alias("total_separate"),
        measure(*SOURCES).alias("total_conso"),
    )
