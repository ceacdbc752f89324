"""Intercompany matrix, working papers and financial statements.

Each report takes a parent and a period. Without a parent it covers every group of
companies, without a period every period; the code left open becomes a leading column.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.facts import (
    FACT_KEYS,
    SEPARATE,
    SOURCES,
    consolidate,
    interco_fact,
    long_fact,
    measure,
)
from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.mapping import STATEMENT_KEYS, WORKING_KEYS, map_to_groups
from ledgerfold.operators.scope import companies_under, in_period, statement_filter
from ledgerfold.operators.shaping import (
    column_codes,
    measure_sign,
    rollup_with_total,
    wide_with_total,
)


def _open_codes(parent, period) -> list[str]:
    return [
        name
        for name, value in (("parent_company", parent), ("period_code", period))
        if value is None
    ]


def _finish(df: DataFrame, partition: list[str], keys, row_key: str) -> DataFrame:
    """Row order of one report, its total last; many reports at once stay unsorted."""
    ordered = df if partition else df.orderBy("is_total", row_key, *keys)
    return ordered.drop("is_total")


def mapped_fact(books, parent: str | None = None, period: str | None = None) -> DataFrame:
    """Account-level fact with its groups: the common input of every statement.

    Cache it when several reports of one period are wanted.
    """
    return map_to_groups(
        long_fact(books, parent, period), companies_under(books.company, parent), books.coa, books.fs_group
    )


def report(
    books,
    parent: str | None = None,
    period: str | None = None,
    statement: str = "bs",
    total: bool = True,
    fact: DataFrame | None = None,
) -> DataFrame:
    """Balance sheet or profit and loss: separate figures of the parent, and consolidated.

    The separate column holds the parent's own rows, so a parent that is not listed
    under itself has zeros there.
    """
    fact = mapped_fact(books, parent, period) if fact is None else fact
    sign = measure_sign(statement)
    own = F.col("company_code") == F.col("parent_company")
    partition = _open_codes(parent, period)
    rolled = rollup_with_total(
        statement_filter(fact, statement),
        STATEMENT_KEYS,
        {
            "separate_fs": sign * measure(*SEPARATE, when=own),
            "consolidated_fs": sign * measure(*SOURCES),
        },
        "fs_group_name",
        partition,
        total,
    )
    return _finish(rolled, partition, STATEMENT_KEYS, "fs_group_row")


def _working_measures(sign: int) -> dict:
    return {
        "total_separate": sign * measure(*SEPARATE),
        "eliminate": sign * measure("rpt"),
        "take_equity": sign * measure("te"),
        "total_conso": sign * measure(*SOURCES),
    }


def working(
    books,
    parent: str,
    period: str | None = None,
    statement: str = "bs",
    total: bool = True,
    fact: DataFrame | None = None,
    companies: Sequence[str] | None = None,
) -> DataFrame:
    """Working paper of one group: a column per company, then the consolidation columns.

    ``companies`` names the companies wanted as columns, else all of the group have one; the
    consolidation columns cover the whole group in either case.
    """
    fact = mapped_fact(books, parent, period) if fact is None else fact
    sign = measure_sign(statement)
    codes = list(companies or column_codes(companies_under(books.company, parent)))
    source = F.col("source")
    labels = (
        F.when(
            source.isin(*SEPARATE),
            F.array("company_code", F.lit("total_separate"), F.lit("total_conso")),
        )
        .when(source == "rpt", F.array(F.lit("eliminate"), F.lit("total_conso")))
        .when(source == "te", F.array(F.lit("take_equity"), F.lit("total_conso")))
        .otherwise(F.array(F.lit("none")))
    )
    partition = _open_codes(parent, period)
    wide = wide_with_total(
        statement_filter(fact, statement).withColumn("amount", sign * F.col("amount")),
        WORKING_KEYS,
        labels,
        [*codes, "total_separate", "eliminate", "take_equity", "total_conso"],
        "wk_group_name",
        partition,
        total,
    )
    return _finish(wide, partition, WORKING_KEYS, "wk_group_row")


def working_long(
    books, parent: str | None = None, period: str | None = None, statement: str = "bs"
) -> DataFrame:
    """The working paper with companies as rows, for any number of groups and companies."""
    fact = statement_filter(mapped_fact(books, parent, period), statement)
    keys = [*_open_codes(parent, period), *WORKING_KEYS, "company_code"]
    measures = _working_measures(measure_sign(statement))
    return fact.groupBy(*keys).agg(*(c.alias(name) for name, c in measures.items()))


def consolidate_by_company(
    books, parent: str | None = None, period: str | None = None
) -> DataFrame:
    """Sources and totals per company and period."""
    return consolidate(long_fact(books, parent, period), "company_code", "period_code")


def _interco_by_account(books, parent, period) -> DataFrame:
    companies = companies_under(books.company, parent)
    scoped = join_hot(
        in_period(books.interco, period), companies.select("company_code"), ["company_code"],
        "left_semi",
    )
    summed = (
        interco_fact(scoped, "rpt_interco_code")
        .groupBy(*FACT_KEYS, "rpt_interco_code", "source")
        .agg(F.sum("amount").alias("amount"))
    )
    return map_to_groups(summed, companies, books.coa, books.fs_group)


def rpt_result(
    books,
    parent: str,
    period: str | None = None,
    total: bool = True,
    companies: Sequence[str] | None = None,
) -> DataFrame:
    """Intercompany matrix: working group and partner against companies (all, or those named)."""
    codes = list(companies or column_codes(companies_under(books.company, parent)))
    keys = (*WORKING_KEYS, "rpt_interco_code")
    partition = _open_codes(parent, period)
    wide = wide_with_total(
        _interco_by_account(books, parent, period),
        keys,
        F.array("company_code", F.lit("total_rpt")),
        [*codes, "total_rpt"],
        "wk_group_name",
        partition,
        total,
    )
    return _finish(wide, partition, keys, "wk_group_row")


def rpt_result_long(books, parent: str | None = None, period: str | None = None) -> DataFrame:
    """The intercompany matrix with companies as rows."""
    keys = [*_open_codes(parent, period), *WORKING_KEYS, "rpt_interco_code", "company_code"]
    return (
        _interco_by_account(books, parent, period)
        .groupBy(*keys)
        .agg(measure("rpt").alias("total_rpt"))
    )
