"""Posting, replacing and numbering adjustment journals in batches."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import journal_amount
from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.numbering import number_within
from ledgerfold.operators.quality import check_journal_scope, filled_lines, journal_totals

NUMBER_MARK = "_JV_"
UNBALANCED = "unbalanced"
EMPTY = "empty"
OUT_OF_SCOPE = "out_of_scope"


def last_numbers(header: DataFrame) -> DataFrame:
    """Highest journal number per parent, compared as a number."""
    number = F.substring_index("journal_no", NUMBER_MARK, -1).try_cast("bigint")
    return header.groupBy("parent_company_code").agg(F.max(number).alias("last_number"))


def number_journals(
    existing: DataFrame | None, batch: DataFrame, order_key: str, marks: DataFrame | None = None
) -> DataFrame:
    """Give each batch header the next journal numbers of its parent, in batch order.

    Numbers have at least five digits; both journal types share one run per parent. The last
    numbers are looked up in ``marks`` (a row for each parent) if given, else in all headers.
    """
    last = last_numbers(existing) if marks is None else marks
    number = F.coalesce("last_number", F.lit(0)) + F.col("_n")
    counted = number_within(batch.drop("journal_no"), ["parent_company_code"], order_key, "_n")
    return (
        join_hot(counted, last, ["parent_company_code"], "left")
        .withColumn(
            "journal_no",
            F.format_string(f"%s{NUMBER_MARK}%05d", "parent_company_code", number),
        )
        .drop("_n", "last_number")
    )


@dataclass(frozen=True)
class Posting:
    """Numbered headers and their lines, and the headers that were turned away."""

    headers: DataFrame
    lines: DataFrame
    rejected: DataFrame


def _with_amounts(lines: DataFrame) -> DataFrame:
    """Blank debits and credits are stored as zero, and the amount is derived from them."""
    nothing = F.lit(0).cast("decimal(15,2)")
    return lines.withColumns(
        {"debit": F.coalesce("debit", nothing), "credit": F.coalesce("credit", nothing)}
    ).withColumn("journal_amount", journal_amount())


def post_journals(
    headers: DataFrame,
    lines: DataFrame,
    existing: DataFrame | None,
    order_key: str,
    journal_type: str | None = None,
    company: DataFrame | None = None,
    period: DataFrame | None = None,
    coa: DataFrame | None = None,
    marks: DataFrame | None = None,
) -> Posting:
    """Post a batch of new journals, each whole or not at all.

    Headers and lines are tied by ``order_key``, a unique integer that also gives the
    posting order. A journal without any filled line, or out of balance, is rejected and
    uses up no number. With ``journal_type`` the whole batch is stamped with it.

    With ``company`` a header's parent is that of its company, whatever it says itself; with
    ``company``, ``period`` and ``coa`` a journal outside its parent's open periods, companies
    or accounts is rejected as out of scope.
    """
    entered = filled_lines(lines)
    if company is not None:
        parents = company.select(
            "company_code", F.col("parent_company").alias("parent_company_code")
        )
        headers = join_hot(headers.drop("parent_company_code"), parents, ["company_code"], "left")
    totals = journal_totals(entered, order_key)
    judged = headers.join(totals, order_key, "left").withColumn(
        "reason",
        F.when(F.col("sum_debit").isNull(), EMPTY).when(
            F.round(F.col("sum_debit") - F.col("sum_credit"), 2) != 0, UNBALANCED
        ),
    )
    if company is not None and period is not None and coa is not None:
        named = headers.withColumn("journal_no", F.col(order_key).cast("string"))
        own = entered.withColumn("journal_no", F.col(order_key).cast("string"))
        outside = (
            check_journal_scope(named, own, period, company, coa)
            .select(F.col("journal_no").alias("_outside"))
            .distinct()
        )
        key = F.col(order_key).cast("string") == F.col("_outside")
        judged = (
            judged.join(outside, key, "left")
            .withColumn(
                "reason",
                F.coalesce("reason", F.when(F.col("_outside").isNotNull(), OUT_OF_SCOPE)),
            )
            .drop("_outside")
        )
    accepted = judged.where(F.col("reason").isNull()).drop("reason", "sum_debit", "sum_credit")
    if journal_type is not None:
        accepted = accepted.withColumn("journal_type", F.lit(journal_type))
    numbered = number_journals(existing, accepted, order_key, marks)
    posted = (
        entered.drop("journal_no", "period_code")
        .join(numbered.select(order_key, "journal_no", "period_code"), order_key)
    )
    posted = _with_amounts(posted)
    return Posting(numbered, posted, judged.where(F.col("reason").isNotNull()))


def update_journals(
    line: DataFrame, batch: DataFrame, header: DataFrame | None = None
) -> DataFrame:
    """Replace the lines of the journals in the batch, those that balance; others keep theirs.

    With ``header`` given, lines for a journal that has none are left out.
    """
    entered = filled_lines(batch)
    balanced = (
        journal_totals(entered)
        .where(F.round(F.col("sum_debit") - F.col("sum_credit"), 2) == 0)
        .select("journal_no")
    )
    if header is not None:
        balanced = balanced.join(header.select("journal_no").distinct(), "journal_no", "left_semi")
    if "period_code" in line.columns and "period_code" not in entered.columns:
        # a journal's lines stay in the period of its header, or of its earlier lines
        known = (line if header is None else header).select("journal_no", "period_code").distinct()
        entered = join_hot(entered, known, ["journal_no"], "inner")
    accepted = _with_amounts(join_hot(entered, balanced, ["journal_no"], "left_semi"))
    return join_hot(line, balanced, ["journal_no"], "left_anti").select(*line.columns).unionByName(
        accepted.select(*line.columns)
    )
