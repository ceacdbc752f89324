"""Checks an uploaded file must pass, decided per file over all of its rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import clean_file_name, zero_if_null
from ledgerfold.operators.joins import join_hot

PERIOD_NOT_OPEN = "period_not_open"
NOT_ZERO = "not_zero_sum"
UNREADABLE = "unreadable_value"
SAME_NAME = "same_name"
NO_ROWS = "no_rows"


def with_open_flag(df: DataFrame, period: DataFrame, company: DataFrame) -> DataFrame:
    """Mark rows whose period is open for their company or for its parent."""
    opened = (
        period.where(F.col("period_status") == "Open")
        .select("company_code", "period_code")
        .distinct()
    )
    own = opened.withColumn("_own", F.lit(True))
    group = opened.select(
        F.col("company_code").alias("_parent"), "period_code", F.lit(True).alias("_group")
    )
    parents = company.select("company_code", F.col("parent_company").alias("_parent"))
    return (
        df.join(parents, "company_code", "left")
        .join(own, ["company_code", "period_code"], "left")
        .join(group, ["_parent", "period_code"], "left")
        .withColumn("is_open", F.coalesce("_own", "_group", F.lit(False)))
        .drop("_own", "_group", "_parent")
    )


def period_gate(
    df: DataFrame, period: DataFrame, company: DataFrame, file_column: str
) -> DataFrame:
    """Per file: how many rows lie outside an open period, and whether the file may load.

    Rows are counted by file, company and period before the periods are looked up.
    """
    counted = df.groupBy(file_column, "company_code", "period_code").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    return (
        with_open_flag(counted, period, company)
        .groupBy(file_column)
        .agg(
            F.sum("_rows").alias("file_rows"),
            F.sum(F.when(F.col("is_open"), 0).otherwise(F.col("_rows"))).alias("closed_rows"),
        )
        .withColumn("accepted", F.col("closed_rows") == 0)
    )


def sums_to_zero(total: Column) -> Column:
    return F.round(total, 2) == 0


def zero_sum_gate(
    df: DataFrame, file_column: str = "tb_file_name", amount: str = "tb_amount"
) -> DataFrame:
    """Per file: the exact total, and whether it is zero to the cent."""
    return (
        df.groupBy(file_column)
        .agg(F.sum(zero_if_null(amount)).alias("file_total"))
        .withColumn("accepted", sums_to_zero(F.col("file_total")))
    )


def file_verdicts(
    df: DataFrame,
    period: DataFrame,
    company: DataFrame,
    file_column: str,
    amount: str,
    must_be_zero: bool,
    files: DataFrame | None = None,
) -> DataFrame:
    """A verdict for every file, in one pass over the rows. Reason is null where accepted.

    Judged in this order: another file's name becomes the same once cleaned; no rows; a cell
    that cannot be read; a closed period; a sum that is not zero. Rows carry the ``file_name``
    as uploaded, and may carry ``file_path`` and ``unreadable``; ``files`` lists files that may
    have no rows. Names are cleaned once per file, not per row.
    """
    key = ["file_path", "file_name"] if "file_path" in df.columns else ["file_name"]
    lost = F.col("unreadable").cast("int") if "unreadable" in df.columns else F.lit(0)
    counted = df.groupBy(*key, "company_code", "period_code").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(zero_if_null(amount)).alias("_total"),
        F.sum(lost).alias("_lost"),
    )
    per_file = (
        with_open_flag(counted, period, company)
        .groupBy(*key)
        .agg(
            F.sum("_rows").alias("file_rows"),
            F.sum("_total").alias("file_total"),
            F.sum("_lost").alias("_lost"),
            F.bool_and("is_open").alias("_open"),
        )
    )
    if files is not None:
        per_file = files.select(*key).join(per_file, key, "left")
        per_file = per_file.withColumn("file_rows", F.coalesce("file_rows", F.lit(0)))
    per_file = per_file.withColumn(file_column, clean_file_name("file_name"))
    names = per_file.groupBy(file_column).agg(F.count(F.lit(1)).alias("_names"))
    per_file = join_hot(per_file, names, [file_column], "inner")
    reason = (
        F.when(F.col("_names") > 1, SAME_NAME)
        .when(F.col("file_rows") == 0, NO_ROWS)
        .when(F.col("_lost") > 0, UNREADABLE)
        .when(~F.col("_open"), PERIOD_NOT_OPEN)
    )
    if must_be_zero:
        reason = reason.when(~sums_to_zero(F.col("file_total")), NOT_ZERO)
    return per_file.withColumn("reason", reason).select(
        *key, file_column, "file_rows", "file_total", "reason"
    )
