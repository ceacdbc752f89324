"""Pivots, roll-ups, total rows, column order, labels and sorting."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.functions import row_sum
from ledgerfold.schemas import STATEMENTS


def column_codes(companies: DataFrame) -> list[str]:
    """Sorted company codes that become columns of a wide report.

    The only rows a report brings to the driver, where its schema is kept anyway.
    """
    rows = companies.select("company_code").distinct().orderBy("company_code").collect()
    return [row.company_code for row in rows]


def pivot_amount(
    df: DataFrame,
    amount: str,
    keys: Sequence[str],
    codes: Sequence[str],
    total: str | None = None,
    column: str = "company_code",
) -> DataFrame:
    """Sum by the keys with one column per code, blanks as zero, and a total across them."""
    wide = (
        df.withColumn("_code", F.col(column))
        .groupBy(*keys)
        .pivot("_code", list(codes))
        .agg(F.sum(amount))
        .fillna(0, subset=list(codes))
    )
    return wide.withColumn(total, row_sum(*codes)) if total else wide


def rollup_with_total(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    label_column: str,
    partition: Sequence[str] = (),
    total: bool = True,
) -> DataFrame:
    """Aggregate by partition and keys, and once more by partition for its total row.

    Both levels come from one pass (grouping sets). The total row carries blanks as its
    keys and the word Total as its label; it is known by its grouping, so a group that
    merely lacks a name is never taken for it. Adds ``is_total``.
    """
    aggregates = [column.alias(name) for name, column in measures.items()]
    if not total:
        return df.groupBy(*partition, *keys).agg(*aggregates).withColumn("is_total", F.lit(False))
    sets = [[F.col(c) for c in (*partition, *keys)], [F.col(c) for c in partition]]
    grouped = df.groupingSets(sets, *(F.col(c) for c in (*partition, *keys))).agg(
        F.grouping(keys[0]).alias("_grouped_away"), *aggregates
    )
    is_total = F.col("_grouped_away") == 1
    labels = {
        name: F.when(is_total, "Total" if name == label_column else "").otherwise(F.col(name))
        for name in keys
    }
    return grouped.withColumns({**labels, "is_total": is_total}).drop("_grouped_away")


def wide_with_total(
    df: DataFrame,
    keys: Sequence[str],
    labels: Column,
    columns: Sequence[str],
    label_column: str,
    partition: Sequence[str] = (),
    total: bool = True,
) -> DataFrame:
    """Sum ``amount`` into one column per label, with a total row per partition.

    ``labels`` is the array of columns a row counts in. Rows are summed by keys and labels
    first; each sum is then entered once per label, and once more for the total row, and a
    single pivot does the rest, so the work grows with the rows and not with the number of
    columns. Labels without a column are left out. Adds ``is_total``.
    """
    levels = [F.lit(False), F.lit(True)] if total else [F.lit(False)]
    is_total = F.col("is_total")
    entries = (
        df.groupBy(*partition, *keys, labels.alias("_labels"))
        .agg(F.sum("amount").alias("amount"))
        .select(
            *partition, *keys, "amount", F.explode(F.array(*levels)).alias("is_total"), "_labels"
        )
        .select(*partition, *keys, "amount", "is_total", F.explode("_labels").alias("_label"))
        .withColumns(
            {
                name: F.when(is_total, "Total" if name == label_column else "").otherwise(
                    F.col(name)
                )
                for name in keys
            }
        )
    )
    return (
        entries.groupBy(*partition, *keys, "is_total")
        .pivot("_label", list(columns))
        .agg(F.sum("amount"))
        .fillna(0, subset=list(columns))
    )


def measure_sign(statement: str) -> int:
    """Profit and loss is shown with its sign turned."""
    if statement not in STATEMENTS:
        raise ValueError(f"unknown statement {statement!r}")
    return -1 if statement == "pl" else 1


def columns_last(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Move the named columns to the end, leaving out those that are absent."""
    last = [c for c in names if c in df.columns]
    return df.select(*(c for c in df.columns if c not in last), *last)


def label(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename to report labels; columns without a label keep their name."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def sorted_by(df: DataFrame, *keys) -> DataFrame:
    """Sort; a leading '-' on a name means descending."""
    return df.orderBy(
        *(
            F.desc(key[1:]) if isinstance(key, str) and key.startswith("-") else key
            for key in keys
        )
    )


def first_n(df: DataFrame, keys: Sequence, n: int = 10) -> DataFrame:
    """The first rows in a full order; every task keeps n rows only."""
    return sorted_by(df, *keys).limit(n)


def decimals_as_double(df: DataFrame) -> DataFrame:
    """For display or export: cast each decimal once, after all sums."""
    return df.withColumns(
        {
            f.name: F.col(f.name).cast("double")
            for f in df.schema.fields
            if isinstance(f.dataType, T.DecimalType)
        }
    )


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
