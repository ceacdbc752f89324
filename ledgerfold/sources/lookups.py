"""Uploaded codes against master rows."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.joins import join_hot


def resolve_codes(
    df: DataFrame, dims: Mapping[str, tuple[DataFrame, Sequence[str]]]
) -> DataFrame:
    """Look each row's codes up in the master tables.

    ``dims`` gives, per name, a master table and its key columns. Adds ``unresolved``:
    the names that found no master row, or an empty text where all were found.
    """
    for name, (dim, keys) in dims.items():
        known = dim.select(*keys).distinct().withColumn(f"_{name}", F.lit(True))
        df = join_hot(df, known, list(keys), "left")
    missing = [F.when(F.col(f"_{name}").isNull(), name) for name in dims]
    return df.withColumn("unresolved", F.concat_ws(",", *missing)).drop(
        *(f"_{name}" for name in dims)
    )


def lookup_account(
    coa: DataFrame,
    df: DataFrame,
    columns: Sequence[str] = ("account_code", "account_name", "wk_group_row"),
) -> DataFrame:
    """Find each row's account within its company, letter case aside.

    Adds ``matched_account``, null where there is none. Of accounts that differ in letter case
    alone the one spelled as in the row is taken, else the first by its code; a row never
    matches twice.
    """
    lowered = {f"_{c}": F.lower(c) for c in columns}
    accounts = coa.groupBy("company_code", *(e.alias(n) for n, e in lowered.items())).agg(
        F.sort_array(F.collect_set("account_code")).alias("_accounts")
    )
    found = join_hot(df.withColumns(lowered), accounts, ["company_code", *lowered], "left")
    exact = F.array_contains("_accounts", F.col("account_code"))
    matched = F.when(exact, F.col("account_code")).otherwise(F.try_element_at("_accounts", F.lit(1)))
    return found.withColumn("matched_account", matched).select(*df.columns, "matched_account")
