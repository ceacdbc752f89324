"""Joins that give a fact its company, account and group attributes.

No join here carries a broadcast hint: master tables grow with the number of groups
of companies, so Spark decides from their size, before or while the query runs.
Facts are summed to account level first, which leaves one row per join key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import or_unmapped

WORKING_KEYS = ("account_type", "account_subtype", "wk_group_row", "wk_group_name")
STATEMENT_KEYS = ("account_type", "account_subtype", "fs_group_row", "fs_group_name")
GROUP_COLUMNS = (
    "wk_group_row",
    "wk_group_name",
    "fs_group_row",
    "fs_group_name",
    "account_type",
    "account_subtype",
)


def map_to_groups(
    fact: DataFrame,
    company: DataFrame,
    coa: DataFrame,
    fs_group: DataFrame,
    *,
    keep_nulls: bool = False,
) -> DataFrame:
    """Left joins to company, chart of accounts and grouping; rows are never lost or doubled.

    An account's own working group is kept only where the parent has a grouping for it:
    everything else is labelled as unmapped, unless ``keep_nulls``.
    """
    parents = company.select("company_code", "parent_company")
    accounts = coa.select("company_code", "account_code", "account_name", "wk_group_row")
    groups = fs_group.select(F.col("company_code").alias("parent_company"), *GROUP_COLUMNS)
    mapped = (
        fact.join(parents, "company_code", "left")
        .join(accounts, ["company_code", "account_code"], "left")
        .join(groups, ["parent_company", "wk_group_row"], "left")
    )
    if keep_nulls:
        return mapped
    return mapped.withColumns({name: or_unmapped(name) for name in GROUP_COLUMNS})


def with_parent_name(company: DataFrame) -> DataFrame:
    """Self join to fetch the name of the parent company."""
    parents = company.select(
        F.col("company_code").alias("parent_company"),
        F.col("company_name").alias("parent_company_name"),
    )
    return company.join(parents, "parent_company", "left")


def with_wk_group(coa: DataFrame, fs_group: DataFrame) -> DataFrame:
    """Working-group row of each account, taken from the group it points at."""
    rows = fs_group.select(F.col("fs_group_id").alias("fs_group"), "wk_group_row")
    return coa.drop("wk_group_row").join(rows, "fs_group", "left")


def journal_facts(header: DataFrame, line: DataFrame) -> DataFrame:
    """Every header with its lines, headers without lines included.

    Written as the matching rows plus the headers that match nothing: an inner join can
    have a hot journal split by the adaptive skew join, the null side of a left join not.
    """
    lines = line.select("journal_no", *(c for c in line.columns if c not in header.columns))
    matched = header.join(lines, "journal_no")
    without_lines = header.join(line.select("journal_no").distinct(), "journal_no", "left_anti")
    return matched.unionByName(without_lines, allowMissingColumns=True)


def outer_on_group(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on the group columns, where a missing group equals a missing group.

    Both sides must hold one row per group: sum them first.
    """
    right = right.withColumnsRenamed({name: f"_{name}" for name in GROUP_COLUMNS})
    same_group = [left[name].eqNullSafe(right[f"_{name}"]) for name in GROUP_COLUMNS]
    joined = left.join(right, same_group, "full_outer")
    return joined.withColumns(
        {name: F.coalesce(name, f"_{name}") for name in GROUP_COLUMNS}
    ).drop(*(f"_{name}" for name in GROUP_COLUMNS))
