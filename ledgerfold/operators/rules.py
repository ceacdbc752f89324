"""All rules of the data model at once: one pass over each table.

A row's rules become one projection that lists those it breaks. Rules that look into another
table share one join for all of them; rules on several rows (unique keys, balances, one open
period) are one grouping each. The one-rule functions in `quality` return the rows themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.quality import check_balanced, check_one_open, check_unique
from ledgerfold.schemas import (
    ACCOUNT_SUBTYPES,
    ACCOUNT_TYPES,
    COMPANY_TYPES,
    MAX_LENGTHS,
    PERIOD_STATUSES,
)

#: Columns that must be filled, and keys held by one row only (fixed values of the data model).
REQUIRED = {
    "company": ("company_code", "company_name"),
    "period": ("company_code", "period_code"),
    "coa": ("company_code", "account_code"),
    "fs_group": ("company_code", "wk_group_row"),
}
UNIQUE = {
    "company": (("company_code",), ("company_name",)),
    "period": (("company_code", "period_code"),),
    "coa": (("company_code", "account_code"),),
    "fs_group": (("company_code", "wk_group_row"),),
    "plan": (("plan_code",), ("plan_description",)),
    "subscription": (("company_code",),),
    "user": (("email",),),
}
DOMAINS = {
    "company": {"company_type": COMPANY_TYPES},
    "period": {"period_status": PERIOD_STATUSES},
    "fs_group": {"account_type": ACCOUNT_TYPES, "account_subtype": ACCOUNT_SUBTYPES},
}
NOT_NEGATIVE = {"journal_line": ("debit", "credit")}
AMOUNTS = {"trial_balance": ("tb_amount",), "interco": ("rpt_amount",), "journal_line": ("debit", "credit")}
MOST = 10**13


def row_rules(name: str, columns: Sequence[str]) -> dict[str, Column]:
    """The rules a row of a table can break by itself, by rule name."""
    rules = {f"required:{c}": F.col(c).isNull() for c in REQUIRED.get(name, ()) if c in columns}
    rules |= {
        f"length:{c}": F.length(c) > most
        for c, most in MAX_LENGTHS.items()
        if c in columns and name != "upload"
    }
    for c, values in DOMAINS.get(name, {}).items():
        rules[f"domain:{c}"] = ~F.col(c).isin(*values)
    rules |= {f"negative:{c}": F.col(c) < 0 for c in NOT_NEGATIVE.get(name, ())}
    rules |= {f"too_long:{c}": F.abs(c) >= MOST for c in AMOUNTS.get(name, ())}
    return rules


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``, the names of the rules that a row breaks; an unknown breaks none."""
    broken = [F.when(condition, F.lit(rule)) for rule, condition in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def watched(df: DataFrame, rules: Mapping[str, Column], found: Observation) -> DataFrame:
    """The same rows; whatever reads them to their end counts each rule's violations in passing,
    as an import does while it writes. Read the counts off ``found`` afterwards."""
    return df.observe(found, *(F.count_if(broken).alias(rule) for rule, broken in rules.items()))


def _counted(df: DataFrame, name: str) -> DataFrame:
    return (
        df.select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit(name).alias("table_name"), "rule", "violations")
    )


def _found(df: DataFrame, flag: str) -> DataFrame:
    return df.distinct().withColumn(flag, F.lit(True))


def linked(books) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    """Tables with what their rules look up in other tables, and those rules.

    Journals are joined once for all that is asked of them: a line's header tells whether it is an
    orphan, and whose chart its account has to be in.
    """
    coa = join_hot(
        books.coa,
        _found(books.fs_group.select(F.col("fs_group_id").alias("fs_group")), "_group"),
        ["fs_group"],
        "left",
    )
    opened = books.period.where(F.col("period_status") == "Open").select(
        F.col("company_code").alias("parent_company_code"), "period_code"
    )
    members = books.company.select(
        F.col("parent_company").alias("parent_company_code"), "company_code"
    )
    charted = books.coa.select(F.col("company_code").alias("parent_company_code"), "account_code")
    headers = join_hot(
        books.journal_header, _found(opened, "_open"), ["parent_company_code", "period_code"], "left"
    )
    headers = join_hot(
        headers, _found(members, "_member"), ["parent_company_code", "company_code"], "left"
    )
    lines = join_hot(
        books.journal_line,
        _found(books.journal_header.select("journal_no", "parent_company_code"), "_header"),
        ["journal_no"],
        "left",
    )
    lines = join_hot(
        lines, _found(charted, "_charted"), ["parent_company_code", "account_code"], "left"
    )
    none = {flag: F.col(flag).isNull() for flag in ("_group", "_open", "_member", "_header", "_charted")}
    return {
        "coa": (coa, {"orphan:fs_group": F.col("fs_group").isNotNull() & none["_group"]}),
        "journal_header": (
            headers,
            {"scope:period_code": none["_open"], "scope:company_code": none["_member"]},
        ),
        "journal_line": (
            lines,
            {
                "orphan:journal_no": F.col("journal_no").isNotNull() & none["_header"],
                "scope:account_code": ~none["_header"] & none["_charted"],
            },
        ),
    }


def check_all(books) -> DataFrame:
    """Violations of every rule by table: table_name, rule, violations; kept rules have no row.

    Row rules count rows; rules on several rows count keys, journals or companies.
    """
    found = []
    joined = linked(books)
    for name in ("company", "period", "coa", "fs_group", "plan", "subscription", "user",
                 "trial_balance", "interco", "journal_header", "journal_line"):
        df, rules = joined.get(name, (getattr(books, name), {}))
        rules = row_rules(name, df.columns) | rules
        if rules:
            found.append(_counted(with_violations(df, rules), name))
        for keys in UNIQUE.get(name, ()):
            rule = f"unique:{','.join(keys)}"
            doubled = check_unique(getattr(books, name), keys)
            found.append(_counted(doubled.select(F.array(F.lit(rule)).alias("violations")), name))
    several = {
        ("period", "one_open"): check_one_open(books.period),
        ("journal_line", "balanced"): check_balanced(books.journal_line),
    }
    for (name, rule), df in several.items():
        found.append(_counted(df.select(F.array(F.lit(rule)).alias("violations")), name))
    return reduce(DataFrame.unionByName, found)


def check_unique_load(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], period: str | None = None
) -> DataFrame:
    """Keys of a batch that cannot be loaded: repeated in it, or stored already.

    With ``period`` among the keys, only the stored periods that the batch names are read. Stored
    rows are matched by key, not grouped anew. Keys with a null are exempt.
    """
    counts = batch.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batch_rows")
    )
    if period is not None:  # a code for each touched period
        touched = [row[0] for row in counts.select(period).distinct().collect()]
        target = target.where(F.col(period).isin(touched))
    known = _found(join_hot(target.select(*keys), counts.select(*keys), keys, "left_semi"), "_stored")
    return (
        join_hot(counts, known, list(keys), "left")
        .withColumn("stored", F.coalesce("_stored", F.lit(False)))
        .where("stored or batch_rows > 1")
        .select(*keys, "batch_rows", "stored")
    )
