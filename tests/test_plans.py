"""Shape of the physical plans, with broadcasting off as if every table were large."""

import pytest
from small import HEADER, LINE, rows

import __spark_entry__ as entry
from ledgerfold.operators.facts import journal_fact
from ledgerfold.operators.journals import post_journals, update_journals
from ledgerfold.operators.mapping import journal_facts
from ledgerfold.operators.quality import check_orphans
from ledgerfold.plans.admin import company_count
from ledgerfold.plans.listings import journal_detail
from ledgerfold.sources.books import Books
from ledgerfold.sources.lookups import resolve_codes
from ledgerfold.sources.store import delete_by_key

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {
    name: query
    for part in (entry.statements, entry.loads, entry.journals, entry.admin, entry.stores, entry.checks)
    for name, query in part.QUERIES.items()
}


@pytest.fixture
def no_broadcast(spark):
    kept = {
        name: spark.conf.get(name)
        for name in (
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.coalescePartitions.enabled",
        )
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for name, value in kept.items():
        spark.conf.set(name, value)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_or_python_in_any_plan(no_broadcast, name):
    plan = plan_of(QUERIES[name](no_broadcast, SF_DIR))
    for unwanted in ("NestedLoop", "CartesianProduct", "Python", "BroadcastExchange", "SinglePartition"):
        if unwanted == "SinglePartition" and name in ("first_n", "search_periods"):
            continue  # the limit itself
        assert unwanted not in plan, unwanted


def hot_journals(spark):
    """One journal holds most of the lines."""
    headers = spark.range(400).selectExpr(
        "concat('P_JV_', id) as journal_no", "'Q' as period_code", "'P' as parent_company_code",
        "'P' as company_code", "'TakeEq' as journal_type", "id as k",
    )
    lines = spark.range(0, 60_000, 1, 8).selectExpr(
        "concat('P_JV_', if(id % 3 = 0, id % 399, 7)) as journal_no", "uuid() as account_code",
        "cast(1 as decimal(15,2)) as debit", "cast(null as decimal(15,2)) as credit",
        "if(id % 3 = 0, id % 399, 7) as k",
    )
    return headers, lines


def amounts(lines):
    return lines.selectExpr("*", "cast(0 as decimal(15,2)) as journal_amount")


HOT = {
    "journal_fact": lambda h, n: journal_fact(h, n),
    "journal_facts": lambda h, n: journal_facts(h, n),
    "journal_detail": lambda h, n: journal_detail(Books(journal_header=h, journal_line=n)),
    "post_journals": lambda h, n: post_journals(
        h, n.withColumn("credit", n.debit), h.limit(0), "k"
    ).lines,
    "update_journals": lambda h, n: update_journals(
        amounts(n), amounts(n).where("k = 9").withColumn("credit", n.debit)
    ),
    "delete_by_key": lambda h, n: delete_by_key(n, h.where("k > 100").select("journal_no")),
    "check_orphans": lambda h, n: check_orphans(n, h.where("k > 100"), ["journal_no"]),
    "resolve_codes": lambda h, n: resolve_codes(n, {"journal": (h, ["journal_no"])}),
    "company_count": lambda h, n: company_count(
        n.withColumnsRenamed({"journal_no": "parent_company", "account_code": "company_code"})
    ),
}


@pytest.mark.parametrize("name", HOT)
def test_a_hot_key_is_split(no_broadcast, name):
    spark = no_broadcast
    for option, value in {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }.items():
        spark.conf.set(option, value)
    headers, lines = hot_journals(spark)
    out = HOT[name](headers, lines)
    out.collect()
    assert "skew=true" in plan_of(out)


def test_group_sizes_without_a_window(no_broadcast):
    company = no_broadcast.createDataFrame([("P", "P"), ("S", "P")], "company_code string, parent_company string")
    out = company_count(company)
    assert "Window" not in plan_of(out)
    assert rows(out, "company_code", "company_count") == [("P", 2), ("S", 2)]


def test_journal_amounts_keep_their_schema(spark):
    headers = spark.createDataFrame([("J", "Q", "P", "P", "Other")], HEADER)
    lines = spark.createDataFrame([("J", "1", None, None)], LINE)
    assert journal_fact(headers, lines).first().source == "none"
