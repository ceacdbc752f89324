"""Positions in any order, rules in one pass, bucketed journals, Parquet files one by one."""

from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from small import group_of_two, rows

from ledgerfold.operators import contains, rules
from ledgerfold.operators.numbering import with_position
from ledgerfold.schemas import TABLES
from ledgerfold.sources import buckets, files, store
from ledgerfold.sources.books import Books

D = Decimal


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- positions ----------------------------------------------------------------------


@pytest.mark.parametrize("keys", [["a", "-b", "c"], ["-c"], ["b", "c"]])
def test_positions_are_those_of_a_sort(spark, keys):
    df = spark.range(5_000).selectExpr("id % 3 as a", "if(id % 11 = 0, null, id % 7) as b", "id as c")
    found = with_position(df, keys)
    order = [F.desc(k[1:]) if isinstance(k, str) and k[0] == "-" else k for k in keys]
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    got = sorted(found.collect(), key=lambda r: r.position)
    assert [tuple(r)[:3] for r in got] == want
    assert [r.position for r in got] == list(range(1, 5_001))


def test_positions_of_equal_rows_and_of_none(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr("cast(1 as int) as a")
    found = with_position(df, ["a"])
    assert found.agg(F.count_distinct("position"), F.max("position")).first()[:] == (20_000, 20_000)
    assert with_position(df.limit(0), ["a"]).isEmpty()


def test_no_range_holds_a_repeated_key(spark):
    """One key is on all rows; they are dealt to many ranges all the same."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 40_000, 1, 8).selectExpr("'hot' as k")
        sizes = with_position(df, ["k"]).groupBy("_metadata.file_name").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 10_000


def test_a_position_needs_no_global_window(spark):
    out = with_position(group_of_two(spark).trial_balance, ["company_code", "account_code"])
    assert "Window" not in plan_of(out) and "SinglePartition" not in plan_of(out)


# ---- rules --------------------------------------------------------------------------


def full(spark, **changes):
    b = group_of_two(spark)
    user = spark.createDataFrame(
        [("u", "a@x", "A", 1), ("v", "a@x", "B", 1), ("w", None, "C", 1), ("x", None, "D", 1)],
        "username string, email string, first_name string, company_id bigint",
    )
    empty = {
        name: spark.createDataFrame([], TABLES[name]) for name in ("plan", "subscription")
    }
    return Books(**{**vars(b), "user": user, **empty, **changes})


def test_right_books_break_doubled_mail_only(spark):
    found = {(r.table_name, r.rule): r.violations for r in rules.check_all(full(spark)).collect()}
    # the small books use their account types as subtypes
    found = {k: v for k, v in found.items() if k[1] != "domain:account_subtype"}
    assert found == {("user", "unique:email"): 1}


def test_each_fault_is_found_once(spark):
    b = full(spark)
    line = b.journal_line.unionByName(
        spark.createDataFrame(
            [("P_JV_00001", "9999", D("1"), None), ("gone", "0100", D("-1"), None)], b.journal_line.schema
        )
    )
    header = b.journal_header.withColumn(
        "company_code", F.when(F.col("journal_no") == "P_JV_00002", "X").otherwise(F.col("company_code"))
    )
    coa = b.coa.withColumn("fs_group", F.when(F.col("account_code") == "0600", 99).otherwise(F.col("fs_group")))
    period = b.period.withColumn("period_status", F.lit("Open"))
    broken = full(spark, journal_line=line, journal_header=header, coa=coa, period=period)
    found = {(r.table_name, r.rule): r.violations for r in rules.check_all(broken).collect()}
    expected = {
        ("journal_line", "scope:account_code"): 1,
        ("journal_line", "orphan:journal_no"): 1,
        ("journal_line", "negative:debit"): 1,
        ("journal_line", "balanced"): 2,
        ("journal_header", "scope:company_code"): 1,
        ("coa", "orphan:fs_group"): 3,
        ("period", "one_open"): 1,
    }
    assert {k: v for k, v in found.items() if k in expected} == expected


def test_a_table_is_read_once_for_all_its_row_rules(spark):
    df = group_of_two(spark).trial_balance
    marked = rules.with_violations(df, rules.row_rules("trial_balance", df.columns))
    assert "Exchange" not in plan_of(marked)
    assert marked.where(F.size("violations") > 0).isEmpty()


def test_violations_are_counted_while_rows_are_written(spark, tmp_path):
    lines = group_of_two(spark).journal_line
    found = Observation("rules")
    own = rules.watched(lines, {"no_debit": F.col("debit").isNull(), "none": F.lit(False)}, found)
    own.write.parquet(str(tmp_path / "lines"))
    assert found.get == {"no_debit": 2, "none": 0}


def test_a_batch_is_held_against_stored_keys(spark):
    coa = group_of_two(spark).coa
    batch = coa.where("company_code = 'P'").unionByName(
        spark.createDataFrame(
            [("Q", "1", "new", 1, "W1"), ("Q", "2", "new", 1, "W1"), ("Q", "2", "new", 1, "W1"), (None, "2", "x", 1, "W")],
            coa.schema,
        )
    )
    out = rules.check_unique_load(batch, coa, ["company_code", "account_code"])
    assert ("Q", "2", 2, False) in rows(out) and ("P", "0100", 1, True) in rows(out)
    assert out.count() == 7
    with_period = rules.check_unique_load(
        group_of_two(spark).period, group_of_two(spark).period, ["company_code", "period_code"], "period_code"
    )
    assert with_period.count() == 2


# ---- journals in buckets ------------------------------------------------------------


def test_bucketed_journals_are_joined_without_a_shuffle(spark, tmp_path):
    b = group_of_two(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buckets.write_journals(b, str(tmp_path / "j"), "near", 4)
        own = buckets.with_journals(b, spark, "near")
        out = buckets.journal_sums(own)
        assert "Exchange" not in plan_of(out)
        want = [("P_JV_00001", D("20.00"), D("20.00")), ("P_JV_00002", D("3.00"), D("3.00"))]
        assert rows(out, "journal_no", "sum_debit", "sum_credit") == want
        for name in buckets.JOURNAL_TABLES:
            spark.sql(f"drop table near_{name}")
        buckets.open_journals(spark, str(tmp_path / "j"), "near", 4)  # as another session would
        again = buckets.journal_sums(buckets.with_journals(b, spark, "near"))
        assert "Exchange" not in plan_of(again) and rows(again, "journal_no", "sum_debit", "sum_credit") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# ---- Parquet files ------------------------------------------------------------------


def put(tmp_path, name, df):
    """One file of that name."""
    folder = tmp_path / "parts" / name
    df.coalesce(1).write.parquet(str(folder))
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_bytes(next(folder.glob("part-*.parquet")).read_bytes())


def test_files_of_different_schemas_are_judged_alone(spark, tmp_path):
    names = "company_code string, period_code string, account_code string, account_name string, tb_amount {}"
    make = spark.createDataFrame
    whole = [("P", "Q1_2024", "0100", "Cash", "5"), ("P", "Q1_2024", "0300", "Loans", "-5")]
    nameless = [(c, p, a, None, D(x)) for c, p, a, _, x in whole]
    put(tmp_path, "nameless.parquet", make(nameless, names.format("decimal(15,2)")))
    put(tmp_path, "double.parquet", make([(c, p, a, n, float(x)) for c, p, a, n, x in whole], names.format("double")))
    put(tmp_path, "text.parquet", make(whole, names.format("string")))
    put(tmp_path, "words.parquet", make([(*whole[0][:4], "five"), whole[1]], names.format("string")))
    put(tmp_path, "foreign.parquet", make(nameless, names.format("decimal(15,2)")).withColumn("more", F.lit(None).cast("int")))
    put(tmp_path, "lacking.parquet", make(nameless, names.format("decimal(15,2)")).drop("account_name"))
    put(tmp_path, "none.parquet", make([], names.format("decimal(15,2)")))
    put(tmp_path, "odd[1] {a}.parquet", make(nameless, names.format("decimal(15,2)")))
    put(tmp_path, "nested.parquet", make(nameless, names.format("decimal(15,2)")).withColumn("tb_amount", F.array("tb_amount")))
    (tmp_path / "in" / "torn.parquet").write_bytes(b"no parquet at all")
    load = store.import_tb(group_of_two(spark), files.read_tb(spark, str(tmp_path / "in"), "parquet"))
    assert rows(load.files, "tb_file_name", "reason") == [
        ("double.parquet", None),
        ("foreign.parquet", "bad_header"),
        ("lacking.parquet", "bad_header"),
        ("nameless.parquet", None),
        ("nested.parquet", "bad_header"),
        ("none.parquet", "no_rows"),
        ("odd_1_ _a_.parquet", None),
        ("text.parquet", None),
        ("torn.parquet", "bad_header"),
        ("words.parquet", "unreadable_value"),
    ]
    assert load.accepted.count() == 8


# ---- search -------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["ab", "abc", "ÄBC", "c%a", "_", "no such text", "aaaa", "你好吗", "", "cab c"])
def test_an_indexed_search_is_that_of_a_scan(spark, tmp_path, text):
    alphabet = ["a", "B", "c", " ", "%", "_", "ä", "你", "好", "吗"]
    cells = F.concat_ws("", *(F.element_at(F.array(*map(F.lit, alphabet)), (F.abs(F.xxhash64("id", F.lit(k))) % 10 + 1).cast("int")) for k in range(8)))
    df = spark.range(600).select("id", F.when(F.col("id") % 50 != 0, F.concat(cells, F.lit("abc"))).alias("t"))
    contains.write_index(df, str(tmp_path / "i"), "id", ["t"])
    found = contains.search(df, str(tmp_path / "i"), "id", "t", text)
    assert rows(found, "id") == rows(df.where(F.lower("t").contains(text.lower())), "id")


def test_a_search_reads_the_postings_of_its_pieces(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "concat('common ', id, ' text') as t")
    contains.write_index(df, str(tmp_path / "i"), "id", ["t"])
    found = contains.candidates(spark, str(tmp_path / "i"), "t", "n 77 t")
    assert rows(found) == [(77,)]
    assert "PushedFilters" in plan_of(found) and "In(piece" in plan_of(found)


def test_postings_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contains, "POSTINGS", 100, raising=False)
    df = spark.range(0, 400, 1, 1).selectExpr("id", "concat('Order ', id, ' Order') as t")
    contains.write_index(df, str(tmp_path / "i"), "id", ["t"])
    stored = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 400
    assert stored.count() == stored.distinct().count()
    found = contains.candidates(spark, str(tmp_path / "i"), "t", "Order")
    assert found.count() == 400 and "partial_bit_or" not in plan_of(found).split("Exchange")[-1]


def test_a_task_writes_the_postings_of_its_own_rows(spark, tmp_path, monkeypatch):
    """Postings that are shuffled by their order are cut twice, and leave a row in many files."""
    monkeypatch.setattr(contains, "POSTINGS", 200)
    df = spark.range(0, 400, 1, 1).selectExpr("id", "concat('Order ', id) as t", "concat(id, ' by Mail') as u")
    contains.write_index(df, str(tmp_path / "i"), "id", ["t", "u"])
    stored = spark.read.parquet(str(tmp_path / "i" / "postings")).withColumn("file", F.input_file_name())
    assert stored.groupBy("column_name", "key").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0] == 1
    assert stored.select("file").distinct().count() > 10
    for file in sorted((tmp_path / "i" / "postings").glob("*.parquet")):
        own = [tuple(r) for r in spark.read.parquet(str(file)).select("column_name", "piece").collect()]
        assert own == sorted(own)
    for column, text in (("t", "Order 39"), ("u", "39 BY m")):
        found = contains.search(df, str(tmp_path / "i"), "id", column, text)
        assert rows(found, "id") == rows(df.where(F.lower(column).contains(text.lower())), "id")
