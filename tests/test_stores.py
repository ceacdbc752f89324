"""Stored books: changes as a whole, the ledger of files, tenants, kept sums, posting marks."""

import random
from decimal import Decimal

import pytest
from small import HEADER, LINE, TB, group_of_two, rows

from ledgerfold.plans import bookkeeping as bk
from ledgerfold.plans.statements import mapped_fact, report
from ledgerfold.schemas import TABLES
from ledgerfold.sources.files import Upload
from ledgerfold.sources.generations import ChangeConflict, Store, compact
from ledgerfold.sources.store import INTERCO, TRIAL_BALANCE

D = Decimal


def opened(spark, tmp_path, **changes):
    books = group_of_two(spark, **changes)
    both = [("P", "Q1_2024", "Open"), ("P", "Q2_2024", "Open"), ("P", "Q4_2023", "Closed")]
    books = group_of_two(
        spark, **{**changes, "period": spark.createDataFrame(both, books.period.schema)}
    )
    lines = books.journal_line.selectExpr("*", "'Q1_2024' as period_code", "'x' as account_name")
    books = group_of_two(
        spark, **{**changes, "period": books.period, "journal_line": lines}
    )
    store = Store.create(spark, str(tmp_path / "store"))
    bk.store_books(store, books)
    return books, store


def upload(spark, *lines):
    """(company, period, account, amount, file)"""
    return Upload(
        spark.createDataFrame(
            [(c, p, a, D(x), f) for c, p, a, x, f in lines], TB.replace("tb_file_name", "file_name")
        ),
        None,
    )


def tb_rows(store):
    return rows(store.table("trial_balance"), "company_code", "period_code", "tb_amount", "tb_file_name")


def pair(company, period, amount, name):
    return [(company, period, "0100", amount, name), (company, period, "0200", f"-{amount}", name)]


def test_a_moved_file_leaves_its_old_period(spark, tmp_path):
    books, store = opened(spark, tmp_path, trial_balance=spark.createDataFrame([], TB))
    first = bk.import_files(store, books, upload(spark, *pair("P", "Q1_2024", "5", "a.csv")), TRIAL_BALANCE)
    assert first.periods == ("Q1_2024",)
    moved = bk.import_files(store, books, upload(spark, *pair("P", "Q2_2024", "7", "a.csv")), TRIAL_BALANCE)
    assert set(moved.periods) == {"Q1_2024", "Q2_2024"}
    assert [(p, x) for _, p, x, _ in tb_rows(store)] == [("Q2_2024", D("-7.00")), ("Q2_2024", D("7.00"))]
    assert len(rows(store.table("trial_balance", first.version))) == 2  # the version before stays
    ledger = store.files("trial_balance").collect()
    assert [(r.file_name, [p.period_code for p in r.periods]) for r in ledger] == [("a.csv", ["Q2_2024"])]


def test_the_same_rows_again_write_nothing(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    lines = pair("P", "Q1_2024", "5", "a.csv")
    made = bk.import_files(store, books, upload(spark, *lines), TRIAL_BALANCE).version
    again = bk.import_files(store, books, upload(spark, *reversed(lines)), TRIAL_BALANCE)
    assert again.version is None and again.periods == () and store.version() == made
    twice = bk.import_files(store, books, upload(spark, *lines, *lines), TRIAL_BALANCE)
    assert twice.version == made + 1  # a repeated row counts


def test_rejected_files_change_nothing(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    bad = upload(spark, ("P", "Q1_2024", "0100", "5", "p.csv"), *pair("P", "Q4_2023", "1", "old.csv"))
    load = bk.import_files(store, books, bad, TRIAL_BALANCE)
    assert load.version is None and store.version() == 1
    assert rows(load.files, "tb_file_name", "reason") == [
        ("old.csv", "period_not_open"), ("p.csv", "not_zero_sum")
    ]


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    books, store = opened(spark, tmp_path)
    before, summed = tb_rows(store), rows(store.table("account_fact"))

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(bk, "_refresh", dies)
    with pytest.raises(RuntimeError):
        bk.import_files(store, books, upload(spark, *pair("P", "Q1_2024", "5", "p.csv")), TRIAL_BALANCE)
    monkeypatch.undo()
    assert tb_rows(store) == before and rows(store.table("account_fact")) == summed
    load = bk.import_files(store, books, upload(spark, *pair("P", "Q1_2024", "5", "p.csv")), TRIAL_BALANCE)
    assert load.version == 2 and tb_rows(store) != before


def test_of_two_writers_the_later_fails(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    one, two = store.begin(books.company), store.begin(books.company)
    for change in (one, two):
        change.replace("trial_balance", change.table("trial_balance").limit(1), ["Q1_2024"])
    one.commit()
    with pytest.raises(ChangeConflict):
        two.commit()
    assert store.version() == one.version
    assert len({f.change for f in store.folders("trial_balance")} & {two.id}) == 0


def test_an_import_reads_the_touched_periods_only(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    change = store.begin(books.company)
    names = spark.createDataFrame([("p.csv",)], "tb_file_name string")
    width = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        out = bk.next_rows(change, TRIAL_BALANCE, names, ["Q1_2024"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", width)
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "period_code" in filters and "Q1_2024" in filters and "Q4_2023" not in filters


def test_files_are_deleted_with_their_periods(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    assert bk.delete_files(store, books, TRIAL_BALANCE, "nothing.csv") is None
    bk.delete_files(store, books, TRIAL_BALANCE, "old.csv", "s.csv")
    assert {name for *_, name in tb_rows(store)} == {"p.csv", "x.csv"}
    assert {r.file_name for r in store.files("trial_balance").collect()} == {"p.csv", "x.csv"}
    assert "Q4_2023" not in {f.period_code for f in store.folders("trial_balance")}
    bk.delete_files(store, books, INTERCO, "r.csv")
    assert store.table("interco").isEmpty() and store.folders("interco") == []


def batch(spark, *numbers, company="P", amount="4.00"):
    headers = [("", "Q1_2024", "P", company, "TakeEq", k) for k in numbers]
    lines = [
        (n, a, d, c, k)
        for k in numbers
        for n, a, d, c in (("", "0200", D(amount), None), ("", "0400", None, D(amount)))
    ]
    return (
        spark.createDataFrame(headers, HEADER + ", k bigint"),
        spark.createDataFrame(lines, LINE + ", k bigint"),
    )


def test_a_batch_is_posted_once(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    headers, lines = batch(spark, 1, 2)
    assert bk.post_batch(store, books, headers, lines, "k", "monday") is not None
    assert bk.post_batch(store, books, headers, lines, "k", "monday") is None
    assert [n for (n,) in rows(store.table("journal_header"), "journal_no")] == [
        f"P_JV_0000{n}" for n in (1, 2, 3, 4)
    ]
    bk.post_batch(store, books, *batch(spark, 9), "k", "tuesday")
    marks = store.table("journal_marks").groupBy("parent_company_code").agg({"last_number": "max"})
    assert rows(marks) == [("P", 5)]


def test_posting_reads_no_stored_header(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    posting = bk.post_batch(store, books, *batch(spark, 1), "k", "b")
    assert "journal_header" not in posting.headers._jdf.queryExecution().executedPlan().toString()


def same_reports(books, store):
    kept = store.books(books)
    for parent, period in (("P", "Q1_2024"), (None, None)):
        for statement in ("bs", "pl"):
            direct = report(kept, parent, period, statement, fact=mapped_fact(kept, parent, period))
            quick = report(kept, parent, period, statement, fact=bk.kept_fact(kept, parent, period))
            assert rows(direct) == rows(quick)


def test_kept_sums_follow_any_series_of_changes(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    rng = random.Random(7)
    for step in range(6):
        kind = rng.choice(["import", "import", "delete", "post", "compact", "lines", "journals"])
        if kind == "import":
            lines = [
                line
                for _ in range(rng.randint(1, 3))
                for line in pair(
                    rng.choice("PS"), rng.choice(["Q1_2024", "Q2_2024"]), str(rng.randint(1, 99)),
                    rng.choice(["p.csv", "s.csv", "new.csv"]),
                )
            ]
            bk.import_files(store, books, upload(spark, *lines), TRIAL_BALANCE)
        elif kind == "delete":
            bk.delete_files(store, books, TRIAL_BALANCE, rng.choice(["p.csv", "s.csv", "new.csv"]))
        elif kind == "post":
            bk.post_batch(store, books, *batch(spark, 1, 2, company=rng.choice("PS")), "k", f"b{step}")
        elif kind == "lines":
            some = store.table("journal_line").where("journal_no = 'P_JV_00002'")
            bk.replace_lines(store, books, some.withColumn("account_code", some.account_name))
        elif kind == "journals":
            bk.delete_journals(store, books, store.table("journal_header").orderBy("journal_no").limit(1))
        else:
            for name in ("account_fact", "journal_line"):
                compact(store, name, books.company)
    same_reports(books, store)


def test_compaction_keeps_rows_and_leaves_one_folder(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    bk.post_batch(store, books, *batch(spark, 1), "k", "one")
    before = rows(store.table("journal_line"))
    assert len(store.folders("journal_line")) == 2
    compact(store, "journal_line", books.company)
    assert rows(store.table("journal_line")) == before and len(store.folders("journal_line")) == 1
    assert compact(store, "journal_line", books.company) is None
    assert {r.table_name for r in store.superseded().collect()} == {"journal_line"}


def scanned(df) -> int:
    """Rows that the scans of a query gave out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        found += leaves.apply(k).metrics().apply("numOutputRows").value()
    return found


def test_one_tenant_of_a_thousand_reads_few_pages(spark, tmp_path):
    company = spark.range(1_000).selectExpr(
        "format_string('C%04d', id) as company_code", "'n' as company_name", "'Parent' as company_type",
        # neighbours in code belong to different groups
        "format_string('C%04d', id % 100) as parent_company",
    )
    tb = spark.range(0, 400_000, 1, 8).selectExpr(
        "format_string('C%04d', id % 1000) as company_code", "'Q1_2024' as period_code",
        "cast(uuid() as string) as account_code", "cast(1 as decimal(15,2)) as tb_amount", "'f' as tb_file_name",
    )
    books = group_of_two(spark, company=company, trial_balance=tb)
    store = Store.create(spark, str(tmp_path / "store"))
    change = store.begin(company)
    change.replace("trial_balance", tb, [])
    change.commit()
    cut = bk.of_tenant(store.books(books), "C0007").trial_balance
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = cut.select("company_code", "tb_amount")
        assert out.count() == 4_000
        assert scanned(out) < 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    many = [f"C{n:04d}" for n in range(0, 35)]
    from ledgerfold.sources.generations import with_codes

    assert with_codes(store.books(books), many).trial_balance.count() == 35 * 400
    assert with_codes(store.books(books), []).trial_balance.count() == 0


def test_stored_columns_are_those_declared(spark, tmp_path):
    _, store = opened(spark, tmp_path)
    for name in ("trial_balance", "interco", "journal_header", "journal_line"):
        assert store.table(name).columns == TABLES[name].names
    empty = Store.create(spark, str(tmp_path / "empty"))
    assert empty.table("interco").columns == TABLES["interco"].names and empty.version() == 0


def test_journal_lines_are_replaced_and_journals_deleted(spark, tmp_path):
    books, store = opened(spark, tmp_path)
    unknown = spark.createDataFrame([("none", "1", D("1"), D("1"))], LINE)
    assert bk.replace_lines(store, books, unknown) is None
    new = [("P_JV_00002", "0200", D("8"), None), ("P_JV_00002", "0400", None, D("8")),
           ("P_JV_00001", "0100", D("1"), None)]  # the last is out of balance
    bk.replace_lines(store, books, spark.createDataFrame(new, LINE))
    lines = store.table("journal_line").groupBy("journal_no").agg({"debit": "sum"})
    assert rows(lines) == [("P_JV_00001", D("20.00")), ("P_JV_00002", D("8.00"))]
    same_reports(books, store)
    bk.delete_journals(store, books, spark.createDataFrame([("P_JV_00001",)], "journal_no string"))
    assert rows(store.table("journal_header"), "journal_no") == [("P_JV_00002",)]
    assert set(rows(store.table("journal_line"), "journal_no")) == {("P_JV_00002",)}
    same_reports(books, store)
    bk.post_batch(store, books, *batch(spark, 1), "k", "later")
    assert rows(store.table("journal_header"), "journal_no") == [("P_JV_00002",), ("P_JV_00003",)]


def test_rows_are_made_once_when_written(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    tb = spark.range(0, 500, 1, 4).selectExpr(
        "case when id % 3 = 0 then 'P' else 'S' end as company_code", "'Q1_2024' as period_code",
        "cast(id as string) as account_code", "cast(1 as decimal(15,2)) as tb_amount", "'f' as tb_file_name",
    )
    store = Store.create(spark, str(tmp_path / "store"))
    change = store.begin(group_of_two(spark).company)
    change.replace("trial_balance", tb.mapInArrow(counted, tb.schema), [])
    change.commit()
    assert store.table("trial_balance").count() == 500
    assert made.value == 500


def test_an_import_digests_its_rows_once(spark, tmp_path, monkeypatch):
    books, store = opened(spark, tmp_path)
    digests = spark.sparkContext.accumulator(0)
    periods = bk.file_periods

    def counted(df, kind):
        found = periods(df, kind)

        def run(batches):
            for batch in batches:
                digests.add(batch.num_rows)
                yield batch

        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(bk, "file_periods", counted)
    bk.import_files(store, books, upload(spark, *pair("P", "Q1_2024", "5", "new.csv")), TRIAL_BALANCE)
    assert digests.value == 1


def test_kept_tables_are_those_of_their_joins(spark, tmp_path):
    from ledgerfold.sources.star_schema import StarSchemaBooks

    for name, sql in {
        "nation": "select cast(id as int) as n_nationkey, 'n' as n_name, cast(id % 2 as int) as n_regionkey from range(6)",
        "customer": "select id as c_custkey, id % 6 as c_nationkey from range(12)",
        "supplier": "select id as s_suppkey, id % 6 as s_nationkey from range(5)",
        "part": "select id as p_partkey, cast(id % 50 + 1 as int) as p_size from range(60)",
        "orders": "select id as o_orderkey, id % 14 as o_custkey, '1-URGENT' as o_orderpriority,"
        " timestamp '1997-01-01' as o_orderdate, id * 1.5D as o_totalprice from range(20)",
        "lineitem": "select id % 25 as l_orderkey, id % 70 as l_partkey, id % 6 as l_suppkey,"
        " id * 2D as l_extendedprice, if(id % 3 = 0, 'R', null) as l_returnflag from range(300)",
    }.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    own = StarSchemaBooks(spark, str(tmp_path))
    kept = own.kept(str(tmp_path / "kept"))
    for name in ("trial_balance", "interco", "journal_header", "journal_line"):
        found = getattr(kept, name)
        assert rows(found) == rows(getattr(own, name)) != []
        assert "lineitem" not in found._jdf.queryExecution().toString()
