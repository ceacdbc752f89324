from dataclasses import replace
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from small import TB, group_of_two, rows

from ledgerfold.functions import clean_file_name
from ledgerfold.plans.listings import file_rows, upload_summary
from ledgerfold.schemas import INTERCO_FILE, TRIAL_BALANCE_FILE
from ledgerfold.sources import files, gates, lookups, store
from ledgerfold.sources.books import read_books, write_books

AT = datetime(2024, 1, 15, 10, 20)
AMOUNTS = "tb_file_name string, tb_amount decimal(15,2)"


def write(path, text):
    path.write_text(text, encoding="utf-8")


@pytest.mark.parametrize(
    "amounts, accepted",
    [
        (["0.10", "0.20", "-0.30"], True),
        (["100.00", "-99.99"], False),
        (["5.00", None, "-5.00"], True),
    ],
)
def test_zero_sum_is_exact(spark, amounts, accepted):
    df = spark.createDataFrame([("f", D(a) if a else None) for a in amounts], AMOUNTS)
    assert rows(gates.zero_sum_gate(df), "accepted") == [(accepted,)]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path / "straight.csv",
          "company_code,period_code,account_code,account_name,tb_amount\nP,Q1_2024,0100,Cash,12.50\n")
    write(tmp_path / "permuted.csv",
          "tb_amount,account_name,account_code,period_code,company_code\n-12.50,Bank,0200,Q1_2024,S\n")
    upload = files.read_tb(spark, str(tmp_path))
    assert rows(upload.rows, "company_code", "account_code", "tb_amount", "file_name") == [
        ("P", "0100", D("12.50"), "straight.csv"),
        ("S", "0200", D("-12.50"), "permuted.csv"),
    ]
    assert "account_name" not in upload.rows.columns
    assert upload.rejected.isEmpty()


@pytest.mark.parametrize(
    "header",
    [
        "company_code,period_code,account_code,tb_amount",
        "company_code,period_code,account_code,account_name,tb_amount,note",
        "company_code,period_code,account_code,account_name,amount",
    ],
)
def test_other_headers_are_rejected(spark, tmp_path, header):
    write(tmp_path / "bad.csv", header + "\n" + ",".join("1" * len(header.split(","))) + "\n")
    upload = files.read_tb(spark, str(tmp_path))
    assert rows(upload.rejected) == [("bad.csv", files.INVALID_FORMAT)]
    assert upload.rows.isEmpty()


def test_odd_file_names_and_a_byte_order_mark(spark, tmp_path):
    head = "company_code,period_code,account_code,account_name,tb_amount\n"
    write(tmp_path / "a+b [1]%41.csv", "\ufeff" + head + "P,Q1_2024,0100,Cash,1.00\n")
    upload = files.read_tb(spark, str(tmp_path))
    assert rows(upload.rows, "company_code", "file_name") == [("P", "a+b [1]%41.csv")]


def test_interco_upload_and_unreadable_amount(spark, tmp_path):
    write(tmp_path / "r.csv",
          "company_code,period_code,rpt_interco_code,account_code,account_name,rpt_amount\n"
          "S,Q1_2024,P,0300,Loans,5.00\nS,Q1_2024,P,0300,Loans,abc\n")
    upload = files.read_interco(spark, str(tmp_path))
    assert rows(upload.rows, "rpt_interco_code", "rpt_amount") == [("P", D("5.00")), ("P", None)]


def test_parquet_upload_is_checked_by_schema(spark, tmp_path):
    good = spark.createDataFrame([("P", "Q", "0100", "Cash", D("1.00"))], TRIAL_BALANCE_FILE)
    good.select(*reversed(good.columns)).write.parquet(str(tmp_path / "good"))
    assert files.check_header(good, TRIAL_BALANCE_FILE)
    assert not files.check_header(good, INTERCO_FILE)
    upload = files.read_tb(spark, str(tmp_path / "good"), "parquet")
    assert rows(upload.rows, "company_code", "tb_amount") == [("P", D("1.00"))]
    other = files.read_interco(spark, str(tmp_path / "good"), "parquet")
    assert other.rows.isEmpty() and other.rejected.count() == 1


def test_master_files_are_read_by_position(spark, tmp_path):
    write(tmp_path / "coa.csv", "a,b,c,d,e\nP,0100,Cash,1,W1\n")
    assert rows(files.read_coa(spark, str(tmp_path / "coa.csv"))) == [("P", "0100", "Cash", 1, "W1")]
    write(tmp_path / "fs.csv", "a,b,c,d,e,f,g\nP,W1,Liquid,F1,Assets,t,s\n")
    assert files.read_fs_group(spark, str(tmp_path / "fs.csv")).first().fs_group_row == "F1"


def test_file_names_lose_punctuation_only(spark):
    df = spark.createDataFrame([("a[1] b-c.x'l(s)|\\~.xlsx",)], "n string")
    assert df.select(clean_file_name("n")).first()[0] == "a_1_ b-c.x_l_s____.xlsx"


def test_period_gate_looks_at_every_row(spark):
    b = group_of_two(spark)
    df = spark.createDataFrame(
        [
            ("P", "Q1_2024", "0100", D("1"), "good"),
            ("S", "Q1_2024", "0100", D("1"), "good"),  # open through its parent
            ("P", "Q1_2024", "0100", D("1"), "late"),
            ("P", "Q4_2023", "0100", D("1"), "late"),
            ("X", "Q1_2024", "0100", D("1"), "foreign"),
        ],
        TB,
    )
    out = gates.period_gate(df, b.period, b.company, "tb_file_name")
    assert rows(out) == [("foreign", 1, 1, False), ("good", 2, 0, True), ("late", 2, 1, False)]


def upload_of(spark, *data):
    schema = (
        "company_code string, period_code string, account_code string,"
        " tb_amount decimal(15,2), file_name string"
    )
    return files.Upload(spark.createDataFrame(list(data), schema), None)


def test_import_checks_before_it_replaces(spark):
    b = group_of_two(spark)
    upload = upload_of(
        spark,
        ("P", "Q1_2024", "0100", D("8.00"), "p.csv"),
        ("P", "Q1_2024", "0300", D("-8.00"), "p.csv"),
        ("S", "Q1_2024", "0200", D("1.00"), "s.csv"),  # does not sum to zero
        ("S", "Q4_2023", "0200", D("0.00"), "old.csv"),  # period closed
    )
    load = store.import_tb(b, upload)
    assert rows(load.files, "tb_file_name", "reason") == [
        ("old.csv", gates.PERIOD_NOT_OPEN),
        ("p.csv", None),
        ("s.csv", gates.NOT_ZERO),
    ]
    kept = {r.tb_file_name: r.n for r in load.table.groupBy("tb_file_name").agg({"*": "count"}).toDF("tb_file_name", "n").collect()}
    assert kept == {"p.csv": 2, "s.csv": 2, "old.csv": 1, "x.csv": 1}
    assert rows(load.table.where("tb_file_name = 'p.csv'"), "tb_amount") == [(D("-8.00"),), (D("8.00"),)]


def test_import_twice_is_the_same_as_once(spark):
    b = group_of_two(spark)
    upload = upload_of(
        spark,
        ("P", "Q1_2024", "0100", D("8.00"), "new[1].csv"),
        ("P", "Q1_2024", "0300", D("-8.00"), "new[1].csv"),
    )
    once = store.import_tb(b, upload, AT).table
    twice = store.import_tb(replace(b, trial_balance=once), upload, AT).table
    assert rows(once) == rows(twice)
    assert once.where("tb_file_name = 'new_1_.csv'").count() == 2


def test_malformed_files_are_listed_with_their_reason(spark, tmp_path):
    write(tmp_path / "bad[1].csv", "a,b\n1,2\n")
    load = store.import_tb(group_of_two(spark), files.read_tb(spark, str(tmp_path)))
    assert rows(load.files, "tb_file_name", "reason") == [("bad_1_.csv", files.INVALID_FORMAT)]
    assert load.accepted.isEmpty()


def test_delete_keeps_rows_without_a_file(spark):
    df = spark.createDataFrame([("P", "Q", "1", D("1"), None), ("P", "Q", "1", D("1"), "f")], TB)
    assert store.delete_file(df, "tb_file_name", "f").count() == 1
    assert store.delete_by_key(df, df.where("tb_file_name = 'f'").select("tb_file_name")).count() == 1


def test_insert_if_absent_treats_blanks_as_equal(spark):
    schema = "a string, b decimal(15,2)"
    target = spark.createDataFrame([("x", D("1")), ("y", None)], schema)
    batch = spark.createDataFrame([("x", D("1")), ("y", None), ("z", D("2")), ("z", D("2"))], schema)
    assert rows(store.insert_if_absent(target, batch, ["a", "b"])) == [
        ("x", D("1.00")),
        ("y", None),
        ("z", D("2.00")),
    ]


def test_cascade_delete(spark):
    b = group_of_two(spark)
    gone = spark.createDataFrame([("P_JV_00001",)], "journal_no string")
    headers, lines = store.cascade_delete(b.journal_header, b.journal_line, gone)
    assert headers.count() == 1 and lines.count() == 2
    groups, accounts = store.cascade_delete(
        b.fs_group, b.coa, spark.createDataFrame([(1,)], "fs_group_id bigint"), "fs_group"
    )
    assert groups.count() == 4 and accounts.where("fs_group = 1").isEmpty()


def test_resolve_codes_names_what_is_missing(spark):
    b = group_of_two(spark)
    df = spark.createDataFrame(
        [("P", "Q1_2024", "0100", D("1"), "f"), ("Z", "Q9", "0100", D("1"), "f")], TB
    )
    out = lookups.resolve_codes(
        df,
        {
            "company": (b.company, ["company_code"]),
            "period": (b.period, ["company_code", "period_code"]),
        },
    )
    assert rows(out, "company_code", "unresolved") == [("P", ""), ("Z", "company,period")]


def test_account_lookup_ignores_case(spark):
    df = spark.createDataFrame(
        [("P", "0100", "CASH", "w1"), ("P", "0100", "Till", "w1")],
        "company_code string, account_code string, account_name string, wk_group_row string",
    )
    out = lookups.lookup_account(group_of_two(spark).coa, df)
    assert rows(out, "account_name", "matched_account") == [("CASH", "0100"), ("Till", None)]


def test_upload_summary_by_minute_latest_first(spark):
    df = spark.createDataFrame(
        [
            ("P", "Q", datetime(2024, 1, 2, 3, 4, 5, 6), "f", D("1.00")),
            ("P", "Q", datetime(2024, 1, 2, 3, 4, 59), "f", D("2.00")),
            ("P", "Q", datetime(2024, 1, 2, 3, 5), "f", D("4.00")),
        ],
        "company_code string, period_code string, tb_date_create timestamp_ntz,"
        " tb_file_name string, tb_amount decimal(15,2)",
    )
    out = upload_summary(df).collect()
    assert [(r.date_create, r.amount_sum, r.date_label) for r in out] == [
        (datetime(2024, 1, 2, 3, 5), D("4.00"), "2 Jan 2024 03:05"),
        (datetime(2024, 1, 2, 3, 4), D("3.00"), "2 Jan 2024 03:04"),
    ]
    assert rows(file_rows(df, "tb_file_name")) == [("f", 3)]


def test_facts_are_stored_by_period_and_pruned(spark, tmp_path):
    b = group_of_two(spark)
    path = str(tmp_path / "trial_balance")
    files.write_facts(b.trial_balance, path)
    stored = read_books(spark, str(tmp_path), "trial_balance").trial_balance
    assert stored.count() == 7
    one = stored.where("period_code = 'Q1_2024'")
    assert one.count() == 6
    assert "PartitionFilters: [isnotnull(period_code" in one._jdf.queryExecution().toString()
    assert files.read_table(spark, path, "trial_balance", "tb_amount").columns == ["tb_amount"]


def test_stored_books_give_the_same_reports(spark, tmp_path):
    from ledgerfold.plans.statements import report, working
    from registry.inputs import PARENT, PERIOD, books

    derived = books(spark, "/root/testdata/sf0.001")
    tables = (
        "company", "period", "coa", "fs_group", "trial_balance", "interco",
        "journal_header", "journal_line",
    )
    write_books(derived, str(tmp_path / "v1"), *tables)
    stored = read_books(spark, str(tmp_path / "v1"), *tables)
    for plan in (report, working):
        assert rows(plan(stored, PARENT, PERIOD)) == rows(plan(derived, PARENT, PERIOD))
    text = report(stored, PARENT, PERIOD)._jdf.queryExecution().toString()
    assert text.count("PartitionFilters: [isnotnull(period_code") >= 3
    with pytest.raises(Exception, match="already exists"):
        write_books(derived, str(tmp_path / "v1"), "company")


def test_report_export(spark, tmp_path):
    from ledgerfold.plans.statements import report

    out = report(group_of_two(spark), "P", "Q1_2024")
    files.write_report(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == out.count()
    files.write_report(out, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).columns == out.columns


TB_HEAD = "company_code,period_code,account_code,account_name,tb_amount\n"


def verdicts(load):
    return {r.tb_file_name: (r.file_rows, r.reason) for r in load.files.collect()}


def test_unreadable_amounts_reject_their_file(spark, tmp_path):
    line = "P,Q1_2024,0100,Cash,"
    write(tmp_path / "bad.csv", TB_HEAD + f'{line}"1,234.50"\n{line}abc\n{line}0\n')
    write(tmp_path / "big.csv", TB_HEAD + f"{line}99999999999999999.00\n{line}0\n")
    write(tmp_path / "ok.csv", TB_HEAD + f"{line}2.00\n{line}-2.00\n{line}\n")
    load = store.import_tb(group_of_two(spark), files.read_tb(spark, str(tmp_path)))
    assert verdicts(load) == {
        "bad.csv": (3, "unreadable_value"), "big.csv": (2, "unreadable_value"), "ok.csv": (3, None)
    }


def test_each_file_is_read_by_its_own_header_and_gets_a_verdict(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
    write(tmp_path / "a" / "x.csv", TB_HEAD + "P,Q1_2024,0100,Cash,5.00\nP,Q1_2024,0300,Loans,-5.00\n")
    write(tmp_path / "b" / "x.csv",
          "tb_amount,account_name,account_code,period_code,company_code\n5.00,Cash,0100,Q1_2024,S\n")
    write(tmp_path / "a" / "TB[1].csv", TB_HEAD + "P,Q1_2024,0100,Cash,0.00\n")
    write(tmp_path / "a" / "TB{1}.csv", TB_HEAD + "P,Q1_2024,0100,Cash,0.00\n")
    write(tmp_path / "a" / "none.csv", TB_HEAD)
    upload = files.read_tb(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r.company_code, r.tb_amount) for r in upload.rows.where("file_name = 'x.csv'").collect()) == [
        ("P", D("-5.00")), ("P", D("5.00")), ("S", D("5.00"))
    ]
    got = sorted((r.tb_file_name, r.file_rows, r.reason) for r in store.import_tb(group_of_two(spark), upload).files.collect())
    assert got == [
        ("TB_1_.csv", 1, "same_name"), ("TB_1_.csv", 1, "same_name"), ("none.csv", 0, "no_rows"),
        ("x.csv", 1, "same_name"), ("x.csv", 2, "same_name"),
    ]


def test_parquet_files_are_judged_one_by_one(spark, tmp_path):
    good = spark.createDataFrame([("P", "Q1_2024", "0100", "Cash", "0.00")],
                                 "company_code string, period_code string, account_code string,"
                                 " account_name string, tb_amount string")
    bad = good.withColumnRenamed("tb_amount", "amount")
    text = good.withColumn("tb_amount", F.lit("n/a"))
    for name, df in {"good": good, "bad": bad, "text": text}.items():
        df.coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(part.read_bytes())
    load = store.import_tb(group_of_two(spark), files.read_tb(spark, str(tmp_path / "in"), "parquet"))
    assert verdicts(load) == {
        "good.parquet": (1, None), "bad.parquet": (None, "bad_header"), "text.parquet": (1, "unreadable_value")
    }


def test_an_import_is_stamped_and_stored_by_period(spark, tmp_path):
    books = group_of_two(spark)
    path = str(tmp_path / "tb")
    files.write_facts(books.trial_balance.withColumn("tb_date_create", F.lit(None).cast("timestamp_ntz")), path)
    stored = spark.read.parquet(path)
    before = rows(stored.where("period_code <> 'Q1_2024'"))
    (tmp_path / "up").mkdir()
    write(tmp_path / "up" / "new.csv", TB_HEAD + "P,Q1_2024,0100,Cash,5.00\nP,Q1_2024,0300,Loans,-5.00\n")
    kept = {p for p in (tmp_path / "tb").rglob("*.parquet") if "Q1_2024" not in str(p)}
    states = []
    for _ in range(2):
        at = datetime(2024, 1, 15, 10, 20)
        load = store.import_tb(
            group_of_two(spark, trial_balance=spark.read.parquet(path)), files.read_tb(spark, str(tmp_path / "up")), at
        )
        store.store_load(load, path)
        spark.catalog.refreshByPath(path)
        states.append(rows(spark.read.parquet(path)))
        new = spark.read.parquet(path).where("tb_file_name = 'new.csv'")
        assert new.count() == 2 and {r.tb_date_create for r in new.collect()} == {at}
    assert states[0] == states[1]
    assert rows(spark.read.parquet(path).where("period_code <> 'Q1_2024'")) == before
    assert kept <= set((tmp_path / "tb").rglob("*.parquet"))
