from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F
from small import group_of_two, rows

from ledgerfold.functions import (
    as_money,
    contains_ci,
    money_text,
    percent_text,
    row_sum,
    time_text,
)
from ledgerfold.operators.scope import any_equals, on_day, scope
from ledgerfold.operators.shaping import first_n, has_rows, sorted_by
from ledgerfold.plans import admin, listings
from ledgerfold.sources.books import Books


def test_one_character_filters_are_ignored(spark):
    company = group_of_two(spark).company
    assert any_equals(company, {"company_code": "P", "company_name": ""}).count() == 3
    assert any_equals(company, {"company_code": "P", "company_name": "Sub Co"}).count() == 2


def test_group_size_is_null_without_a_parent(spark):
    company = spark.createDataFrame(
        [("P", "P"), ("S", "P"), ("N", None)], "company_code string, parent_company string"
    )
    assert rows(admin.company_count(company), "company_code", "company_count") == [
        ("N", None),
        ("P", 2),
        ("S", 2),
    ]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("10% off",), ("100 off",), ("A_B",), ("AxB",), ("c\\d",)], "t string")
    assert rows(df.where(contains_ci("t", "10%"))) == [("10% off",)]
    assert rows(df.where(contains_ci("t", "a_b"))) == [("A_B",)]
    assert rows(df.where(contains_ci("t", "\\"))) == [("c\\d",)]


def test_scope_keeps_the_group_only(spark):
    b = group_of_two(spark)
    assert scope(b.trial_balance, b.company, "P").count() == 6


def log_books(spark):
    make = spark.createDataFrame
    return Books(
        admin_log=make(
            [
                (1, datetime(2024, 1, 31, 23, 59, 59, 999999), 7, 0, "o", "Cash", 1, "added"),
                (2, datetime(2024, 2, 1), 7, 5, "o", "Bank", 1, "changed"),
                (3, datetime(2024, 12, 31, 1, 2, 3), 9, 0, "o", "Loan", 1, "added"),
            ],
            "id bigint, action_time timestamp_ntz, user_id bigint, content_type_id int, object_id string,"
            " object_repr string, action_flag int, change_message string",
        ),
        content_type=make([(0, "fin", "coa")], "content_type_id int, app_label string, model string"),
        user=make(
            [(7, "u7", "A", "B")], "user_id bigint, username string, first_name string, last_name string"
        ),
    )


def test_log_report_of_a_day(spark):
    b = log_books(spark)
    assert rows(admin.admin_log_report(b, "2024-01-31"), "id", "action_date", "action_time", "model") == [
        (1, "2024-01-31", "23:59:59", "coa")
    ]
    assert admin.admin_log_report(b, "").count() == 3
    assert rows(admin.admin_log_report(b, username="u7"), "id") == [(1,), (2,)]


def test_a_day_is_the_same_in_every_time_zone(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Bangkok", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out = admin.admin_log_report(log_books(spark), "2024-02-01")
            assert rows(out, "id", "action_time") == [(2, "00:00:00")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_log_drill_down(spark):
    b = log_books(spark)
    assert rows(admin.search_log(b, year=2024, month=12), "id") == [(3,)]
    assert rows(admin.search_log(b, year=2024), "id") == [(1,), (2,), (3,)]
    assert rows(admin.search_log(b, year=2024, month=2, day=1, text="BANK"), "id") == [(2,)]
    assert rows(admin.search_log(b, user_id=7, content_type_id=0), "id") == [(1,)]


def test_day_filter_reaches_the_reader(spark, tmp_path):
    path = str(tmp_path / "log")
    log_books(spark).admin_log.write.parquet(path)
    plan = on_day(spark.read.parquet(path), "action_time", "2024-02-01")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(action_time" in plan and "LessThan(action_time" in plan


def test_journal_search_combines_filters(spark):
    b = group_of_two(spark)
    assert listings.journal_summary(b, "TakeEq", "P", journal_no="jv_00002").count() == 1
    assert listings.journal_summary(b, "TakeEq", "P", journal_no="00001").isEmpty()


def test_listings_of_a_parent(spark):
    b = group_of_two(spark)
    assert listings.coa_summary(b, "P").count() == 12
    assert listings.coa_summary(b, "P", company_code="S", account_name="cas").count() == 1
    assert listings.fs_group_summary(b, "P", fs_group_name="DEBT").count() == 1
    assert rows(listings.current_period(b, "P"), "period_code") == [("Q1_2024",)]
    assert rows(listings.search_periods(b, "q4", "P"), "period_code") == [("Q4_2023",)]


def test_sorting_and_first_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a")], "n int, t string")
    assert [tuple(r) for r in sorted_by(df, "-n", "t").collect()] == [(2, "a"), (2, "b"), (1, "a")]
    assert first_n(df, ["n", "t"], 1).first().n == 1
    assert has_rows(df) and not has_rows(df.where("n > 5"))


def test_row_sum_skips_nulls_over_many_columns(spark):
    names = [f"c{i}" for i in range(1500)]
    df = spark.range(1).selectExpr(
        *(f"cast({'null' if i % 2 else '1.25'} as decimal(15,2)) as {n}" for i, n in enumerate(names))
    )
    assert df.select(row_sum(*names)).first()[0] == D("937.50")


def test_display_forms(spark):
    df = spark.createDataFrame([("1234567.5", 99.5, datetime(2024, 1, 2, 3, 4, 5, 678))], "m string, r double, t timestamp_ntz")
    out = df.select(
        money_text(as_money("m")), percent_text("r"), time_text("t"), as_money(F.lit("n/a"))
    ).first()
    assert tuple(out) == ("1,234,567.50", "99.50 %", "03:04:05", None)
