from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F
from small import rows

from ledgerfold.operators import quality


def test_unique_exempts_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), ("b", 2)], "k string, n int")
    assert rows(quality.check_unique(df, ["k", "n"])) == [("a", 1, 2)]


def test_one_open(spark):
    df = spark.createDataFrame(
        [("P", "Q1", "Open"), ("P", "Q2", "Open"), ("S", "Q1", "Open"), ("S", "Q2", "Closed")],
        "company_code string, period_code string, period_status string",
    )
    assert rows(quality.check_one_open(df)) == [("P", 2)]


def test_orphans_ignore_null_pointers(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, fk int")
    parent = spark.createDataFrame([(10,), (10,)], "pk int")
    assert rows(quality.check_orphans(child, parent, {"fk": "pk"})) == [(3, 99)]


def test_domain(spark):
    df = spark.createDataFrame([("Open",), ("Shut",)], "period_status string")
    assert rows(quality.check_domain(df, "period_status", ["Open", "Closed"])) == [("Shut",)]


def test_range(spark):
    df = spark.createDataFrame(
        [(D("1"), None), (D("-0.01"), None), (D("0"), D("12345678901234.00"))],
        "debit decimal(20,2), credit decimal(20,2)",
    )
    assert quality.check_range(df).count() == 2


def test_required_names_every_fault(spark):
    df = spark.createDataFrame(
        [("P", "x"), ("TOOLONG", None)], "company_code string, account_name string"
    )
    out = quality.check_required(df, ["account_name"])
    assert rows(out, "company_code", "faults") == [("TOOLONG", "account_name,company_code")]


def test_balance_skips_blank_lines(spark):
    df = spark.createDataFrame(
        [("a", "1", D("0.10"), None), ("a", "1", D("0.20"), None), ("a", "2", None, D("0.30")),
         ("a", None, None, None), ("b", "1", D("1.00"), None)],
        "journal_no string, account_code string, debit decimal(15,2), credit decimal(15,2)",
    )
    assert rows(quality.check_balanced(df), "journal_no", "difference") == [("b", D("1.00"))]


def test_dates_are_only_needed_where_required(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), None)], "start_date date, end_date date")
    assert rows(quality.check_required(df, ["end_date"]).select(F.col("faults"))) == [("end_date",)]
