from decimal import Decimal as D

import pytest
from small import HEADER, LINE, group_of_two, rows

from ledgerfold.operators import journals as jv
from ledgerfold.operators import quality
from ledgerfold.operators.mapping import journal_facts, outer_on_group, with_wk_group
from ledgerfold.operators.numbering import number_within
from ledgerfold.plans import listings

BATCH = "k bigint, period_code string, parent_company_code string, company_code string, journal_type string"
BATCH_LINE = "k bigint, account_code string, debit decimal(15,2), credit decimal(15,2)"


def test_numbers_run_on_across_buckets_and_blocks(spark):
    keys = [5, 7, 2**20 - 1, 2**20, 2**20 + 3, 2**42 - 1, 2**42, 2**42 + 9, 2**60, -1, -(2**50)]
    df = spark.createDataFrame(
        [("a", k) for k in keys] + [("b", 2**42), ("b", 1)], "g string, k bigint"
    )
    out = rows(number_within(df, ["g"], "k", "n"), "g", "k", "n")
    expected = [("a", k, i + 1) for i, k in enumerate(sorted(keys))] + [("b", 1, 1), ("b", 2**42, 2)]
    assert sorted(out) == sorted(expected)


def test_a_null_group_is_numbered_too(spark):
    df = spark.createDataFrame([(None, 2**45), (None, 3), ("a", 1)], "g string, k bigint")
    assert rows(number_within(df, ["g"], "k", "n")) == [(None, 3, 1), (None, 2**45, 2), ("a", 1, 1)]


def test_one_group_of_many_rows_is_numbered_in_bounded_windows(spark):
    n = 50_000
    df = spark.range(n).selectExpr("'hot' as g", "id * 100000007 as k")
    out = number_within(df, ["g"], "k", "n").selectExpr(
        "count(*)", "max(n)", "count(distinct n)", "sum(case when k <> (n - 1) * 100000007 then 1 else 0 end)"
    ).first()
    assert tuple(out) == (n, n, n, 0)


def batch(spark):
    headers = spark.createDataFrame(
        [(k, "Q1_2024", "P", "P", None) for k in (11, 12, 13, 14)], BATCH
    )
    lines = spark.createDataFrame(
        [
            (11, "0100", D("5.00"), None),
            (11, "0300", None, D("5.00")),
            (12, "0100", D("5.00"), None),
            (12, "0300", None, D("4.99")),
            (13, None, None, None),
            (14, "0100", D("0.10"), None),
            (14, "0100", D("0.20"), None),
            (14, "0300", None, D("0.30")),
            (14, None, None, None),
        ],
        BATCH_LINE,
    )
    return headers, lines


def test_posting_is_whole_or_not_at_all(spark):
    headers, lines = batch(spark)
    posted = jv.post_journals(headers, lines, group_of_two(spark).journal_header, "k", "Reclassify")
    assert rows(posted.headers, "k", "journal_no", "journal_type") == [
        (11, "P_JV_00003", "Reclassify"),
        (14, "P_JV_00004", "Reclassify"),
    ]
    assert rows(posted.rejected, "k", "reason") == [(12, jv.UNBALANCED), (13, jv.EMPTY)]
    assert rows(posted.lines, "journal_no", "journal_amount") == [
        ("P_JV_00003", D("-5.00")),
        ("P_JV_00003", D("5.00")),
        ("P_JV_00004", D("-0.30")),
        ("P_JV_00004", D("0.10")),
        ("P_JV_00004", D("0.20")),
    ]


@pytest.mark.parametrize(
    "existing, first",
    [([], "P_JV_00001"), (["P_JV_99999", "P_JV_100000"], "P_JV_100001"), (["X_JV_00007"], "P_JV_00001")],
)
def test_numbering_compares_numbers_not_text(spark, existing, first):
    headers = spark.createDataFrame(
        [(no, "Q", no.split("_")[0], "P", "TakeEq") for no in existing], HEADER
    )
    new = spark.createDataFrame([(1, "Q", "P", "P", "TakeEq")], BATCH)
    assert jv.number_journals(headers, new, "k").first().journal_no == first


def test_update_replaces_balanced_journals_only(spark):
    lines = group_of_two(spark).journal_line.selectExpr("*", "cast(0 as decimal(15,2)) as journal_amount")
    again = spark.createDataFrame(
        [
            ("P_JV_00001", "0100", D("1.00"), None),
            ("P_JV_00001", "0300", None, D("1.00")),
            ("P_JV_00002", "0200", D("1.00"), None),
        ],
        LINE,
    )
    out = jv.update_journals(lines, again)
    assert out.where("journal_no = 'P_JV_00001'").count() == 2
    assert rows(out.where("journal_no = 'P_JV_00002'"), "debit", "credit") == [
        (D("3.00"), None),
        (None, D("3.00")),
    ]


def test_headers_without_lines_are_kept(spark):
    b = group_of_two(spark)
    only = b.journal_line.where("journal_no = 'P_JV_00001'")
    out = journal_facts(b.journal_header, only)
    assert out.count() == 4
    assert rows(out.where("account_code is null"), "journal_no") == [("P_JV_00002",)]


def test_detail_and_totals(spark):
    out = listings.journal_detail(group_of_two(spark), "P_JV_00001")
    assert {(r.sum_debit, r.sum_credit) for r in out.collect()} == {(D("20.00"), D("20.00"))}
    assert out.count() == 3


def test_scope_rules(spark):
    b = group_of_two(spark)
    headers = spark.createDataFrame(
        [("J1", "Q4_2023", "P", "P", "TakeEq"), ("J2", "Q1_2024", "P", "X", "TakeEq")], HEADER
    )
    lines = spark.createDataFrame([("J2", "0999", D("1"), None), ("J2", "0999", D("1"), None)], LINE)
    out = quality.check_journal_scope(headers, lines, b.period, b.company, b.coa)
    assert rows(out) == [
        ("J1", "period_code", "Q4_2023"),
        ("J2", "account_code", "0999"),
        ("J2", "company_code", "X"),
    ]


def test_full_outer_on_groups_matches_missing_groups(spark):
    keys = "wk_group_row string, wk_group_name string, fs_group_row string, fs_group_name string, account_type string, account_subtype string"
    left = spark.createDataFrame([("W", "w", "F", "f", "t", "s", 1), (None,) * 6 + (2,)], keys + ", a int")
    right = spark.createDataFrame([(None,) * 6 + (3,), ("V", "v", "F", "f", "t", "s", 4)], keys + ", b int")
    out = outer_on_group(left, right)
    assert rows(out, "wk_group_row", "a", "b") == [(None, 2, 3), ("V", None, 4), ("W", 1, None)]


def test_working_group_comes_from_the_chosen_group(spark):
    b = group_of_two(spark)
    out = with_wk_group(b.coa.where("company_code = 'P'").drop("wk_group_row"), b.fs_group)
    assert ("0300", "W2") in rows(out, "account_code", "wk_group_row")
