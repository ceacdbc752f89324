from decimal import Decimal as D

import pytest
from small import COMPANY, FS_GROUP, TB, COA, group_of_two, rows

from ledgerfold.operators.shaping import column_codes, columns_last, label
from ledgerfold.plans.statements import (
    consolidate_by_company,
    mapped_fact,
    report,
    rpt_result,
    working,
    working_long,
)
from ledgerfold.schemas import ASSET, LABELS, LIABILITY, UNMAPPED


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def test_balance_sheet(spark):
    out = by_key(report(group_of_two(spark), "P", "Q1_2024"), "fs_group_name")
    # separate: the parent's trial balance and reclassification only
    assert out["Current assets"].separate_fs == D("120.00")
    assert out["Current assets"].consolidated_fs == D("153.00")
    assert out["Debt"].separate_fs == D("-80.00")
    assert out["Debt"].consolidated_fs == D("-75.00")
    assert out["Equity"].consolidated_fs == D("-33.00")
    assert out["Total"].consolidated_fs == D("45.00")
    assert out["Total"].account_type == ""


def test_profit_and_loss_turns_the_sign(spark):
    out = by_key(report(group_of_two(spark), "P", "Q1_2024", "pl"), "fs_group_name")
    assert out["Income"].separate_fs == D("40.00")
    assert out["Total"].consolidated_fs == D("40.00")


def test_rows_are_ordered_and_the_total_is_last(spark):
    out = report(group_of_two(spark), "P", "Q1_2024").collect()
    assert [r.fs_group_row for r in out] == ["F1", "F2", "F3", ""]


def test_two_accounts_in_one_working_group_count_once(spark):
    out = by_key(working(group_of_two(spark), "P", "Q1_2024"), "wk_group_name")
    assert out["Liquid"].P == D("120.00")  # 100 + 10 + 10
    assert out["Liquid"].S == D("30.00")
    assert out["Liquid"].total_separate == D("150.00")
    assert out["Liquid"].take_equity == D("3.00")
    assert out["Debt"].eliminate == D("5.00")
    assert out["Debt"].total_conso == D("-75.00")


def test_company_without_rows_still_has_its_column(spark):
    company = spark.createDataFrame(
        [("P", "P", "Parent", "P"), ("S", "S", "Subsidiary", "P"), ("T", "T", "Associate", "P")], COMPANY
    )
    out = working(group_of_two(spark, company=company), "P", "Q1_2024")
    assert "T" in out.columns
    assert {r["T"] for r in out.collect()} == {D("0.00")}


@pytest.mark.parametrize("missing", ["trial_balance", "interco", "journal_line"])
def test_missing_source_counts_as_zero(spark, missing):
    books = group_of_two(spark, **{missing: None})
    out = report(books, "P", "Q1_2024")
    assert out.columns[-2:] == ["separate_fs", "consolidated_fs"]
    assert len(working(books, "P", "Q1_2024").columns) == 10
    if missing == "trial_balance":
        assert by_key(out, "fs_group_name")["Current assets"].consolidated_fs == D("23.00")


def test_empty_sources_in_the_period_give_an_empty_report(spark):
    assert report(group_of_two(spark), "P", "Q2_2024").isEmpty()


def test_no_source_at_all_is_refused(spark):
    books = group_of_two(spark, trial_balance=None, interco=None, journal_line=None)
    with pytest.raises(ValueError):
        report(books, "P", "Q1_2024")


def test_codes_that_look_like_numbers_stay_text(spark):
    make = spark.createDataFrame
    books = group_of_two(
        spark,
        company=make([("00012", "A", "Parent", "00012")], COMPANY),
        coa=make([("00012", "0100", "Cash", 1, "01")], COA),
        fs_group=make([(1, "00012", "01", "Liquid", "001", "Assets", ASSET, ASSET)], FS_GROUP),
        trial_balance=make([("00012", "Q1_2024", "0100", D("1.00"), "f")], TB),
        interco=None,
        journal_line=None,
    )
    out = working(books, "00012", "Q1_2024", total=False)
    assert rows(out, "wk_group_row", "00012") == [("01", D("1.00"))]


def test_parent_outside_its_own_group_has_no_separate_figures(spark):
    company = spark.createDataFrame(
        [("P", "P", "Parent", None), ("S", "S", "Subsidiary", "P")], COMPANY
    )
    out = report(group_of_two(spark, company=company), "P", "Q1_2024")
    assert {r.separate_fs for r in out.collect()} == {D("0.00")}


def test_unmapped_rows_are_kept_in_both_reports(spark):
    tb = spark.createDataFrame([("P", "Q1_2024", "9999", D("4.00"), "f")], TB)
    books = group_of_two(spark, trial_balance=tb)
    assert by_key(report(books, "P", "Q1_2024"), "fs_group_name")[UNMAPPED].consolidated_fs == 4
    assert by_key(working(books, "P", "Q1_2024"), "wk_group_name")[UNMAPPED].P == 4


def test_a_group_without_a_name_is_not_the_total(spark):
    fs_group = spark.createDataFrame(
        [(1, "P", "W1", None, "F1", None, ASSET, ASSET), (2, "P", "W2", "Debt", "F2", "Debt", LIABILITY, LIABILITY)],
        FS_GROUP,
    )
    out = report(group_of_two(spark, fs_group=fs_group), "P", "Q1_2024").collect()
    assert [r.fs_group_name for r in out].count("Total") == 1


def test_intercompany_matrix(spark):
    out = rpt_result(group_of_two(spark), "P", "Q1_2024").collect()
    assert [(r.wk_group_name, r.rpt_interco_code, r.P, r.S, r.total_rpt) for r in out] == [
        ("Debt", "P", D("0.00"), D("5.00"), D("5.00")),
        ("Total", "", D("0.00"), D("5.00"), D("5.00")),
    ]


def test_all_groups_and_periods_at_once(spark):
    books = group_of_two(spark)
    every = report(books)
    one = report(books, "P", "Q1_2024")
    mine = every.where("parent_company = 'P' and period_code = 'Q1_2024'").drop("parent_company", "period_code")
    assert rows(mine) == rows(one)
    assert {r.parent_company for r in every.collect()} == {"P", "X"}


def test_long_and_wide_working_papers_agree(spark):
    books = group_of_two(spark)
    wide = by_key(working(books, "P", "Q1_2024"), "wk_group_name")
    for r in working_long(books, "P", "Q1_2024").collect():
        assert wide[r.wk_group_name][r.company_code] == r.total_separate


def test_any_number_of_companies_or_those_named(spark):
    books = group_of_two(spark)
    many = spark.range(2_500).selectExpr(
        "concat('M', id) as company_code", "'n' as company_name", "'Subsidiary' as company_type",
        "'P' as parent_company",
    )
    wide = group_of_two(spark, company=books.company.union(many))
    assert len(column_codes(wide.company.where("parent_company = 'P'"))) == 2_502
    out = working(wide, "P", "Q1_2024", companies=["S"])
    every = by_key(working(books, "P", "Q1_2024"), "wk_group_name")
    for r in out.collect():
        assert "P" not in out.columns
        assert r.S == every[r.wk_group_name].S
        assert r.total_conso == every[r.wk_group_name].total_conso


def test_one_fact_serves_several_reports(spark):
    books = group_of_two(spark)
    fact = mapped_fact(books, "P", "Q1_2024")
    assert rows(report(books, "P", "Q1_2024", fact=fact)) == rows(report(books, "P", "Q1_2024"))


def test_labels_and_column_order(spark):
    out = columns_last(report(group_of_two(spark), "P", "Q1_2024"), ["separate_fs", "absent"])
    assert out.columns[-1] == "separate_fs"
    assert "Separate FS" in label(out, LABELS["report"]).columns


def test_order_of_input_rows_does_not_matter(spark):
    books = group_of_two(spark)
    shuffled = group_of_two(
        spark,
        trial_balance=books.trial_balance.orderBy("tb_amount"),
        journal_line=books.journal_line.orderBy("credit"),
    )
    assert rows(report(books, "P", "Q1_2024")) == rows(report(shuffled, "P", "Q1_2024"))


def test_consolidated_total_is_the_sum_of_its_sources(spark):
    for r in consolidate_by_company(group_of_two(spark)).collect():
        assert r.total_conso == r.tb + r.rpt + r.recl + r.te
        assert r.total_separate == r.tb + r.recl
