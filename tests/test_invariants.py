"""Identities that hold on the derived tables at any scale."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators.facts import long_fact
from ledgerfold.plans.statements import mapped_fact, report, working
from ledgerfold.sources.gates import zero_sum_gate
from registry.inputs import PARENT, PERIOD, books

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def b(spark):
    return books(spark, SF_DIR)


def totals(df, *names):
    return df.agg(*(F.sum(n) for n in names)).first()


def test_company_columns_add_up_to_the_separate_total(b):
    for r in working(b, PARENT, PERIOD).collect():
        assert sum(v for k, v in r.asDict().items() if k.startswith("C")) == r.total_separate


def test_balance_sheet_less_profit_and_loss_is_the_sources(b):
    bs = totals(report(b, PARENT, PERIOD, "bs", total=False), "consolidated_fs")[0]
    pl = totals(report(b, PARENT, PERIOD, "pl", total=False), "consolidated_fs")[0]
    assert bs - pl == totals(long_fact(b, PARENT, PERIOD), "amount")[0]


def test_statement_and_working_paper_agree_by_account_type(b):
    def by_type(df, column):
        return {r[0]: r[1] for r in df.groupBy("account_type").agg(F.sum(column)).collect()}

    assert by_type(report(b, PARENT, PERIOD, total=False), "consolidated_fs") == by_type(
        working(b, PARENT, PERIOD, total=False), "total_conso"
    )


def test_mapping_keeps_every_row(b):
    assert mapped_fact(b).count() == long_fact(b).count()


def test_every_trial_balance_file_sums_to_zero(b):
    assert zero_sum_gate(b.trial_balance).where("not accepted").isEmpty()
