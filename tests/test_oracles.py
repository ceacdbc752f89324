"""Every registered query against DuckDB over the same Parquet tables."""

import os

import pytest
from compare import differences, oracle

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = {
    name: query
    for part in (entry.statements, entry.loads, entry.journals, entry.admin, entry.stores, entry.checks)
    for name, query in part.QUERIES.items()
}


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == [
        "account_type",
        "account_subtype",
        "fs_group_row",
        "fs_group_name",
        "separate_fs",
        "consolidated_fs",
    ]
    assert not entry.entry(spark).isEmpty()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)
