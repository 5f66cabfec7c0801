"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_mod
from check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_mod.queries(), entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 250


def test_entry_runs(spark):
    assert entry_mod.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    """Queries without SQL must give rows; others must agree, an empty result only where SQL's is empty too."""
    status, n, info = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert status in ("ok", "near", "rows-only", "EMPTY"), info
    assert n > 0 or status == "EMPTY"
