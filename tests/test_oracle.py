"""Every registered query equals its DuckDB oracle at sf0.01 (rows, schema, values)."""

import pytest

import __spark_entry__ as E
from conftest import SF0001, SF001
from pdcspark.plans.catalog import QUERIES
from tools.check_oracle import compare_one, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.fixture(scope="module")
def con_small():
    return duck(SF0001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare_one(spark, con, name, SF001)
    assert ok, msg


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_sf0001(spark, con_small, name):
    ok, msg = compare_one(spark, con_small, name, SF0001)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "AvgPDC" in df.columns
