"""Every query against its SQL in DuckDB, from the same parquet files."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cargoframe.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, connect

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    assert compare(queries()[name](spark, sf), con, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
