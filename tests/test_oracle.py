"""Every registered query against its DuckDB counterpart."""

import pytest

import __spark_entry__ as entry
from checks.compare import connection, difference

QUERIES = {name: query for module in entry.LIBRARY for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in entry.LIBRARY for name, sql in module.ORACLES.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 10
