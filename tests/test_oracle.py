"""Every registered query against DuckDB on the smallest sample."""

import pytest

import __spark_entry__ as registered
import oracle_queries
from check_oracle import compare, connect

QUERIES = registered.trip_queries()
ORACLES = oracle_queries.all_queries()
# Fitted results have no SQL.
WITHOUT_SQL = {
    "speed_gbt",
    "speed_gbt_flow",
    "speed_gbt_weather",
    "tip_gbt_regressor",
    "tip_rf_classifier",
}


@pytest.fixture(scope="session")
def duck(small):
    return connect(small)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, duck, name):
    rows, problem = compare(spark, duck, small, QUERIES[name], ORACLES[name])
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0
