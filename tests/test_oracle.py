"""Every registered query against the independent engine, on the whole tables."""

import pytest

import __spark_entry__ as entry_points
from tablework.queries import ORACLE, QUERIES
from tests.compare import difference, oracle


@pytest.fixture(scope="module")
def connection(folder):
    return oracle(folder)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_oracle(spark, folder, connection, name):
    assert difference(QUERIES[name](spark, folder), ORACLE[name], connection) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert entry_points.queries().keys() >= entry_points.oracle_sql().keys()


def test_flagship_levels(spark, folder):
    levels = QUERIES["entity_summary"](spark, folder).groupBy("hierarchy_level").count().collect()
    assert {r[0]: r[1] for r in levels} == {
        "Standalone": 326,
        "Ultimate Parent": 64,
        "Subsidiary": 770,
        "Unknown": 218,
    }
