"""Every registered query against its SQL on a whole small data set."""

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    rows = compare.spark_rows(QUERIES[name](spark, sf))
    assert rows[1]
    if name in ORACLES:
        assert compare.difference(rows, compare.duck_rows(con, ORACLES[name])) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert {r.feature for r in entry(spark).collect()} == {"complexity", "category", "table_count"}
