"""Every registered query runs; those with SQL give the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle import compare
from skarn.catalog import load

LARGER = SMALL.replace("sf0.001", "sf0.01")
QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    state, note = compare(spark, SMALL, key, QUERIES[key], ORACLES.get(key))
    if state == "EMPTY":  # nothing to compare in the smallest tables
        state, note = compare(spark, LARGER, key, QUERIES[key], ORACLES.get(key))
    assert state == "ok", (state, note)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
