"""Every registered query against its reference SQL on the smallest supplied tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from tidegate.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, sf_dir).count() > 0
        return
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
