"""Every registered query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences, duck
from conftest import TINY

from palimpsest.plans import problems, records, store

QUERIES = records.QUERIES | store.QUERIES | problems.QUERIES
SQL = records.SQL | store.SQL | problems.SQL


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    wrong, *_ = differences(spark, con, QUERIES[name], SQL[name], TINY)
    assert wrong is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TINY).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
