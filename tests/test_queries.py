"""Every registered query against its SQL on the small tables."""

import pytest
from oracle import compare, duck

from tablewright.plans import REGISTRY


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(n for n, p in REGISTRY.items() if p.sql is not None))
def test_query(name, spark, data, con):
    ok, note = compare(REGISTRY[name], spark, con, data)
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n, p in REGISTRY.items() if p.sql is None))
def test_query_without_sql_runs(name, spark, data):
    """Nothing is compared here; tests of the operators behind these queries do that."""
    assert not REGISTRY[name].run(spark, data).isEmpty()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 8
