"""Every registered query against DuckDB on the driver tables."""

import pytest

from pulseframe.plans import registry

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, same, name):
    same(registry.QUERIES[name](spark, DATA), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
