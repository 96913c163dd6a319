"""Every registered query of the linkage engine against DuckDB, or for a stable schema where SQL cannot say it."""

import pytest

from kinforge.plans import catalog

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, small, name):
    assert_same(spark, small, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    got = catalog.QUERIES[name](spark, small)
    assert got.count() > 0 and got.columns


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    got = entry.entry(spark)
    assert got.columns == ["s1_id", "matched_ids"] and got.count() == 100
