import pytest

from kinforge.llm.queries import ORACLES, QUERIES

from ..oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, small, name):
    assert_same(spark, small, QUERIES[name], ORACLES[name])
