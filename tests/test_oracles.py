"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import duck, sparked

from lectern.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, name):
    assert sparked(registry.QUERIES[name](spark, DATA)) == duck(registry.ORACLES[name], DATA)
