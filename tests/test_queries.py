"""Every registered query beside its DuckDB twin, on the smallest given tables."""

import os

import pytest
from oracle import connect, difference

from catalogops.queries import registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, name):
    df = REGISTRY.QUERIES[name](spark, SF_DIR)
    if name in REGISTRY.ORACLES:
        assert difference(df, con, REGISTRY.ORACLES[name]) is None
    else:
        assert df.count() > 0
