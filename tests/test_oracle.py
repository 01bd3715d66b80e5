"""Every registered query against its SQL on the same parquet tables."""

import pytest

from checks.registry import ORACLES, QUERIES
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    assert compare(QUERIES[key](spark, FOLDER), con, ORACLES[key]) is None
