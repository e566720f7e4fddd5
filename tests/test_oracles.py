"""Every registered query against its DuckDB twin on the smallest data."""

import pytest

from aligner.plans import registry
from scripts.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.all_queries(), registry.all_oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    state, info = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert state == "ok", info


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
