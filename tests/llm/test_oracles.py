"""Corpus queries against their DuckDB twins."""

import pytest

from aligner.llm import catalog
from scripts.check import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, name):
    state, info = compare(spark, connect(SF_DIR), name, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR)
    assert state == "ok", info
