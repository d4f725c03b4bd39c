"""The driver contract: entry() and every registered query against its DuckDB twin (sf0.001)."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not available")
def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "lang", "ttr"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not available")
def test_queries_match_oracle(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    res = compare(spark, SF, verbose=False)
    bad = {k: v for k, v in res.items() if not (v == "ok" or v.startswith("rows-only"))}
    assert not bad
