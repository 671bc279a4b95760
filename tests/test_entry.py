"""Driver contract: entry() smoke run, and every registered query against
its DuckDB oracle on the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
from oracle_compare import compare
from tillroll.plans import oracle, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["customer_id", "first_name", "last_name"]


def test_every_query_has_oracle_sql():
    # The text operators, when present, have tests of their own in tests/llm.
    assert set(registry.build()) == set(oracle.build())
    assert set(entry.queries()) >= set(registry.build())


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, list(registry.build()), verbose=False)
    bad = {k: v for k, v in res.items() if not v.get("ok")}
    assert not bad, bad
