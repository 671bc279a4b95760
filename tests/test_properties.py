"""Property tests against brute force (few examples: each runs Spark jobs)."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.operators import group_row_number, stats

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=300),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_percentiles_match_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = list(stats.exact_percentiles(df, "v", probs).first())
    want = np.percentile(np.array(values, dtype=float), [p * 100 for p in probs], method="linear")
    assert got == [pytest.approx(w, abs=1e-9) for w in want]


def _bucket(x, lo, hi, n):
    if hi == lo:
        return 1
    if x >= hi:
        return n + 1
    return int(Fraction(x - lo) * n / Fraction(hi - lo)) + 1


@SETTINGS
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=200), st.integers(1, 30))
def test_histogram_buckets_are_exact(spark, cents, bins):
    vals = [Decimal(c) / 100 for c in cents]
    df = spark.createDataFrame([(v,) for v in vals], "p decimal(12,2)")
    lo, hi = min(vals), max(vals)
    want = {}
    for v in vals:
        b = _bucket(v, lo, hi, bins)
        want[b] = want.get(b, 0) + 1
    got = {r.bucket: r.row_count for r in stats.equi_width_histogram(df, "p", bins).collect()}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.integers(0, 5)), min_size=1, max_size=150))
def test_group_row_number_is_row_number(spark, rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v int, i int")
    got = group_row_number(df, ["k"], ["v", "i"], "rn", partitions=3).collect()
    want = {}
    for k in {r[0] for r in rows}:
        members = sorted((v, i) for i, (kk, v) in enumerate(rows) if kk == k)
        for n, (_, i) in enumerate(members, 1):
            want[i] = n
    assert {r.i: r.rn for r in got} == want
