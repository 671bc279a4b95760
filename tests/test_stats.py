import random

import numpy as np
import pytest

from conftest import D
from tillroll.operators import stats


def test_summary_stats_quartiles(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,), (None,)], "q int")
    r = stats.summary_stats(df, "q", "quantity").first()
    assert (r.non_null_rows, r.total_rows, r.min_quantity, r.max_quantity, r.total_quantity) == (4, 5, 1, 9, 16)
    assert r.avg_quantity == 4.0
    assert r.stddev_quantity == pytest.approx(3.5590260840104366, rel=1e-12)
    assert (r.q1_quantity, r.median_quantity, r.q3_quantity, r.iqr_quantity) == (1.75, 3.0, 5.25, 3.5)


def test_summary_stats_single_row_and_empty(spark):
    one = stats.summary_stats(spark.createDataFrame([(7,)], "q int"), "q").first()
    assert one.stddev_q is None and one.q1_q == 7.0 and one.iqr_q == 0.0
    none = stats.summary_stats(spark.createDataFrame([(None,)], "q int"), "q").first()
    assert none.non_null_rows == 0 and none.median_q is None


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_percentiles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    hot = rng.randint(0, 50)
    values = [hot] * 3000 + [rng.randint(-200, 200) for _ in range(6000)]  # a third on one value
    df = spark.createDataFrame([(v,) for v in values], "v int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = stats.exact_percentiles(df, "v", probs).first()
    want = np.percentile(np.array(values, dtype=float), [p * 100 for p in probs], method="linear")
    assert [pytest.approx(x) for x in want] == list(got)


def test_exact_percentiles_on_decimals(spark):
    df = spark.createDataFrame([(D("0.10"),), (D("0.20"),), (D("0.40"),)], "p decimal(12,2)")
    r = stats.exact_percentiles(df, "p", [0.25, 0.5], ["a", "b"]).first()
    assert r.a == pytest.approx(0.15) and r.b == pytest.approx(0.2)


def test_histogram_edges_and_constant_column(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (None,)], "x int")
    got = [(r.bucket, r.bucket_min, r.bucket_max, r.row_count)
           for r in stats.equi_width_histogram(df, "x", 20).collect()]
    assert got == [(1, 0, 0, 1), (11, 5, 5, 1), (21, 10, 10, 1)]
    const = spark.createDataFrame([(3,), (3,)], "x int")
    assert [(r.bucket, r.row_count) for r in stats.equi_width_histogram(const, "x").collect()] == [(1, 2)]


def test_histogram_decimal_edges_are_exact(spark):
    # (x - lo) * 20 / (hi - lo) lands exactly on integers: no float drift.
    vals = [D("0.00"), D("0.30"), D("0.60"), D("2.90"), D("6.00")]
    df = spark.createDataFrame([(v,) for v in vals], "p decimal(12,2)")
    got = {r.bucket_min: r.bucket for r in stats.equi_width_histogram(df, "p", 20).collect()}
    assert got == {D("0.00"): 1, D("0.30"): 2, D("0.60"): 3, D("2.90"): 10, D("6.00"): 21}


def test_histogram_counts_add_up(spark):
    rng = random.Random(7)
    vals = [rng.randint(-50, 400) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    h = stats.equi_width_histogram(df, "x", 20).collect()
    assert sum(r.row_count for r in h) == len(vals)
    assert all(1 <= r.bucket <= 21 for r in h)


def test_value_counts_highest_first_nulls_first(spark):
    df = spark.createDataFrame([(D("1.00"),), (None,), (D("2.00"),), (D("1.00"),)], "p decimal(12,2)")
    got = [(r.p, r.record_count) for r in stats.value_counts(df, "p").collect()]
    assert got == [(None, 1), (D("2.00"), 1), (D("1.00"), 2)]


def test_summary_stats_on_zero_rows(spark):
    r = stats.summary_stats(spark.createDataFrame([], "q int"), "q").first()
    assert (r.non_null_rows, r.total_rows, r.total_q, r.avg_q, r.median_q) == (0, 0, None, None, None)


def test_histogram_of_the_full_integer_ranges(spark):
    from tillroll.operators import stats
    for kind, top in (("int", 2 ** 31 - 1), ("long", 2 ** 63 - 1)):
        rows = [(-top - 1,), (0,), (top // 2,), (top,)]
        out = stats.equi_width_histogram(spark.createDataFrame(rows, f"x {kind}"), "x", bins=4).collect()
        assert [(r.bucket, r.row_count) for r in out] == [(1, 1), (3, 2), (5, 1)]
