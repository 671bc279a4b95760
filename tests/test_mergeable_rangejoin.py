"""Mergeable distinct counts and sketches, range joins by bins, runtime filters."""

import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import mergeable, quality
from tillroll.operators.rangejoin import range_join


def test_sets_count_exactly_and_merge(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(1, 6), rng.choice([None, -5, 0, 2**40, *range(70_000, 70_300)])) for _ in range(4000)]
    rows += [("c", 1, None), (None, 2, 7), (None, 2, 7)]
    df = spark.createDataFrame(rows, "name string, month int, id long")
    sets = mergeable.distinct_sets(df, ["name", "month"], "id")
    got = {(r.name, r.month): r.distinct_count for r in mergeable.set_sizes(sets, ["name", "month"]).collect()}
    members = {}
    for name, month, i in rows:
        if i is not None:
            members.setdefault((name, month), set()).add(i)
    assert got == {k: len(v) for k, v in members.items()}
    halves = mergeable.union_sets(sets, ["name", ((F.col("month") - 1) / 3).cast("int").alias("half")])
    got = {(r.name, r.half): r.distinct_count for r in mergeable.set_sizes(halves, ["name", "half"]).collect()}
    want = {}
    for (name, month), v in members.items():
        want.setdefault((name, (month - 1) // 3), set()).update(v)
    assert got == {k: len(v) for k, v in want.items()}


def test_coarser_sets_read_the_sets_only(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 12).alias("month"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/fact")
    kept = mergeable.distinct_sets(spark.read.parquet(f"{tmp_path}/fact"), ["month"], "v")
    kept.write.parquet(f"{tmp_path}/sets")
    sets = spark.read.parquet(f"{tmp_path}/sets")
    whole = mergeable.set_sizes(mergeable.union_sets(sets, []), [])
    assert "fact" not in whole._jdf.queryExecution().executedPlan().toString() and whole.first()[0] == 1000


def test_sketches_keep_their_bounds(spark):
    df = spark.range(200_000).select((F.col("id") % 6).alias("month"), (F.col("id") % 50_000).alias("who"),
                                     ((F.col("id") * 7919) % 200_000).cast("double").alias("price"))
    kept = mergeable.sketches(df, ["month"], "who", "price")
    assert kept.count() == 6
    whole = mergeable.estimates(mergeable.merge_sketches(kept, []), [], [0.1, 0.5, 0.9]).first()
    assert abs(whole.distinct_estimate / 50_000 - 1) < 4 * 1.04 / 2 ** (mergeable.LG_K / 2)
    for rank, found in zip((0.1, 0.5, 0.9), whole.quantiles):
        assert abs(found / 200_000 - rank) < 0.02
    for r in mergeable.estimates(kept, ["month"]).collect():
        exact = df.where(F.col("month") == r.month).select("who").distinct().count()
        assert abs(r.distinct_estimate / exact - 1) < 0.04


@pytest.mark.parametrize("unit", [1, 7])
def test_range_join_against_the_theta_join(spark, unit):
    rng = random.Random(unit)
    points = [(i, rng.choice([None, *range(-200, 3000)]), rng.choice("xy")) for i in range(300)]
    spans = []
    for i in range(200):
        lo = rng.choice([None, *range(-250, 3000)])
        spans.append((i, lo, None if lo is None or rng.random() < 0.05 else lo + rng.choice([-3, 0, 1, 2, 3, 4, 5, 8, 9, 100, 2500, 10**9]), rng.choice("xy")))
    p = spark.createDataFrame(points, "p int, at long, pk string")
    s = spark.createDataFrame(spans, "s int, lo long, hi long, sk string")
    theta = {(a[0], b[0]) for a in points for b in spans if None not in (a[1], b[1], b[2]) and b[1] <= a[1] < b[2]}
    found = range_join(p, s, "at", "lo", "hi", unit=unit)
    rows = [(r.p, r.s) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == theta
    keyed = range_join(p, s, "at", "lo", "hi", [("pk", "sk")], unit)
    assert {(r.p, r.s) for r in keyed.collect()} == {(a, b) for a, b in theta if points[a][2] == spans[b][3]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert range_join(p, s.where("false"), "at", "lo", "hi").isEmpty()


def test_runtime_filter_cuts_the_fact_before_its_shuffle(spark, tmp_path):
    spark.range(20_000).select((F.col("id") % 4000).alias("ticket"), F.when(F.col("id") % 997 != 0, F.col("id")).alias("price")).write.parquet(f"{tmp_path}/s")
    fact = spark.read.parquet(f"{tmp_path}/s")
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        shared = quality.rows_sharing_key(fact, "ticket", F.col("price").isNull())
        plan = shared._jdf.queryExecution().optimizedPlan().toString()
        large, _, small = plan.partition("Join LeftSemi")[2].partition(":  +- Relation")
        assert "might_contain" in large and "might_contain" not in small
        whole = quality.rows_sharing_key(fact, "ticket", F.col("price").isNull(), distinct_keys=True)
        assert shared.exceptAll(whole).isEmpty() and whole.exceptAll(shared).isEmpty()
    finally:
        for k in settings:
            spark.conf.unset(k)
