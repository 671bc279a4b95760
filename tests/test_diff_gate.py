"""Table differences and the grain gate."""

import random
import re

import pytest
from pyspark.sql import functions as F

from test_lifetime import CAP, _frames
from test_lifetime_repeats import _dirty_frames
from tillroll.operators import diff, grain, lifetime
from tillroll.plans import customer360
from tillroll.sources.calendar import week_tables

SCHEMA = "k long, name string, amount decimal(18,2), at date"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _by_hand(left, right):
    out = []
    for r in {*left, *right}:
        more = left.count(r) - right.count(r)
        if more:
            out.append((*r, "left" if more > 0 else "right", abs(more)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaf_rows", [1, 50, 10**6])
def test_differences_against_counting(spark, leaf_rows):
    from decimal import Decimal
    rng = random.Random(4)
    left = [(rng.choice([None, *range(300)]), rng.choice("abc"), Decimal(rng.randint(0, 9)), None) for _ in range(2000)]
    right = list(left)
    rng.shuffle(right)
    for _ in range(12):  # changed, lost, doubled rows; two changes that make up for each other
        i = rng.randrange(len(right))
        right[i] = (right[i][0], right[i][1], right[i][2] + 1, right[i][3])
        j = rng.randrange(len(right))
        right[j] = (right[j][0], right[j][1], right[j][2] - 1, right[j][3])
        right.append(right[rng.randrange(len(right))])
        del right[rng.randrange(len(right))]
    found = diff.differing_rows(_table(spark, left), _table(spark, right).select("at", "amount", "name", "k"), ["k"], leaf_rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _by_hand(left, right)


def test_equal_and_empty_tables(spark):
    rows = [(1, "a", None, None), (1, "a", None, None), (None, None, None, None)]
    assert diff.differing_rows(_table(spark, rows), _table(spark, rows[::-1]), ["k", "name"]).isEmpty()
    assert diff.differing_rows(_table(spark, []), _table(spark, []), ["k"]).isEmpty()
    assert diff.differing_rows(_table(spark, rows), _table(spark, []), ["k"]).agg(F.sum("copies")).first()[0] == 3
    with pytest.raises(ValueError):
        diff.differing_rows(_table(spark, rows), _table(spark, rows).drop("at"), ["k"])


def test_few_ranges_are_left_at_depth(spark):
    left = spark.range(200_000).select("id", (F.col("id") * 2).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") == 777, 0).otherwise(F.col("v")))
    first = diff.differing_ranges(left, right, ["id"], 1).collect()
    assert len(first) == 1 and first[0]._rows < 2 * 2 * 200_000 / 1024
    second = diff.differing_ranges(left, right, ["id"], 2).collect()
    assert len(second) == 1 and second[0]._rows <= 10
    found = {(r.id, r.v, r.side) for r in diff.differing_rows(left, right, ["id"], leaf_rows=100).collect()}
    assert found == {(777, 1554, "left"), (777, 0, "right")}


@pytest.mark.parametrize("frames", [_frames, _dirty_frames])
def test_gate_counts_equal_the_separate_checks(spark, frames):
    customers, conversions, orders, dates = frames(spark)
    prepared = lifetime.prepare(customers, conversions, orders, dates)
    separate = {
        "conversion_has_one_order": grain.grain_violations(conversions, "conversion_id", "order_number", 1, "unique_orders"),
        "conversion_order_exists": grain.orphan_rows(conversions, orders, "order_number", ["conversion_id", "order_number"]),
        "first_order_in_first_conversion_week": grain.first_week_mismatch(conversions, orders, dates),
        "order_id_has_one_number": grain.grain_violations(orders, "order_id", "order_number", 1, "unique_order_number_count"),
    }
    report = customer360.gate_report(prepared, orders)
    assert {k: v["rows"] for k, v in report.items()} == {k: n for k, df in separate.items() if (n := df.count())}
    assert prepared.orphans == separate["conversion_order_exists"].count()
    for name, df in customer360.pair_checks(prepared.paired).items():
        assert df.exceptAll(separate[name].select(*df.columns)).isEmpty() and separate[name].select(*df.columns).exceptAll(df).isEmpty()


def test_gate_reads_no_fact_again(spark, tmp_path):
    customers, conversions, orders, dates = _frames(spark)
    for name, df in (("conversions", conversions), ("orders", orders)):
        df.write.parquet(f"{tmp_path}/{name}")
    conversions, orders = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("conversions", "orders"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = plan(lifetime.pair_orders(conversions, orders, week_tables(dates)[1]))
    assert len(re.findall(r"FileScan parquet", pairs)) == 2  # each fact once
    prepared = lifetime.prepare(customers, conversions, orders, dates)
    for df in customer360.pair_checks(prepared.paired).values():
        assert "FileScan" not in plan(df)


def test_strict_refresh_stops_before_it_builds(spark):
    customers, conversions, orders, dates = _frames(spark)
    with pytest.raises(ValueError):
        customer360.refresh_customer360(spark, customers, conversions, orders, dates, table="c360.strict_view", as_of=CAP, strict=True)
    assert not spark.catalog.tableExists("c360.strict_view")
    assert not [t for t in spark.catalog.listTables("c360") if "__work_" in t.name]


def test_a_difference_reads_each_table_twice(spark):
    """Once for digests, once for the rows of differing ranges; no shuffle of the tables."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(20_000).select("id", (F.col("id") * 2).alias("v"))
    left = rows.mapInArrow(counted, "id long, v long")
    right = rows.withColumn("v", F.when(F.col("id") % 4000 == 7, 0).otherwise(F.col("v")))
    found = diff.differing_rows(left, right, ["id"], leaf_rows=1).checkpoint(eager=True)
    assert found.count() == 10 and read.value == 2 * 20_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranges = diff.differing_ranges(left, right, ["id"], 2)
        plan = diff._in_ranges(rows, ranges, ["id"], 2, few=True)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
