"""Plan-shape checks: the properties the reports rely on at scale."""

import os
import re

import pytest

from tillroll.operators import lifetime, ranking, stats
from tillroll.sources import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lifetime_spine_is_not_shuffled(spark):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    c, cv, o, d = (views.customer_dimension(spark, SF), views.conversions(spark, SF),
                   views.orders_fact(spark, SF), views.calendar(spark))
    p = plan(lifetime.customer_weekly_lifetime(c, cv, o, d, as_of="2001-W40"))
    lines = p.splitlines()
    gen = [i for i, line in enumerate(lines) if re.search("Generate (pos)?explode", line)]
    assert gen, p
    # Between the top of the plan and the explode there is no Exchange on the
    # spine's path: walk up from Generate through its ancestors.
    depth = len(lines[gen[0]]) - len(lines[gen[0]].lstrip(" :+-"))
    for line in reversed(lines[:gen[0]]):
        d_ = len(line) - len(line.lstrip(" :+-"))
        if d_ < depth:
            assert "Exchange" not in line, line
            depth = d_
    # the only nested-loop joins are against one-row sides (the cap bounds)
    for m in re.finditer(r"BroadcastNestedLoopJoin[^\n]*", p):
        assert "Cross" in m.group(0), m.group(0)


def test_histogram_and_price_history_read_the_fact_as_often_as_they_say(spark):
    s = spark.read.parquet(f"{SF}/lineitem.parquet")
    h = stats.equi_width_histogram(s, "l_quantity", 20)
    h.collect()
    assert len(re.findall(r"ReusedExchange", plan(h).split("Initial Plan")[0])) >= 1
    by_item = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_returnflag AS article", "l_quantity AS quantity", "l_extendedprice AS unit_price")
    ranked = by_item.limit(1).selectExpr("article AS item_name", "1 AS ranking")
    p = plan(ranking.price_breakdown(by_item, ranked))
    assert p.index("HashAggregate") < p.index("BroadcastHashJoin")  # the top items' lines alone are grouped


def test_exact_percentile_avoids_single_task_percentile(spark):
    s = views.sales_lines(spark, SF)
    p = plan(stats.summary_stats(s, "unit_price"))
    assert "percentile(" not in p


def test_rank_cutoff_uses_window_group_limit(spark):
    p = plan(ranking.top_items_by_month(views.sales_lines(spark, SF)))
    assert "WindowGroupLimit" in p


def test_scans_are_pruned(spark):
    p = plan(ranking.tickets_with_min_items(views.sales_lines(spark, SF), "1998-12-01", "1999-01-01"))
    li = re.search(r"lineitem.parquet[^\n]*ReadSchema: (struct<[^>]*>)", p)
    assert li and "l_shipdate" not in li.group(1) and "l_tax" not in li.group(1), p


def test_top_k_is_not_a_global_sort(spark):
    p = plan(ranking.top_ticket_lines(views.sales_lines(spark, SF), n=10))
    assert "TakeOrderedAndProject" in p
