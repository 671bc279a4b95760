"""The lifetime table with its cap moved on, against a full build."""

import pytest
from pyspark.sql import functions as F

from test_lifetime import _day, _frames, _key
from test_lifetime_repeats import _dirty_frames
from tillroll.operators import advance, lifetime
from tillroll.plans import customer360
from tillroll.sinks import current_version, drop_result

OLD, NEW = "2021-W08", "2021-W10"


def _equal(a, b):
    b = b.select(*[F.col(c).cast(a.schema[c].dataType) for c in a.columns])
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _at(frames, cap):
    prepared = lifetime.prepare(*frames)
    return lifetime.lifetime_rows(prepared, cap).checkpoint(), advance.state_of(prepared, cap).checkpoint()


@pytest.mark.parametrize("frames", [_frames, _dirty_frames])
def test_advance_without_news_equals_a_full_build(spark, frames):
    frames = frames(spark)
    table, state = _at(frames, OLD)
    prepared = lifetime.prepare(*frames)
    changed = {r.ck for r in advance.changed_customers(state, prepared, OLD).collect()}
    assert changed == {r._ck for r in prepared.undated.where("conversion_id IS NOT NULL AND conversion_ord IS NULL").select("_ck").distinct().collect()}
    _equal(lifetime.lifetime_rows(prepared, NEW), advance.advance(table, state, prepared, OLD, NEW))
    _equal(lifetime.lifetime_rows(prepared, OLD), advance.advance(table, state, prepared, OLD, OLD))


def test_news_rebuild_their_customers_only(spark):
    customers, conversions, orders, dates = _frames(spark)
    table, state = _at((customers, conversions, orders, dates), OLD)
    late = orders.where("order_number = 1003").select(*[F.lit(1099).cast("long").alias(c) if c in ("order_id", "order_number") else c for c in orders.columns])
    this_week = orders.where("order_number = 6001").select(*[
        F.lit(_key("2021-03-03")).cast("long").alias(c) if c == "fk_order_date" else F.lit(6099).cast("long").alias(c) if c in ("order_id", "order_number") else c
        for c in orders.columns])
    converted = spark.createDataFrame([(899, 8, _key("2021-03-02"), _day("2021-03-02"), "T", "CH", 8001)], conversions.schema)
    person = spark.createDataFrame([(40, 40, "F40", "L40")], customers.schema)
    news = (customers.where("customer_id != 3").union(person), conversions.union(converted), orders.union(late).union(this_week), dates)
    prepared = lifetime.prepare(*news)
    changed = {r.ck for r in advance.changed_customers(state, prepared, OLD).collect()}
    # A late order, a new conversion, one who came and one who went; an order since the cap changes nothing.
    # Customer 7 has a conversion of unknown week.
    assert changed == {1, 8, 40, 3, 7}
    _equal(lifetime.lifetime_rows(prepared, NEW), advance.advance(table, state, prepared, OLD, NEW))
    with pytest.raises(ValueError):
        advance.advance(table, state, prepared, NEW, OLD)


def test_only_new_weeks_are_made(spark):
    frames = _frames(spark)
    table, state = _at(frames, OLD)
    prepared = lifetime.prepare(*frames)
    carried = state.where("weeks IS NOT NULL").select(F.col("ck").alias("_ck"), "conversion_id", F.col("weeks").alias("_weeks"), F.col("paid").alias("_paid"))
    made = lifetime.lifetime_rows(prepared, NEW, since=OLD, carried=carried).where("order_week IS NOT NULL")
    assert {r.order_week for r in made.select("order_week").distinct().collect()} == {"2021-W08", "2021-W09"}
    assert made.count() < table.count()


def test_table_keeps_its_state(spark):
    frames = _frames(spark)
    name = "c360.advancing"
    for cap in (OLD, "2021-W09", NEW):
        customer360.advance_customer360(spark, *frames, table=name, as_of=cap)
        _equal(spark.table(name), lifetime.customer_weekly_lifetime(*frames, as_of=cap).select(*lifetime.SINK_COLUMNS))
        assert spark.table(f"{name}__state").first().version == current_version(spark, name)
    # After a refresh by other means the state is not trusted.
    customer360.refresh_customer360(spark, *frames, table=name, variant="open", as_of=NEW)
    customer360.advance_customer360(spark, *frames, table=name, as_of=NEW)
    _equal(spark.table(name), lifetime.customer_weekly_lifetime(*frames, as_of=NEW).select(*lifetime.SINK_COLUMNS))
    drop_result(spark, name)
    drop_result(spark, f"{name}__state")


def _above(plan, leaf):
    """The lines of a plan's tree that lie above the first one with ``leaf``, from below."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if leaf in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, least = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < least:
            above.append(line)
            least = depth(line)
    return above


def test_kept_rows_are_neither_shuffled_nor_cast(spark):
    frames = _frames(spark)
    name = "c360.kept"
    customer360.advance_customer360(spark, *frames, table=name, as_of=OLD)
    stored = spark.table(name)
    rows = advance.advance(stored, spark.table(f"{name}__state"), lifetime.prepare(*frames), OLD, NEW)
    assert [f.dataType for f in rows.schema if f.name in lifetime.RUNNING] == [stored.schema[c].dataType for c in lifetime.RUNNING]
    above = _above(rows._jdf.queryExecution().executedPlan().toString(), current_version(spark, name).rpartition(".")[2])
    assert any("BroadcastHashJoin" in line and "LeftAnti" in line for line in above), above
    assert not [line for line in above if "Exchange" in line or "SortMergeJoin" in line or "as decimal" in line], above
    _equal(lifetime.lifetime_rows(lifetime.prepare(*frames), NEW), rows)
    drop_result(spark, name)
    drop_result(spark, f"{name}__state")


def test_more_changed_customers_than_are_broadcast(spark, monkeypatch):
    frames = _frames(spark)
    table, state = _at(frames, OLD)
    customers, conversions, orders, dates = frames
    late = orders.withColumn("order_number", F.col("order_number") + 50000).withColumn("price_paid", F.col("price_paid") + 1)
    prepared = lifetime.prepare(customers, conversions, orders.union(late), dates)
    monkeypatch.setattr(advance, "CHANGED_BROADCAST_LIMIT", 0)
    rows = advance.advance(table, state, prepared, OLD, NEW)
    _equal(lifetime.lifetime_rows(prepared, NEW), rows)


@pytest.mark.parametrize("frames", [_frames, _dirty_frames])
def test_figures_get_the_types_of_the_table_before_the_weeks_are_made(spark, frames):
    prepared = lifetime.prepare(*frames(spark))
    types = lifetime.stored_types(lifetime.sink_schema())
    assert types == dict.fromkeys(lifetime.AMOUNTS[1:] + lifetime.RUNNING, "decimal(18,2)")
    rows, plain = lifetime.lifetime_rows(prepared, NEW, types=types), lifetime.lifetime_rows(prepared, NEW)
    assert {rows.schema[c].dataType.simpleString() for c in types} == {"decimal(18,2)"}
    assert {plain.schema[c].dataType.simpleString() for c in lifetime.RUNNING} == {"decimal(38,2)"}
    _equal(rows, plain)
    above = _above(rows._jdf.queryExecution().optimizedPlan().toString(), "Generate explode")
    assert not [line for line in above if "as decimal" in line], above


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_figure_too_large_for_its_column_fails(spark, ansi):
    customers, conversions, orders, dates = _frames(spark)
    orders = orders.withColumn("price_paid", F.lit("9999999999999999.99").cast(orders.schema["price_paid"].dataType))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = lifetime.lifetime_rows(lifetime.prepare(customers, conversions, orders, dates), NEW, types=lifetime.stored_types(lifetime.sink_schema()))
        with pytest.raises(Exception, match="cannot hold"):
            rows.collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_query_reads_the_table_from_its_files(spark, tmp_path):
    """lifetime_advanced: no copy of the table beside it, and no table left."""
    from tillroll.plans import registry

    spark.range(40).selectExpr("id AS c_custkey", "concat('N', id) AS c_name", "'S' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2000).selectExpr(
        "id AS o_orderkey", "id % 37 AS o_custkey", "'O' AS o_orderstatus", "double(id % 90) AS o_totalprice",
        "cast(date_add(date'1995-02-01', int(id * 7 % 2400)) AS timestamp_ntz) AS o_orderdate",
        "if(id % 5 = 0, '1-URGENT', '5-LOW') AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.build()["lifetime_advanced"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert not [t.name for t in spark.catalog.listTables("tillroll_reports") if t.name.startswith("full_360")]
    full = registry.build()["lifetime_capped"](spark, str(tmp_path))
    _equal(full, found)
