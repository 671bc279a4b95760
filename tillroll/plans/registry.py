"""Registered queries: one per job of the original scripts, run on the
fixture views of a scale-factor directory.

Each entry is ``fn(spark, base_dir) -> DataFrame``. Results go through
``present`` so that a DuckDB oracle can produce byte-equal values:
DECIMAL -> DOUBLE (the exact decimal result, converted once at the end),
DATE and TIMESTAMP -> ISO text, and floating statistics rounded to 4
places. The library functions themselves return the native types.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import diff, grain, lifetime, mergeable, pricing, quality, rangejoin, ranking, stats
from tillroll.plans import customer360
from tillroll.plans.price_history import price_history
from tillroll.session import ensure_checkpoint_dir
from tillroll.sinks import create_table, drop_result, refresh_table, snapshot
from tillroll.sources import calendar, views
from tillroll.sources.tables import materialize

# Fixed arguments of the registered queries (FIXTURES.md "Fixed arguments"
AS_OF_WEEK = "2001-W40"
DEC_1998 = ("1998-12-01", "1999-01-01")
MIN_ITEMS = 5
PEAK_ITEM, PEAK_MONTH = "purchase", 1
TICKET = 100
TICKET_RANGE = (1000, 1010)
ITEM = "hot ring"
HISTORY_ITEM = "blue rod"
HIGH_PRICE = 100000
LAST_DAY = 11688  # spine_by_dates: 2002-01-01, the day after the calendar, in days since 1970
LATE_MODULUS = 211  # lifetime_advanced: orders and conversions that come a week late
WEEK_BEFORE = "2001-W39"
SKETCH_ERROR = 0.05  # sketches_by_quarter: the error that the figures are held to
MOVED_MODULUS = 97  # lifetime_diff: customers with faults in the second table
DUPLICATE_COLS = ["ticket_number", "sale_date", "article"]
SIX_COLS = ["ticket_number", "sale_date", "sale_time", "article", "quantity", "unit_price"]
PROFILE_COLS = ["ticket_number", "sale_date", "sale_datetime", "article", "quantity", "unit_price"]

Query = Callable[[SparkSession, str], DataFrame]


# Integer columns that hold NULLs in the registered results (ids of
# customers without a conversion). pandas turns a nullable BIGINT into
# float64 on the Spark side and into Int64 on the DuckDB side, so both
# engines present these as DOUBLE (exact below 2**53).
NULLABLE_INT_COLS = ("conversion_id", "order_number")


def present(df: DataFrame, round_cols: tuple[str, ...] = (),
            double_cols: tuple[str, ...] = ()) -> DataFrame:
    """Comparison-friendly types: see the module docstring."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in double_cols:
            c = c.cast("double")
        elif f.name in round_cols:
            c = F.round(c.cast("double"), 4)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _sales(spark, base):
    return views.sales_lines(spark, base)


def _dirty(spark, base):
    return views.sales_dirty(spark, base)


def _timed(spark, base):
    return views.timed_sales(spark, base)


def _star(spark, base):
    return (views.customer_dimension(spark, base), views.conversions(spark, base),
            views.orders_fact(spark, base), views.calendar(spark))


def _dirty_star(spark, base):
    """The star with repeated and missing keys."""
    return (views.customers_shared(spark, base), views.conversions_repeated(spark, base),
            views.orders_renumbered(spark, base), views.calendar(spark))


def _lifetime(variant, star=_star, as_of=AS_OF_WEEK):
    def run(spark, base):
        c, cv, o, d = star(spark, base)
        return lifetime.customer_weekly_lifetime(c, cv, o, d, as_of=as_of, variant=variant)
    return run


def _stat_cols(name):
    return tuple(f"{p}_{name}" for p in ("avg", "stddev", "q1", "median", "q3", "iqr"))


def build() -> dict[str, Query]:
    q: dict[str, Query] = {}

    # --- sales script: ranking -------------------------------------------
    q["top_items_by_month"] = lambda s, b: ranking.top_items_by_month(_sales(s, b), n=3)
    q["tickets_min_items"] = lambda s, b: ranking.tickets_with_min_items(
        _sales(s, b), *DEC_1998, min_items=MIN_ITEMS)
    q["peak_hour"] = lambda s, b: ranking.peak_hour(_timed(s, b), PEAK_ITEM, PEAK_MONTH)
    q["best_two_hours"] = lambda s, b: ranking.best_adjacent_hours(_timed(s, b))
    q["revenue_by_month"] = lambda s, b: ranking.revenue_by_month(_sales(s, b))
    q["top_ticket_lines"] = lambda s, b: ranking.top_ticket_lines(_sales(s, b), n=10)
    q["top_items_price_breakdown"] = lambda s, b: ranking.top_items_price_breakdown(_sales(s, b), n=20)

    # --- sales script: quality -------------------------------------------
    q["null_profile"] = lambda s, b: quality.null_profile(_dirty(s, b), PROFILE_COLS)
    q["null_price_context"] = lambda s, b: quality.rows_sharing_key(
        _dirty(s, b), "ticket_number", F.col("unit_price").isNull())
    q["duplicate_lines"] = lambda s, b: quality.duplicate_groups(_sales(s, b), DUPLICATE_COLS)
    q["null_profile_timed"] = lambda s, b: quality.null_profile(views.timed_dirty(s, b), SIX_COLS)
    q["duplicate_rows"] = lambda s, b: quality.duplicate_groups(views.timed_dirty(s, b), SIX_COLS)
    q["ticket_lines"] = lambda s, b: quality.drill_down(
        _sales(s, b), F.col("ticket_number") == TICKET, ["article"])
    q["negative_qty"] = lambda s, b: quality.drill_down(_sales(s, b), F.col("quantity") < 0)
    q["ticket_range"] = lambda s, b: quality.drill_down(
        _sales(s, b), F.col("ticket_number").between(*TICKET_RANGE))
    q["low_price"] = lambda s, b: quality.drill_down(
        _dirty(s, b), F.col("unit_price") <= 0, ["unit_price", "ticket_number"])
    q["item_lines"] = lambda s, b: quality.drill_down(_sales(s, b), F.col("article") == ITEM)
    q["high_price"] = lambda s, b: quality.drill_down(_sales(s, b), F.col("unit_price") >= HIGH_PRICE)
    q["item_history"] = lambda s, b: quality.drill_down(
        _sales(s, b), F.col("article") == HISTORY_ITEM, ["sale_datetime"],
        cols=["sale_datetime", "ticket_number", "article", "quantity", "unit_price"])
    q["datetime_mismatch"] = lambda s, b: quality.datetime_mismatch_count(_timed(s, b))

    # --- sales script: statistics ----------------------------------------
    q["qty_stats"] = lambda s, b: present(
        stats.summary_stats(_sales(s, b), "quantity"), _stat_cols("quantity"))
    q["price_stats"] = lambda s, b: present(
        stats.summary_stats(_sales(s, b), "unit_price"), _stat_cols("unit_price"))
    q["qty_histogram"] = lambda s, b: stats.equi_width_histogram(_sales(s, b), "quantity", 20)
    q["price_histogram"] = lambda s, b: stats.equi_width_histogram(
        _sales(s, b), "unit_price", 20, count_name="record_count")
    q["price_counts"] = lambda s, b: stats.value_counts(_dirty(s, b), "unit_price")

    # --- distinct counts and quantiles kept by month ------------------------
    def periods():  # columns need a session, which this function must not
        return F.trunc("sale_date", "month"), F.trunc("month", "quarter")

    def tickets_q(s, b, coarse: bool):
        month, quarter = periods()
        sets = mergeable.distinct_sets(_sales(s, b), [month.alias("month"), "article"], "ticket_number")
        if coarse:  # from the months' sets, not from the sales
            sets = mergeable.union_sets(sets, [quarter.alias("month"), "article"])
        return mergeable.set_sizes(sets, ["month", "article"], "unique_tickets").withColumnRenamed("month", "period_start")

    q["distinct_tickets_by_month"] = lambda s, b: tickets_q(s, b, False)
    q["distinct_tickets_by_quarter"] = lambda s, b: tickets_q(s, b, True)

    def sketch_q(s, b):
        """Quarters from months' sketches, beside the exact figures."""
        month, quarter = periods()
        sales = _sales(s, b).where("unit_price IS NOT NULL")
        kept = mergeable.sketches(sales, [month.alias("month")], "ticket_number", "unit_price")
        found = mergeable.estimates(mergeable.merge_sketches(kept, [quarter.alias("period_start")]), ["period_start"], [0.5])
        exact = mergeable.set_sizes(mergeable.union_sets(
            mergeable.distinct_sets(sales, [month.alias("month")], "ticket_number"), [quarter.alias("period_start")]), ["period_start"], "unique_tickets")
        # The share of prices up to the estimated median, which should be one half.
        median = found.select(F.col("period_start").alias("_q"), F.col("quantiles")[0].alias("_median"))
        below = (sales.join(median, F.trunc("sale_date", "quarter") == F.col("_q")).groupBy("_q")
                 .agg(F.avg((F.col("unit_price").cast("double") <= F.col("_median")).cast("int")).alias("_below")))
        return (exact.join(found, "period_start").join(below, F.col("period_start") == F.col("_q"))
                .select("period_start", "unique_tickets",
                        (F.abs(F.col("distinct_estimate") / F.col("unique_tickets") - 1) < SKETCH_ERROR).alias("count_within_bound"),
                        (F.abs(F.col("_below") - 0.5) < SKETCH_ERROR).alias("median_within_bound")))

    q["sketches_by_quarter"] = sketch_q

    # --- sales script: pricing -------------------------------------------
    q["price_changes"] = lambda s, b: pricing.price_changes(_sales(s, b))
    q["price_effective_months"] = lambda s, b: price_history(_sales(s, b), n=20)

    def price_table_q(s, b):
        # S23 materialised as a session table, then S24 reads it back.
        snapshot(pricing.price_changes(_sales(s, b)), "price_table")
        return s.table("price_table")

    q["price_table"] = price_table_q

    # --- customer 360: grain checks --------------------------------------
    q["order_grain"] = lambda s, b: grain.grain_violations(
        views.order_products(s, b), "order_number", "fk_product", 1, "unique_products_count")
    q["order_grain_all"] = lambda s, b: grain.grain_violations(
        views.order_products(s, b), "order_number", "fk_product", 0, "unique_products_count")
    q["order_id_grain"] = lambda s, b: grain.grain_violations(
        views.order_suppliers(s, b), "order_id", "order_number", 1, "unique_order_number_count")
    q["order_id_grain_literal"] = lambda s, b: grain.grain_violations(
        views.order_suppliers(s, b), ["order_id", "order_number"], "order_number", 1,
        "unique_order_number_count").drop("order_number")
    q["conversion_grain"] = lambda s, b: grain.grain_violations(
        views.conversions_dirty(s, b), "conversion_id", "order_number", 1, "unique_orders")
    q["conversion_orphans"] = lambda s, b: grain.orphan_rows(
        views.conversions(s, b), views.orders_fact(s, b), "order_number",
        ["conversion_id", "order_number"])
    q["first_week_mismatch"] = lambda s, b: grain.first_week_mismatch(
        views.conversions(s, b), views.orders_fact(s, b), views.calendar(s))

    # --- customer 360: lifetime table steps and variants -----------------
    def base_q(s, b):
        c, cv, _, d = _star(s, b)
        return lifetime.conversion_base(c, cv, d).select(
            "customer_id", "first_name", "last_name", "conversion_id", "conversion_number",
            "conversion_type", "conversion_date", "conversion_week", "next_conversion_week",
            "conversion_channel", "order_number")

    def order_q(s, b):
        c, cv, o, d = _star(s, b)
        return lifetime.conversion_order(c, cv, o, d)

    def weekly_q(s, b):
        c, _, o, d = _star(s, b)
        return lifetime.weekly_orders(o, d, c).drop("order_ord")

    def spine_q(s, b, star=_star):
        c, cv, _, d = star(s, b)
        base = lifetime.conversion_base(c, cv, d)
        return lifetime.weekly_spine(base, d, AS_OF_WEEK, "capped").select(
            "customer_id", "conversion_id", "conversion_week", "next_conversion_week",
            "order_week", "week_counter")

    q["conversion_base"] = base_q
    q["conversion_order"] = order_q
    q["weekly_orders"] = weekly_q
    q["weekly_spine"] = spine_q
    q["lifetime_capped"] = _lifetime("capped")
    q["lifetime_open"] = _lifetime("open")
    q["lifetime_dirty_capped"] = _lifetime("capped", _dirty_star)
    q["lifetime_dirty_open"] = _lifetime("open", _dirty_star)
    q["weekly_spine_dirty"] = lambda s, b: spine_q(s, b, _dirty_star)
    # The cap of the scripts: the current week.
    q["lifetime_today_reconcile"] = lambda s, b: lifetime.reconcile(_lifetime("capped", as_of=None)(s, b))
    q["lifetime_reconcile"] = lambda s, b: lifetime.reconcile(_lifetime("capped")(s, b))
    q["lifetime_open_reconcile"] = lambda s, b: lifetime.reconcile(_lifetime("open")(s, b))

    def stored(variant: str, mode: str, read=None, filled: bool = False):
        """Writes the lifetime table to the session's warehouse and returns
        what ``read`` gets from it, kept when the table is dropped again. Without
        ``read``: its rows, from files in the checkpoint folder, which stay."""
        def run(s: SparkSession, b: str) -> DataFrame:
            name = f"tillroll_reports.full_360_{uuid.uuid4().hex}"
            try:
                if filled:
                    # Other rows first, which the refresh must replace: one a customer.
                    people = views.customer_dimension(s, b).select(*[
                        F.col(c) if c in ("customer_id", "first_name", "last_name") else F.lit(None).alias(c) for c in lifetime.SINK_COLUMNS])
                    refresh_table(s, people, name, lifetime.SINK_DDL)
                elif mode == "truncate":
                    create_table(s, name, lifetime.SINK_DDL)
                if filled:
                    c, cv, o, d = _star(s, b)
                    customer360.refresh_customer360(s, c, cv, o, d, name, variant, mode, AS_OF_WEEK)
                else:
                    refresh_table(s, _lifetime(variant)(s, b), name, lifetime.SINK_DDL, lifetime.SINK_COLUMNS, mode=mode,
                                  location=None if read else ensure_checkpoint_dir(s))
                return read(s.table(name)).checkpoint(eager=True) if read else s.table(name)
            finally:
                drop_result(s, name)
        return run

    q["refresh_capped_reconcile"] = stored("capped", "recreate", lifetime.reconcile)
    q["refresh_open_reconcile"] = stored("open", "truncate", lifetime.reconcile)
    q["refresh_stored_rows"] = stored("capped", "recreate")

    q["refresh_filled_capped"] = stored("capped", "recreate", lifetime.reconcile, filled=True)
    q["refresh_filled_open"] = stored("open", "truncate", lifetime.reconcile, filled=True)

    def advanced_q(s, b):
        """The table at the cap of the week before, from facts known then, moved on
        to the cap with all facts: late orders and new conversions among them. Its
        rows, from files in the checkpoint folder, which stay."""
        c, cv, o, d = _star(s, b)
        name = f"tillroll_reports.full_360_{uuid.uuid4().hex}"
        then = F.col("conversion_id") % LATE_MODULUS != 0
        try:
            customer360.advance_customer360(s, c, cv.where(then), o.where(F.col("order_id") % LATE_MODULUS != 0), d, name, WEEK_BEFORE)
            customer360.advance_customer360(s, c, cv, o, d, name, AS_OF_WEEK, location=ensure_checkpoint_dir(s))
            return s.table(name)
        finally:
            drop_result(s, name)
            drop_result(s, f"{name}__state")

    q["lifetime_advanced"] = advanced_q

    def diff_q(s, b):
        """The lifetime table against a copy with faults that neither row count nor
        highest total shows: in two weeks of some customers amounts are moved."""
        name = f"tillroll_reports.compared_{uuid.uuid4().hex}"
        s.sql("CREATE SCHEMA IF NOT EXISTS tillroll_reports")
        try:
            table = materialize(lifetime.reconcilable(_lifetime("capped")(s, b)), name)
            moved = F.when(F.col("customer_id") % MOVED_MODULUS == 0, F.when(F.col("week_counter") == 2, 1).when(F.col("week_counter") == 3, -1))
            other = table.withColumn("total_paid_in_week", F.col("total_paid_in_week") + F.coalesce(moved, F.lit(0)))
            return diff.differing_rows(table, other, ["customer_id"], leaf_rows=1000).checkpoint(eager=True)
        finally:
            s.sql(f"DROP TABLE IF EXISTS {name}")

    q["lifetime_diff"] = diff_q

    def spine_dates_q(s, b):
        """Weeks of each conversion by their first day, a join on dates."""
        c, cv, _, d = _star(s, b)
        days = F.datediff(F.col("conversion_date"), F.lit("1970-01-01"))
        base = lifetime.conversion_base(c, cv, d).where("conversion_date IS NOT NULL").withColumn("from_day", days)
        nxt = base.select(F.col("customer_id").alias("_c"), (F.col("conversion_number") - 1).alias("_n"), F.col("from_day").alias("until_day"))
        spans = (base.join(nxt, (F.col("customer_id") == F.col("_c")) & (F.col("conversion_number") == F.col("_n")), "left")
                 .select("customer_id", "conversion_id", "from_day", F.coalesce("until_day", F.lit(LAST_DAY)).alias("until_day")))
        weeks = d.groupBy("year_week").agg(F.min("d").alias("first_day")).select(
            "year_week", F.datediff("first_day", F.lit("1970-01-01")).alias("week_day"))
        held = rangejoin.range_join(weeks, spans, "week_day", "from_day", "until_day")
        return held.groupBy("customer_id", "conversion_id").agg(
            F.count("*").alias("weeks"), F.min("year_week").alias("first_week"), F.max("year_week").alias("last_week"))

    q["spine_by_dates"] = spine_dates_q

    def gate_q(s, b):
        """The grain checks from one join of the facts: violations of each."""
        _, cv, o, d = _dirty_star(s, b)
        days = calendar.week_tables(d)[1]
        paired = lifetime.pair_orders(cv, o, days).checkpoint(eager=True)
        counts = [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
                  for name, df in customer360.pair_checks(paired).items()]
        return counts[0].union(counts[1]).union(counts[2])

    q["grain_gate"] = gate_q

    nullable = dict.fromkeys(("conversion_base", "weekly_spine", "lifetime_capped", "lifetime_open", "refresh_stored_rows"), NULLABLE_INT_COLS)
    nullable |= dict.fromkeys(("lifetime_dirty_capped", "lifetime_dirty_open", "weekly_spine_dirty"), (*NULLABLE_INT_COLS, "customer_id"))
    nullable["lifetime_advanced"] = NULLABLE_INT_COLS
    nullable["lifetime_diff"] = ("conversion_id",)
    nullable["duplicate_rows"] = ("quantity",)
    return {name: _presented(fn, nullable.get(name, ())) for name, fn in q.items()}


def _presented(fn: Query, double_cols: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return present(fn(spark, base), double_cols=double_cols)
    run.__name__ = getattr(fn, "__name__", "query")
    return run
