"""Weekly customer lifetime table: one row per customer x conversion x week.

Inputs (star schema):
    customers   sk_customer, customer_id, first_name, last_name
    conversions conversion_id, fk_customer, fk_conversion_date, conversion_date,
                conversion_type, conversion_channel, order_number
    orders      order_number, fk_customer, fk_order_date, unit_price,
                discount_value, price_paid
    dates       sk_date, year_week ('YYYY-Www')

Two variants of the original scripts:
    capped  weeks run from the conversion week up to (not including) the
            next conversion week, or the ``as_of`` ISO week for the last
            conversion; a conversion with no such week keeps one row with a
            NULL week; running sums count missing weeks as 0.
    open    the bound is applied after the join: the last conversion runs to
            the end of the date dimension, conversions with no week are
            dropped (except a NULL-week row with no next conversion), and
            running sums keep NULLs.

Plan, and why it scales:
    1. Week labels get a dense ordinal (bounded: about 53 a year). The
       day->week map is broadcast if the dates have at most
       ``calendar.DAY_BROADCAST_LIMIT`` rows; beyond, the planner decides.
    2. conversion_number is a skew-safe ROW_NUMBER per customer
       (``group_row_number``) and the next conversion's week comes from an
       equi-join on (customer_id, conversion_number + 1): no window ever
       holds one customer's conversions in one task.
    3. ``prepare`` computes, once for both variants, the conversions with their
       weeks and first orders, and the weekly orders: aggregated per (customer
       key, week) before the join to the customer dimension. With ``store`` the
       conversions that can have weeks and the weekly orders are written as
       tables bucketed by customer, so that no later step moves them; without,
       they are kept in ``spark.checkpoint.dir`` and hashed by customer.
    4. Conversions are joined with the weekly orders of their weeks where the
       customer's conversions lie, by a sort merge join, which spills, and summed
       by windows there, without a shuffle with
       ``spark.sql.requireAllClusterKeysForCoPartition=false``. A joined row
       stands for a stretch of weeks in which no sum changes; text attributes are
       joined to the stretches, and ``explode(sequence(from, to))`` over week
       ordinals comes last: linear in output rows, which are never sorted, no
       nested-loop range join, one explode. Intervals of one customer do not
       overlap, so a customer has at most #weeks x fan-out rows. Customers whose
       intervals do overlap (below) are told apart first; their weeks are made
       before the join, then summed and numbered one by one.
    5. Repeated keys (a conversion id on several rows of a customer, several
       keys or rows without a conversion under one customer): dated rows are
       numbered by (week, conversion_number) within (customer, conversion).
       Rows without a week come after all dated rows of their group. They are
       unbounded per customer and never enter a window: counts and sums per
       interval, from a join of weekly orders to intervals by customer, add up
       to each group's and customer's totals, and the place among the rows
       without a week comes from ``group_row_number``, run only for groups that
       have several.

    The per-customer bound in 4 rests on conversion intervals not
    overlapping. They can overlap only when a conversion whose date key is
    missing from the date dimension sorts between two known ones (its NULL
    week makes the previous interval run to the cap, as in the original);
    such rows are still correct, just not bounded by #weeks.

Deliberate differences from the original scripts:
    * Conversions of a customer are ordered by (conversion_date,
      conversion_id, customer key, order number); ties were arbitrary.
    * week_counter and the per-conversion running sum are partitioned by
      (customer_id, conversion_id), so customers without a conversion
      (conversion_id NULL) do not share one counter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.functions.fmt import iso_week_label
from tillroll.functions.order import pg_asc
from tillroll.operators.numbering import group_row_number
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources.calendar import week_tables
from tillroll.sources.tables import materialize

VARIANTS = ("capped", "open")

# Declared schema of the result table (customer360.full_360_view).
SINK_DDL = """
    customer_id INT,
    first_name VARCHAR(255),
    last_name VARCHAR(255),
    conversion_id INT,
    conversion_number INT,
    conversion_type VARCHAR(255),
    conversion_date DATE,
    conversion_week VARCHAR(255),
    next_conversion_week VARCHAR(255),
    conversion_channel VARCHAR(255),
    first_order_week VARCHAR(255),
    first_order_total_paid DECIMAL(18,2),
    week_counter INT,
    order_week VARCHAR(255),
    orders_placed INT,
    total_before_discounts DECIMAL(18,2),
    total_discounts DECIMAL(18,2),
    total_paid_in_week DECIMAL(18,2),
    conversion_cumulative_revenue DECIMAL(18,2),
    lifetime_cumulative_revenue DECIMAL(18,2)
"""
SINK_COLUMNS = [line.split()[0] for line in SINK_DDL.strip().splitlines()]


# The customer key of rows whose customer_id is NULL: outside the INT range.
NO_CUSTOMER = -(2**40)

ATTRIBUTES = ["first_name", "last_name", "conversion_type", "conversion_date", "conversion_week",
              "next_conversion_week", "conversion_channel", "first_order_week", "first_order_total_paid"]
AMOUNTS = ["orders_count", "total_before_discounts", "total_discounts", "total_paid_in_week"]
RUNNING = ["conversion_cumulative_revenue", "lifetime_cumulative_revenue"]


def _customer_key() -> F.Column:
    return F.coalesce(F.col("customer_id").cast("long"), F.lit(NO_CUSTOMER)).alias("_ck")


def conversion_base(customers: DataFrame, conversions: DataFrame, dates: DataFrame) -> DataFrame:
    """Every customer (one NULL row when without conversion) x conversion,
    with conversion_number, conversion week and next conversion week."""
    return _base(customers, conversions, week_tables(dates)[1])


def _base(customers: DataFrame, conversions: DataFrame, days: DataFrame) -> DataFrame:
    cust = customers.select("sk_customer", "customer_id", "first_name", "last_name")
    conv = conversions.select(
        "conversion_id", "fk_customer", "fk_conversion_date", "conversion_date",
        "conversion_type", "conversion_channel", "order_number")
    cw = days.select(F.col("sk_date").alias("_cd"), F.col("year_week").alias("conversion_week"),
                     F.col("week_ord").alias("conversion_ord"))
    # Inner join plus the customers without a conversion: in an outer join the
    # conversions of a hot customer could not be split over tasks.
    known = cust.join(conv, cust.sk_customer == conv.fk_customer)
    buyers = conv.select(F.col("fk_customer").alias("_buyer")).distinct()
    alone = cust.join(buyers, F.col("sk_customer") == F.col("_buyer"), "left_anti")
    j = (known.unionByName(alone, allowMissingColumns=True)
         .join(cw, F.col("fk_conversion_date") == F.col("_cd"), "left")
         .drop("_cd", "fk_customer", "fk_conversion_date"))
    numbered = group_row_number(
        j, ["customer_id"], [pg_asc(c) for c in ("conversion_date", "conversion_id", "sk_customer", "order_number")],
        out="conversion_number")
    nxt = numbered.select(
        F.col("customer_id").alias("_nc"),
        (F.col("conversion_number") - 1).alias("_nn"),
        F.col("conversion_week").alias("next_conversion_week"),
        F.col("conversion_ord").alias("next_ord"))
    cond = [F.col("customer_id").eqNullSafe(F.col("_nc")), F.col("conversion_number") == F.col("_nn")]
    return numbered.join(nxt, cond, "left").drop("_nc", "_nn")


def conversion_order(customers: DataFrame, conversions: DataFrame, orders: DataFrame,
                     dates: DataFrame) -> DataFrame:
    """Per conversion (of a known customer): its order's week and paid amount."""
    days = week_tables(dates)[1]
    pairs = conversions.select("conversion_id", "fk_customer", "order_number").join(
        customers.select("sk_customer"), F.col("fk_customer") == F.col("sk_customer"))
    o = orders.select("order_number", "fk_order_date", "price_paid")
    j = (pairs.join(o, "order_number")
         .join(days, F.col("fk_order_date") == F.col("sk_date")))
    return j.select("conversion_id", "order_number", F.col("year_week").alias("order_week"),
                    F.col("price_paid").alias("order_total_paid"))


def weekly_orders(orders: DataFrame, dates: DataFrame, customers: DataFrame) -> DataFrame:
    """Per (customer key, customer_id, week): order count, gross, discount, paid.

    Aggregated per (fk_customer, week) first, then joined to the customer
    dimension: the same groups as grouping after the join, with the
    fact shrunk before the second shuffle."""
    return _weekly_orders(orders, week_tables(dates)[1], customers)


def _weekly_orders(orders: DataFrame, days: DataFrame, customers: DataFrame) -> DataFrame:
    o = orders.select("order_number", "fk_customer", "fk_order_date", "unit_price",
                      "discount_value", "price_paid")
    per_key = (
        o.join(days, F.col("fk_order_date") == F.col("sk_date"), "left")
        .groupBy("fk_customer", F.col("year_week").alias("order_week"), F.col("week_ord").alias("order_ord"))
        .agg(F.count("order_number").alias("orders_count"),
             F.sum("unit_price").alias("total_before_discounts"),
             F.sum("discount_value").alias("total_discounts"),
             F.sum("price_paid").alias("total_paid_in_week"))
    )
    cust = customers.select("sk_customer", "customer_id")
    j = per_key.join(cust, F.col("fk_customer") == F.col("sk_customer"), "left")
    return j.select("fk_customer", "customer_id", "order_week", "order_ord", *AMOUNTS)


def _ends(weeks: DataFrame, as_of) -> tuple[int, int]:
    """Number of week labels before the cap, and the last ordinal."""
    cap = F.lit(as_of) if as_of is not None else iso_week_label(F.current_date())
    row = weeks.agg(F.count_if(F.col("year_week") < cap).alias("cap"), F.max("week_ord").alias("last")).first()
    return row.cap, row.last or 0


def _spans(base: DataFrame, ends: tuple[int, int], variant: str) -> DataFrame:
    """``base`` plus the interval of week ordinals each row covers
    (``_lo``..``_hi``, inclusive) and ``_has_weeks``; ``_keep`` says whether
    a row without weeks still yields one NULL-week row."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    lo = F.col("conversion_ord")
    has_next = F.col("next_conversion_week").isNotNull()
    hi = F.when(has_next, F.col("next_ord") - 1).otherwise(F.lit(ends[0] if variant == "capped" else ends[1]))
    has_weeks = F.coalesce(lo <= hi, F.lit(False))
    # capped: the bound is part of the join, so an empty interval keeps one
    # NULL-week row; open: the bound filters after the join, so only a row
    # without a next conversion survives as a NULL-week row.
    keep = F.lit(True) if variant == "capped" else ~has_next
    return base.select("*", lo.alias("_lo"), hi.alias("_hi"), has_weeks.alias("_has_weeks"), keep.alias("_keep"))


def _places(undated: DataFrame) -> DataFrame | None:
    """(_pk, _pn, _place): the place of a row without a week among those of its
    (customer, conversion), for groups that have several; None if none has."""
    rows = undated.select("_ck", "conversion_id", "conversion_number").distinct()
    several = rows.groupBy(F.col("_ck").alias("_sk"), F.col("conversion_id").alias("_si")).count().where("count > 1")
    if several.isEmpty():
        return None
    members = rows.join(several, (F.col("_ck") == F.col("_sk")) & F.col("conversion_id").eqNullSafe(F.col("_si")), "left_semi")
    numbered = group_row_number(members, ["_ck", "conversion_id"], ["conversion_number"], out="_place")
    return numbered.select(F.col("_ck").alias("_pk"), F.col("conversion_number").alias("_pn"), "_place")


def _with_place(undated: DataFrame) -> DataFrame:
    places = _places(undated)
    if places is None:
        return undated.withColumn("_place", F.lit(1).cast("long"))
    found = undated.join(places, (F.col("_ck") == F.col("_pk")) & (F.col("conversion_number") == F.col("_pn")), "left")
    return found.withColumn("_place", F.coalesce("_place", F.lit(1).cast("long"))).drop("_pk", "_pn")


def _counted_weeks(intervals: DataFrame) -> DataFrame:
    """``intervals`` exploded to weeks, with order_ord and week_counter.

    A scan over the intervals of a (customer, conversion), few rows, gives how
    many weeks the earlier ones have; a week's counter is that and its place in
    its own interval. Only groups whose intervals overlap number their weeks."""
    group = Window.partitionBy("_ck", "conversion_id")
    earlier = group.orderBy("_lo", "conversion_number").rowsBetween(Window.unboundedPreceding, -1)
    scanned = (intervals.withColumn("_before", F.coalesce(F.sum(F.col("_hi") - F.col("_lo") + 1).over(earlier), F.lit(0)))
               .withColumn("_meets", F.coalesce(F.max("_hi").over(earlier) >= F.col("_lo"), F.lit(False)))
               .withColumn("_meets", F.max("_meets").over(group)))
    apart = scanned.where("NOT _meets").select("*", F.posexplode(F.sequence("_lo", "_hi")).alias("_pos", "order_ord"))
    apart = apart.withColumn("week_counter", F.col("_before") + F.col("_pos") + 1).drop("_pos")
    meeting = scanned.where("_meets").withColumn("order_ord", F.explode(F.sequence("_lo", "_hi")))
    meeting = meeting.withColumn("week_counter", F.row_number().over(group.orderBy("order_ord", "conversion_number")).cast("long"))
    return apart.unionByName(meeting).drop("_before", "_meets")


def weekly_spine(base: DataFrame, dates: DataFrame, as_of=None, variant: str = "capped") -> DataFrame:
    """``base`` rows exploded to one row per week of their interval: adds
    order_week, order_ord and week_counter (from 1 within customer and
    conversion, by week; rows without a week last)."""
    weeks, _ = week_tables(dates)
    spans = _spans(base, _ends(weeks, as_of), variant).withColumn("_ck", _customer_key())
    labels = weeks.select(F.col("week_ord").alias("_wo"), F.col("year_week").alias("order_week"))
    dated = _counted_weeks(spans.where("_has_weeks")).join(labels, F.col("order_ord") == F.col("_wo"), "left").drop("_wo")
    before = (spans.where("_has_weeks").groupBy(F.col("_ck").alias("_bk"), F.col("conversion_id").alias("_bi"))
              .agg(F.sum(F.col("_hi") - F.col("_lo") + 1).alias("_before")))
    undated = _with_place(spans.where("NOT _has_weeks AND _keep")).join(
        before, (F.col("_ck") == F.col("_bk")) & F.col("conversion_id").eqNullSafe(F.col("_bi")), "left")
    undated = undated.withColumn("week_counter", F.coalesce("_before", F.lit(0)) + F.col("_place")).drop("_bk", "_bi", "_before", "_place")
    both = dated.unionByName(undated, allowMissingColumns=True)
    return both.withColumn("week_counter", F.col("week_counter").cast("int")).drop("_lo", "_hi", "_has_weeks", "_keep", "_ck")


@dataclass(frozen=True)
class Prepared:
    """What both variants are built from. ``paired``: conversions with each order
    that they match (``pair_orders``), ``orphans``: how many match none, counted
    while that was written. ``dated``: conversions that can have weeks, with
    attributes and first order, a row for each order that matches; ``undated``:
    the other rows of the base; ``weekly``: orders by customer and week. ``dated``
    and ``weekly`` lie by ``_ck`` in ``partitions`` partitions."""

    paired: DataFrame
    orphans: int
    dated: DataFrame
    undated: DataFrame
    weekly: DataFrame
    weeks: DataFrame
    partitions: int


def pair_orders(conversions: DataFrame, orders: DataFrame, days: DataFrame) -> DataFrame:
    """Every conversion with each order of its number: conversion_id, fk_customer,
    order_number, conversion_week, found (an order has the number), dated (and its
    date is known), order_week, price_paid. What the grain checks and the lifetime
    table need of the two facts together."""
    week_of = lambda key, week, known: days.select(F.col("sk_date").alias(key), F.col("year_week").alias(week), F.lit(True).alias(known))
    conv = conversions.select("conversion_id", "fk_customer", "fk_conversion_date", "order_number").join(
        week_of("_cd", "conversion_week", "_c"), F.col("fk_conversion_date") == F.col("_cd"), "left")
    o = orders.select(F.col("order_number").alias("_on"), "fk_order_date", "price_paid", F.lit(True).alias("_f")).join(
        week_of("_od", "order_week", "_d"), F.col("fk_order_date") == F.col("_od"), "left")
    return conv.join(o, F.col("order_number") == F.col("_on"), "left").select(
        "conversion_id", "fk_customer", "order_number", "conversion_week", F.col("_f").isNotNull().alias("found"),
        F.col("_d").isNotNull().alias("dated"), "order_week", "price_paid")


def prepare(customers: DataFrame, conversions: DataFrame, orders: DataFrame, dates: DataFrame,
            store: str | None = None, partitions: int | None = None) -> Prepared:
    """Runs the joins that both variants share.

    store: a table name; ``{store}_dated`` and ``{store}_weekly`` are written as
    tables bucketed by customer (the caller drops them). Without it the frames
    are kept in the checkpoint folder.
    """
    spark = customers.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weeks, days = week_tables(dates)
    # Both facts are joined once; the checks read the result, and the orders that
    # are missing are counted while it is written.
    counted = Observation()
    paired = pair_orders(conversions, orders, days).observe(counted, F.count_if(~F.col("found")).alias("orphans")).checkpoint(eager=True)
    first = paired.where("dated").join(
        customers.select("sk_customer"), F.col("fk_customer") == F.col("sk_customer"), "left_semi").select(
        F.col("conversion_id").alias("_fc"), F.col("order_week").alias("first_order_week"),
        F.col("price_paid").alias("first_order_total_paid"))
    rows = (_base(customers, conversions, days).join(first, F.col("conversion_id") == F.col("_fc"), "left")
            .select("*", _customer_key()).drop("_fc", "sk_customer", "order_number").checkpoint(eager=True))
    # Same week as the next conversion, or no known week: no variant has weeks
    # for it, and a customer may have any number of such rows.
    can_have_weeks = F.coalesce(F.col("conversion_ord") < F.col("next_ord"), F.col("conversion_ord").isNotNull() & F.col("next_conversion_week").isNull())
    dated, undated = rows.where(can_have_weeks), rows.where(~can_have_weeks)
    weekly = (_weekly_orders(orders, days, customers).where("customer_id IS NOT NULL AND order_ord IS NOT NULL")
              .select(_customer_key(), F.col("order_ord"), *AMOUNTS))
    if store:
        dated = materialize(dated, f"{store}_dated", "_ck", n, "conversion_number")
        weekly = materialize(weekly, f"{store}_weekly", "_ck", n, "order_ord")
    else:
        dated = dated.repartition(n, "_ck")
        weekly = weekly.checkpoint(eager=True).repartition(n, "_ck")
    return Prepared(paired, counted.get["orphans"], dated, undated, weekly, weeks, n)


def customer_weekly_lifetime(customers: DataFrame, conversions: DataFrame, orders: DataFrame,
                             dates: DataFrame, as_of=None, variant: str = "capped",
                             partitions: int | None = None) -> DataFrame:
    """The weekly lifetime table, columns in sink order (``SINK_COLUMNS``).

    ``as_of`` is the cap week label ('YYYY-Www') of the capped variant;
    None means the ISO week of the current date.
    """
    return lifetime_rows(prepare(customers, conversions, orders, dates, partitions=partitions), as_of, variant)


def _intervals(candidates: DataFrame) -> DataFrame:
    """A row for each conversion with weeks. A conversion matching k orders appears
    k times in the original (the join comes before the running sums), so its
    amounts count ``_k`` times."""
    return (candidates.where("_has_weeks").groupBy("_ck", "conversion_number")
            .agg(F.first("customer_id").alias("customer_id"), F.first("conversion_id").alias("conversion_id"),
                 F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count("*").cast("decimal(10,0)").alias("_k"),
                 F.first(F.col("next_conversion_week").isNotNull()).alias("_followed")))


def _group_totals(intervals: DataFrame, weekly: DataFrame) -> DataFrame:
    """(_ck, conversion_id, _weeks, _paid): weeks and revenue of each (customer,
    conversion), from sums per interval: one join by customer, no spine."""
    per_interval = (intervals.join(weekly, (F.col("_ck") == F.col("_wk")) & F.col("_wo").between(F.col("_lo"), F.col("_hi")), "left")
                    .groupBy("_ck", "conversion_number").agg(
                        F.first("conversion_id").alias("conversion_id"), F.first(F.col("_hi") - F.col("_lo") + 1).alias("_weeks"),
                        F.sum(F.col("total_paid_in_week") * F.col("_k")).alias("_paid")))
    return per_interval.groupBy("_ck", "conversion_id").agg(F.sum("_weeks").alias("_weeks"), F.sum("_paid").alias("_paid"))


def _weekly_keyed(prepared: Prepared) -> DataFrame:
    return prepared.weekly.select(F.col("_ck").alias("_wk"), F.col("order_ord").alias("_wo"), *AMOUNTS)


def group_totals(prepared: Prepared, as_of=None, variant: str = "capped") -> DataFrame:
    """(_ck, conversion_id, _weeks, _paid) of every (customer, conversion) with weeks."""
    candidates = _spans(prepared.dated, _ends(prepared.weeks, as_of), variant)
    return _group_totals(_intervals(candidates), _weekly_keyed(prepared))


def _meeting(intervals: DataFrame) -> DataFrame:
    """(_mk): customers of which two intervals overlap."""
    earlier = Window.partitionBy("_ck").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = intervals.select("_ck", "_lo", F.max("_hi").over(earlier).alias("_reach"))
    return reach.where("_reach >= _lo").select(F.col("_ck").alias("_mk")).distinct()


def sink_schema() -> StructType:
    """The declared schema of the result table. Needs a session."""
    return StructType.fromDDL(SINK_DDL)


def stored_types(schema: StructType) -> dict[str, str]:
    """The types that a table of ``schema``, in the order of ``SINK_COLUMNS``, has for
    the figures of a row: ``types`` of ``lifetime_rows``."""
    return {c: f.dataType.simpleString() for c, f in zip(SINK_COLUMNS, schema.fields) if c in (*AMOUNTS, *RUNNING)}


def _fitted(df: DataFrame, types: dict[str, str] | None, **of: str) -> DataFrame:
    """``df`` with the columns that ``of`` lists by name (column=figure) and AMOUNTS in
    the ``types`` of their figures. A value that does not fit fails, as its insert would."""
    if types is None:
        return df

    def fit(c: str, figure: str) -> F.Column:
        value = F.col(c).cast("decimal(38,2)") if figure in RUNNING else F.col(c)
        fitted = value.try_cast(types[figure])
        failed = F.raise_error(F.concat(F.lit(f"{figure} of type {types[figure]} cannot hold "), value.cast("string")))
        return F.when(value.isNotNull() & fitted.isNull(), failed).otherwise(fitted)

    figures = {c: c for c in AMOUNTS if c in types} | of
    return df.withColumns({c: fit(c, figure) for c, figure in figures.items()})


def _stretched_weeks(intervals: DataFrame, weekly: DataFrame, attributes: DataFrame, capped: bool,
                     types: dict[str, str] | None = None) -> DataFrame:
    """The weeks of intervals that do not overlap, with order_ord, AMOUNTS, running
    sums, week_counter and attributes.

    Sums change only in weeks with orders. So a row for each interval and week with
    orders in it is joined, summed and sorted, and stands for a stretch of weeks: its
    own up to the next such week, and the weeks before it if it is the interval's
    first. The weeks are made last, and nothing is sorted or cast after that. What a
    stretch shows before its first sum is the sum of an earlier one, so a figure that
    does not fit its type is one that the table shows."""
    zero, nothing = F.lit(0).cast("decimal(18,2)"), F.lit(0).cast("decimal(38,2)")
    scanned = Window.partitionBy("_ck", "conversion_id").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    counted = intervals.withColumn("_c_weeks", F.col("_c_weeks") + F.coalesce(F.sum(F.col("_hi") - F.col("_lo") + 1).over(scanned), F.lit(0)))
    paid = F.coalesce("total_paid_in_week", zero) if capped else F.col("total_paid_in_week")
    events = (counted.join(weekly, (F.col("_ck") == F.col("_wk")) & F.col("_wo").between(F.col("_lo"), F.col("_hi")), "left")
              .select("*", F.coalesce("_wo", "_lo").alias("_at"), (paid * F.col("_k")).alias("_paid")))
    by_customer, by_conversion = (Window.partitionBy(*keys).orderBy("_at") for keys in (["_ck"], ["_ck", "conversion_id"]))
    upto, before = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    same = lambda other: F.coalesce(other("conversion_number").over(by_customer) == F.col("conversion_number"), F.lit(False))
    # Weeks before any sum: nothing paid yet, which the open variant shows as NULL.
    start = lambda c: F.coalesce(c, nothing) if capped else c
    stretches = (events
                 .withColumn("_from", F.when(same(F.lag), F.col("_at")).otherwise(F.col("_lo")))
                 # Several weekly rows of one week: the last one goes on to the next week with orders.
                 .withColumn("_to", F.greatest(F.col("_at"), F.when(same(F.lead), F.lead("_at").over(by_customer) - 1).otherwise(F.col("_hi"))))
                 .withColumn("_total", F.col("_c_total") + F.sum("_paid").over(by_customer.rangeBetween(*upto)))
                 .withColumn("_total_before", F.col("_c_total") + start(F.sum("_paid").over(by_customer.rangeBetween(*before))))
                 .withColumn("_own", F.col("_c_paid") + F.sum("_paid").over(by_conversion.rangeBetween(*upto)))
                 .withColumn("_own_before", F.col("_c_paid") + start(F.sum("_paid").over(by_conversion.rangeBetween(*before))))
                 .join(attributes, (F.col("_ck") == F.col("_ak")) & (F.col("conversion_number") == F.col("_an"))))
    stretches = _fitted(stretches, types, _total="lifetime_cumulative_revenue", _total_before="lifetime_cumulative_revenue",
                        _own="conversion_cumulative_revenue", _own_before="conversion_cumulative_revenue")
    week = F.col("order_ord")
    reached = week >= F.col("_at")
    return stretches.withColumn("order_ord", F.explode(F.sequence("_from", "_to"))).select(
        "customer_id", "conversion_id", "conversion_number", *ATTRIBUTES, "order_ord",
        (F.col("_c_weeks") + week - F.col("_lo") + 1).alias("week_counter"),
        *[F.when(week == F.col("_wo"), F.col(c)).alias(c) for c in AMOUNTS],
        F.when(reached, F.col("_total")).otherwise(F.col("_total_before")).alias("lifetime_cumulative_revenue"),
        F.when(reached, F.col("_own")).otherwise(F.col("_own_before")).alias("conversion_cumulative_revenue"))


def _single_weeks(intervals: DataFrame, weekly: DataFrame, attributes: DataFrame, capped: bool,
                  types: dict[str, str] | None = None) -> DataFrame:
    """The same columns for any intervals: weeks are made first, then joined, summed
    and numbered one by one."""
    spine = intervals.select("_ck", "customer_id", "conversion_id", "conversion_number", "_k", "_c_weeks", "_c_paid", "_c_total",
                             F.explode(F.sequence("_lo", "_hi")).alias("order_ord"))
    joined = spine.join(weekly, (F.col("_ck") == F.col("_wk")) & (F.col("order_ord") == F.col("_wo")), "left")
    paid = F.coalesce("total_paid_in_week", F.lit(0).cast("decimal(18,2)")) if capped else F.col("total_paid_in_week")
    upto = (Window.unboundedPreceding, Window.currentRow)
    by_customer = Window.partitionBy("_ck").orderBy("order_ord").rangeBetween(*upto)
    by_conversion = Window.partitionBy("_ck", "conversion_id")
    windowed = (joined.withColumn("_paid", paid * F.col("_k"))
                .withColumn("lifetime_cumulative_revenue", F.col("_c_total") + F.sum("_paid").over(by_customer))
                # Equal ranks are the copies of one spine row by several weekly rows.
                .withColumn("week_counter", F.col("_c_weeks") + F.dense_rank().over(by_conversion.orderBy("order_ord", "conversion_number")))
                .withColumn("conversion_cumulative_revenue", F.col("_c_paid") + F.sum("_paid").over(by_conversion.orderBy("order_ord").rangeBetween(*upto))))
    return (_fitted(windowed, types, **{c: c for c in RUNNING}).join(attributes, (F.col("_ck") == F.col("_ak")) & (F.col("conversion_number") == F.col("_an")))
            .select("customer_id", "conversion_id", "conversion_number", *ATTRIBUTES, "order_ord", "week_counter", *AMOUNTS,
                    "lifetime_cumulative_revenue", "conversion_cumulative_revenue"))


def lifetime_rows(prepared: Prepared, as_of=None, variant: str = "capped", since: str | None = None,
                  carried: DataFrame | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """The weekly lifetime table from ``prepare``d frames.

    since: an earlier cap; only the weeks that the table does not have at that cap,
    and the rows without a week. ``carried`` (``group_totals`` at that cap) is what
    counters and sums go on from, which holds for customers whose intervals do not
    overlap: all their new weeks come after the old ones.

    types: of the table that the rows are for (``stored_types``). Figures get them
    before the weeks are made; without, each row is cast when it is written.
    """
    capped = variant == "capped"
    zero = F.lit(0).cast("decimal(18,2)")
    ends = _ends(prepared.weeks, as_of)
    candidates = _spans(prepared.dated, ends, variant)
    weekly = _weekly_keyed(prepared)
    intervals = _intervals(candidates)
    nothing = F.lit(0).cast("decimal(38,2)")
    if since is None:
        shown = intervals.select("*", F.lit(0).cast("long").alias("_c_weeks"), nothing.alias("_c_paid"), nothing.alias("_c_total"))
    else:
        groups = carried.select(F.col("_ck").alias("_ek"), F.col("conversion_id").alias("_ei"),
                                F.col("_weeks").alias("_c_weeks"), F.coalesce("_paid", nothing).alias("_c_paid"))
        totals = carried.groupBy(F.col("_ck").alias("_fk")).agg(F.coalesce(F.sum("_paid"), nothing).alias("_c_total"))
        # A conversion with a successor had all its weeks; the last one had those up to the cap.
        new = F.greatest(F.col("_lo"), F.lit(_ends(prepared.weeks, since)[0] + 1))
        shown = (intervals.where("NOT _followed").withColumn("_lo", new).where("_lo <= _hi")
                 .join(groups, (F.col("_ck") == F.col("_ek")) & F.col("conversion_id").eqNullSafe(F.col("_ei")), "left")
                 .join(totals, F.col("_ck") == F.col("_fk"), "left")
                 .fillna({"_c_weeks": 0}).withColumns({c: F.coalesce(c, nothing) for c in ("_c_paid", "_c_total")}))
    attributes = candidates.where("_has_weeks").select(
        F.col("_ck").alias("_ak"), F.col("conversion_number").alias("_an"), *ATTRIBUTES)
    labels = prepared.weeks.select(F.col("week_ord").alias("_lo"), F.col("year_week").alias("order_week"))
    meeting = _meeting(shown)
    weeks = _stretched_weeks(shown, weekly, attributes, capped, types)
    if not meeting.isEmpty():
        mine = F.col("_ck") == F.col("_mk")
        weeks = (_stretched_weeks(shown.join(meeting, mine, "left_anti"), weekly, attributes, capped, types)
                 .unionByName(_single_weeks(shown.join(meeting, mine, "left_semi"), weekly, attributes, capped, types)))
    dated = weeks.join(labels, F.col("order_ord") == F.col("_lo"), "left")

    # Rows without a week. NULL weeks sort last, so their frames are their whole
    # customer and their whole (customer, conversion).
    sums = _group_totals(intervals, weekly)
    groups = sums.select(F.col("_ck").alias("_gk"), F.col("conversion_id").alias("_gi"), "_weeks", F.col("_paid").alias("_group_paid"))
    totals = sums.groupBy(F.col("_ck").alias("_tk")).agg(F.sum("_paid").alias("_total_paid"))
    rest = candidates.unionByName(_spans(prepared.undated, ends, variant)).where("NOT _has_weeks AND _keep")
    running = lambda c: (F.coalesce(c, zero) if capped else F.col(c)).cast("decimal(38,2)")
    undated = (_with_place(rest)
               .join(groups, (F.col("_ck") == F.col("_gk")) & F.col("conversion_id").eqNullSafe(F.col("_gi")), "left")
               .join(totals, F.col("_ck") == F.col("_tk"), "left")
               .select("*", F.lit(None).cast("string").alias("order_week"),
                       (F.coalesce("_weeks", F.lit(0)) + F.col("_place")).alias("week_counter"),
                       *[F.lit(None).cast("bigint" if c == "orders_count" else "decimal(28,2)").alias(c) for c in AMOUNTS],
                       running("_group_paid").alias("conversion_cumulative_revenue"),
                       running("_total_paid").alias("lifetime_cumulative_revenue")))
    undated = _fitted(undated, types, **{c: c for c in RUNNING})

    def finish(df: DataFrame) -> DataFrame:
        return df.select(
            "customer_id", "first_name", "last_name", "conversion_id",
            F.col("conversion_number").cast("int").alias("conversion_number"),
            "conversion_type", "conversion_date",
            "conversion_week", "next_conversion_week", "conversion_channel",
            "first_order_week", "first_order_total_paid",
            F.col("week_counter").cast("int").alias("week_counter"), "order_week",
            F.when(F.col("orders_count") > 0, 1).otherwise(0).alias("orders_placed"),
            F.coalesce("total_before_discounts", zero).alias("total_before_discounts"),
            F.coalesce("total_discounts", zero).alias("total_discounts"),
            F.coalesce("total_paid_in_week", zero).alias("total_paid_in_week"),
            *[F.col(c) if types else F.col(c).cast("decimal(38,2)").alias(c) for c in RUNNING],
        )

    return finish(dated).unionByName(finish(undated))


def reconcilable(view: DataFrame) -> DataFrame:
    """The columns of the table that identify and measure a row."""
    return view.select("customer_id", "conversion_id", "conversion_number", "order_week", "week_counter", "orders_placed",
                       "total_paid_in_week", "conversion_cumulative_revenue", "lifetime_cumulative_revenue")


def reconcile(view: DataFrame) -> DataFrame:
    """Per customer: row count and the highest lifetime running total."""
    return (view.groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("row_count"),
                 F.max("lifetime_cumulative_revenue").alias("lifetime_cumulative_revenue"))
            .orderBy(pg_asc("customer_id")))

