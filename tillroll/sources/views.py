"""Fixture views: the input tables of the reports, derived from the
synthetic TPC-H-like tables by Spark.

A user with real tables (a sales fact, a conversion and an order fact,
customer and date dimensions) passes those instead; the reports only
need the column names below.

The definitions follow FIXTURES.md part 2. Joins are left to Catalyst and
AQE: no side of a fact join is forced to broadcast, since ``part``,
``orders`` and ``customer`` all grow with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.calendar import date_dimension, date_key
from tillroll.sources.tables import read_table

# Fixed values of the fixture views (FIXTURES.md part 2).
DIRT_MODULUS = 500          # l_partkey % 500: 0 -> article '.', price NULL; 1 -> date NULL; 2 -> price 0
MOVED_TIME_MODULUS = 100    # event_id % 100 = 0: sale_time one hour later than sale_datetime
ORPHAN_MODULUS = 97         # o_orderkey % 97 = 0: conversion order number negated
SECOND_ORDER_MODULUS = 89   # conversion_id % 89 = 0: extra conversion row with order_number + 1
ORDER_DATE_SHIFT = 5        # order date key moved o_orderkey % 5 days
SHARED_MODULUS = 40         # customers_shared: c_custkey % 40 = 0 has the id of the key before it
NO_ID_MODULUS = 401         # customers_shared: c_custkey % 401 = 0 has no id
REPEAT_MODULI = (53, 59, 61)  # conversions_repeated: second date, equal row, unknown date key
RENUMBER_MODULUS = 67       # orders_renumbered: o_orderkey % 67 = 0 has the order number before its own
TIMED_DIRT_MODULUS = 300    # timed_dirty: event_id % 300: 0 -> article '.', price NULL; 1 -> time NULL; 2 -> date NULL
COPIES = ((250, 5), (50, 2))  # timed_dirty: event_id % 250 = 0 appears five times, else % 50 = 0 twice
CONVERSION_PRIORITY = "1-URGENT"
CALENDAR_START, CALENDAR_END = "1995-01-01", "2001-12-31"


def sales_lines(spark: SparkSession, base: str) -> DataFrame:
    """One row per ticket line: lineitem joined to its order and part."""
    li = read_table(spark, base, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag")
    o = read_table(spark, base, "orders").select("o_orderkey", "o_orderdate")
    p = read_table(spark, base, "part").select("p_partkey", "p_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return j.select(
        F.col("l_orderkey").alias("ticket_number"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("o_orderdate").alias("sale_datetime"),
        F.col("p_name").alias("article"),
        qty.cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
        F.col("l_partkey"),
    )


def sales_dirty(spark: SparkSession, base: str) -> DataFrame:
    """sales_lines with missing dates, missing prices on article '.' and zero prices."""
    s = sales_lines(spark, base)
    m = F.col("l_partkey") % DIRT_MODULUS
    return s.select(
        "ticket_number", "line_no",
        F.when(m == 1, F.lit(None).cast("date")).otherwise(F.col("sale_date")).alias("sale_date"),
        "sale_datetime",
        F.when(m == 0, F.lit(".")).otherwise(F.col("article")).alias("article"),
        "quantity",
        F.when(m == 0, F.lit(None).cast("decimal(12,2)"))
         .when(m == 2, F.lit(0).cast("decimal(12,2)"))
         .otherwise(F.col("unit_price")).alias("unit_price"),
        "l_partkey",
    )


def timed_sales(spark: SparkSession, base: str) -> DataFrame:
    """Sales with a time of day, from the events table."""
    e = read_table(spark, base, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    shown = F.when(F.col("event_id") % MOVED_TIME_MODULUS == 0,
                   F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts"))
    return e.select(
        F.col("user_id").alias("ticket_number"),
        F.col("ts").cast("date").alias("sale_date"),
        F.date_format(shown, "HH:mm:ss").alias("sale_time"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("sale_datetime"),
        F.col("event_type").alias("article"),
        F.get_json_object("props", "$.k").cast("int").alias("quantity"),
        F.col("value").cast("decimal(12,2)").alias("unit_price"),
    )


def timed_dirty(spark: SparkSession, base: str) -> DataFrame:
    """timed_sales (all six columns of a sales line) with missing values and with
    rows that repeat in full, twice or five times."""
    e = read_table(spark, base, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    copies = F.when(F.col("event_id") % COPIES[0][0] == 0, COPIES[0][1]).when(F.col("event_id") % COPIES[1][0] == 0, COPIES[1][1]).otherwise(1)
    e = e.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")
    m = F.col("event_id") % TIMED_DIRT_MODULUS
    return e.select(
        F.col("user_id").alias("ticket_number"),
        F.when(m != 2, F.col("ts").cast("date")).alias("sale_date"),
        F.when(m != 1, F.date_format("ts", "HH:mm:ss")).alias("sale_time"),
        F.when(m == 0, ".").otherwise(F.col("event_type")).alias("article"),
        F.get_json_object("props", "$.k").cast("int").alias("quantity"),
        F.when(m != 0, F.col("value").cast("decimal(12,2)")).alias("unit_price"),
    )


def customer_dimension(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("sk_customer"),
        F.col("c_custkey").cast("int").alias("customer_id"),
        F.col("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
    )


def calendar(spark: SparkSession) -> DataFrame:
    return date_dimension(spark, CALENDAR_START, CALENDAR_END)


def conversions(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    o = o.where(F.col("o_orderpriority") == CONVERSION_PRIORITY)
    key = F.col("o_orderkey")
    return o.select(
        key.alias("conversion_id"),
        F.col("o_custkey").alias("fk_customer"),
        date_key(F.col("o_orderdate").cast("date")).alias("fk_conversion_date"),
        F.col("o_orderdate").cast("date").alias("conversion_date"),
        F.col("o_orderstatus").alias("conversion_type"),
        F.col("o_orderpriority").alias("conversion_channel"),
        F.when(key % ORPHAN_MODULUS == 0, -key).otherwise(key).alias("order_number"),
    )


def conversions_dirty(spark: SparkSession, base: str) -> DataFrame:
    c = conversions(spark, base).select("conversion_id", "order_number")
    extra = c.where(F.col("conversion_id") % SECOND_ORDER_MODULUS == 0).select(
        "conversion_id", (F.col("order_number") + 1).alias("order_number"))
    return c.unionByName(extra)


def customers_shared(spark: SparkSession, base: str) -> DataFrame:
    """customer_dimension where some customer ids have two keys and some keys no id."""
    key = F.col("sk_customer")
    shared = F.when(key % NO_ID_MODULUS == 0, F.lit(None)).when(key % SHARED_MODULUS == 0, key - 1).otherwise(key)
    return customer_dimension(spark, base).withColumn("customer_id", shared.cast("int"))


def conversions_repeated(spark: SparkSession, base: str) -> DataFrame:
    """conversions with ids on two dates, rows that repeat, and unknown date keys."""
    twice, equal, unknown = REPEAT_MODULI
    c = conversions(spark, base)
    c = c.withColumn("fk_conversion_date", F.when(F.col("conversion_id") % unknown == 0, F.lit(19000101).cast("long"))
                     .otherwise(F.col("fk_conversion_date")))
    later = F.date_add("conversion_date", 45)
    again = (c.where(F.col("conversion_id") % twice == 0)
             .withColumns({"conversion_date": later, "fk_conversion_date": date_key(later), "order_number": F.col("order_number") + 1}))
    return c.unionByName(again).unionByName(c.where(F.col("conversion_id") % equal == 0))


def orders_renumbered(spark: SparkSession, base: str) -> DataFrame:
    """orders_fact where some order numbers belong to two orders."""
    n = F.col("order_number")
    return orders_fact(spark, base).withColumn("order_number", F.when(n % RENUMBER_MODULUS == 0, n - 1).otherwise(n))


def orders_fact(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    shifted = F.date_add(F.col("o_orderdate").cast("date"),
                         (F.col("o_orderkey") % ORDER_DATE_SHIFT).cast("int"))
    unit = F.col("o_totalprice").cast("decimal(18,2)")
    disc = (unit * F.lit(0.10).cast("decimal(2,2)")).cast("decimal(18,2)")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("order_number"),
        F.col("o_custkey").alias("fk_customer"),
        date_key(shifted).alias("fk_order_date"),
        unit.alias("unit_price"),
        disc.alias("discount_value"),
        (unit - disc).cast("decimal(18,2)").alias("price_paid"),
    )


def order_products(spark: SparkSession, base: str) -> DataFrame:
    """(order_number, fk_product) pairs for the order grain check."""
    li = read_table(spark, base, "lineitem").select("l_orderkey", "l_partkey")
    return li.select(F.col("l_orderkey").alias("order_number"),
                     F.col("l_partkey").alias("fk_product"))


def order_suppliers(spark: SparkSession, base: str) -> DataFrame:
    """(order_id, order_number) with the supplier in the number's place, so
    the one-to-many check has rows to find."""
    li = read_table(spark, base, "lineitem").select("l_orderkey", "l_suppkey")
    return li.select(F.col("l_orderkey").alias("order_id"),
                     F.col("l_suppkey").alias("order_number"))
