"""Grain and referential checks on the star schema (empty result = the
assumption holds).

Scale notes. ``grain_violations`` is a distinct count: Spark expands it
into a dedupe on (key, value) and a count per key, both with map-side
combining, so a hot key costs one row per distinct value. ``orphan_rows``
is a left-anti join (NULL keys are orphans, as with LEFT JOIN ... IS NULL).
``first_week_mismatch`` reduces orders to one row per order number before the
join, and to one row per customer after it; the planner decides whether the
dates are small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grain_violations(df: DataFrame, key: str | Sequence[str], of: str,
                     max_distinct: int = 1, alias: str | None = None) -> DataFrame:
    """Keys with more than ``max_distinct`` distinct values of ``of``.

    Pass ``key=[k, of]`` for the literal form that groups by the counted
    column too (it can never return a row); ``max_distinct=0`` lists every
    key that has a value.
    """
    keys = [key] if isinstance(key, str) else list(key)
    name = alias or f"unique_{of}_count"
    return (
        df.groupBy(*keys)
        .agg(F.countDistinct(of).alias(name))
        .where(F.col(name) > max_distinct)
    )


def orphan_rows(left: DataFrame, right: DataFrame, on: str,
                cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` whose ``on`` value is not in ``right`` (NULL
    values included)."""
    # One row a key on the right: a repeated key there would not be split.
    out = left.join(right.select(on).distinct(), on=on, how="left_anti")
    return out.select(*cols) if cols else out


def first_week_mismatch_of_pairs(paired: DataFrame) -> DataFrame:
    """``first_week_mismatch`` from ``lifetime.pair_orders``: one grouped minimum."""
    firsts = paired.groupBy("fk_customer").agg(
        F.min("conversion_week").alias("first_conversion_week"), F.min("order_week").alias("first_order_week"))
    # The scripts join the two sides on the customer: a NULL key finds no orders.
    known = F.when(F.col("fk_customer").isNotNull(), F.col("first_order_week"))
    return firsts.withColumn("first_order_week", known).where(
        "first_conversion_week != first_order_week OR first_order_week IS NULL")


def first_week_mismatch(conversions: DataFrame, orders: DataFrame, dates: DataFrame) -> DataFrame:
    """Customers whose first conversion week differs from the first week of
    their conversions' orders, or who have no such order week."""
    dd = dates.select("sk_date", "year_week")  # broadcast by the planner if it is small
    conv = conversions.select("fk_customer", "fk_conversion_date", "order_number")
    first_conv = (
        conv.join(dd, conv.fk_conversion_date == dd.sk_date, "left")
        .groupBy("fk_customer").agg(F.min("year_week").alias("first_conversion_week"))
    )
    o = orders.select("order_number", "fk_order_date")
    # First week per order number before the join: one row a key on its right side.
    order_week = (o.join(dd, F.col("fk_order_date") == dd.sk_date)
                  .groupBy("order_number").agg(F.min("year_week").alias("year_week")))
    first_order = (
        conv.join(order_week, "order_number", "left")
        .groupBy("fk_customer").agg(F.min("year_week").alias("first_order_week"))
    )
    # Equality join: the NULL customer group never matches and is reported.
    j = first_conv.join(first_order, "fk_customer", "left")
    return j.where((F.col("first_conversion_week") != F.col("first_order_week"))
                   | F.col("first_order_week").isNull())
