"""Ranked reports over a sales fact.

The sales fact has one row per ticket line with columns ticket_number,
sale_date, sale_time / sale_datetime, article, quantity (negative for a
return) and unit_price.

Scale notes. Every report aggregates first (partial + final hash
aggregate, so a hot item or ticket is combined map-side) and ranks the
aggregated rows. Top-k cut-offs are written as ``rank <= n`` filters
(WindowGroupLimit runs before the shuffle) or ``orderBy().limit(n)``
(TakeOrderedAndProject: a per-partition top-k, then a merge of k rows per
partition). The only broadcasts are of top-k results, bounded by n.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.clock import hour_of
from tillroll.functions.fmt import currency_text, hour_window_label, year_month_label
from tillroll.functions.order import pg_asc, pg_desc, total_order


def _revenue():
    """Line revenue: quantity (INT) x unit_price (DECIMAL), exact."""
    return F.col("quantity") * F.col("unit_price")


def top_items_by_month(sales: DataFrame, n: int = 3, date_col: str = "sale_date",
                       ties: str = "rank") -> DataFrame:
    """Per month and item: units, revenue, distinct tickets; items with
    RANK() <= n by units inside the month (ties kept, so a month may list
    more than n items). ``ties="row_number"`` keeps exactly n, ties broken
    by item name."""
    if ties not in ("rank", "row_number"):
        raise ValueError("ties must be 'rank' or 'row_number'")
    monthly = sales.groupBy(
        F.trunc(F.col(date_col), "month").alias("month_start"),
        F.col("article").alias("item_name"),
    ).agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum(_revenue()).alias("total_revenue"),
        F.countDistinct("ticket_number").alias("unique_tickets"),
    )
    if ties == "rank":
        w = Window.partitionBy("month_start").orderBy(pg_desc("total_quantity_sold"))
        number = F.rank().over(w)
    else:
        w = Window.partitionBy("month_start").orderBy(pg_desc("total_quantity_sold"), pg_asc("item_name"))
        number = F.row_number().over(w)
    ranked = monthly.withColumn("rank_by_qty", number).where(F.col("rank_by_qty") <= n)
    return ranked.select(
        year_month_label("month_start").alias("year_month"), "item_name",
        "total_quantity_sold", "total_revenue", "unique_tickets", "rank_by_qty",
    ).orderBy(pg_asc("year_month"), pg_asc("rank_by_qty")).drop("rank_by_qty")


def tickets_with_min_items(sales: DataFrame, start, end, min_items: int = 5) -> DataFrame:
    """Tickets in [start, end) with at least ``min_items`` distinct articles."""
    start, end = _as_date(start), _as_date(end)
    in_range = sales.where((F.col("sale_date") >= F.lit(start)) & (F.col("sale_date") < F.lit(end)))
    return (
        in_range.groupBy(F.col("ticket_number").alias("ticket_id"))
        .agg(F.countDistinct("article").alias("number_of_unique_items"))
        .where(F.col("number_of_unique_items") >= min_items)
        .orderBy(pg_desc("number_of_unique_items"), pg_asc("ticket_id"))
    )


def peak_hour(sales: DataFrame, item: str, month: int, time_col: str = "sale_time",
              date_col: str = "sale_date") -> DataFrame:
    """The hour of day with most units of ``item`` in calendar month
    ``month`` over all years; ties go to the earliest hour."""
    picked = sales.where((F.col("article") == item) & (F.month(date_col) == month))
    return (
        picked.groupBy(hour_of(sales, time_col).alias("sale_hour"))
        .agg(F.sum("quantity").alias("total_quantity_sold"))
        .orderBy(pg_desc("total_quantity_sold"), pg_asc("sale_hour"))
        .limit(1)
    )


def best_adjacent_hours(sales: DataFrame, width: int = 2, lo: int = 0, hi: int = 23,
                        time_col: str = "sale_time", last_start: int | None = None) -> DataFrame:
    """Best window of ``width`` adjacent hours by units, then revenue, then
    start hour. Hours lo..hi are listed (empty ones count as 0); windows start
    at lo..hi - width + 1, so none passes the last hour. ``hi=22,
    last_start=22`` gives the original list, which leaves hour 23 out."""
    hourly = sales.groupBy(hour_of(sales, time_col).alias("hour_of_day")).agg(
        F.sum("quantity").alias("hourly_quantity"),
        F.sum(_revenue()).alias("hourly_revenue"),
    )
    spark = sales.sparkSession
    hours = spark.range(lo, hi + 1, numPartitions=1).select(F.col("id").cast("int").alias("hour_of_day"))
    buckets = hours.join(hourly, "hour_of_day", "left").select(
        "hour_of_day",
        F.coalesce("hourly_quantity", F.lit(0)).alias("hourly_quantity"),
        F.coalesce("hourly_revenue", F.lit(0)).alias("hourly_revenue"),
    )
    # A window over at most 24 aggregated rows: one partition is fine.
    w = Window.orderBy("hour_of_day").rowsBetween(Window.currentRow, width - 1)
    windows = buckets.select(
        F.col("hour_of_day").alias("start_hour"),
        (F.col("hour_of_day") + width).alias("end_hour"),
        F.sum("hourly_quantity").over(w).alias("total_quantity_sold"),
        F.sum("hourly_revenue").over(w).alias("total_revenue"),
    )
    latest = hi - width + 1 if last_start is None else last_start
    best = windows.where(F.col("start_hour") <= latest).orderBy(pg_desc("total_quantity_sold"), pg_desc("total_revenue"),
                           pg_asc("start_hour")).limit(1)
    return best.select(
        hour_window_label("start_hour", "end_hour").alias("two_hour_window"),
        "total_quantity_sold", "total_revenue",
    )


def revenue_by_month(sales: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """Revenue per month, with a 'YYYY-MM' label and currency text."""
    by_month = sales.groupBy(F.trunc(F.col(date_col), "month").alias("year_month")).agg(
        F.sum(_revenue()).alias("total_revenue"))
    return by_month.select(
        "year_month",
        year_month_label("year_month").alias("year_month_char"),
        "total_revenue",
        currency_text("total_revenue").alias("total_revenue_char"),
    ).orderBy(pg_asc("year_month"))


def top_ticket_lines(sales: DataFrame, n: int = 10, ts_col: str = "sale_datetime") -> DataFrame:
    """All lines of the ``n`` tickets with most revenue (ties by ticket
    number), with line and ticket revenue as currency text."""
    per_ticket = sales.groupBy("ticket_number").agg(F.sum(_revenue()).alias("ticket_total_revenue_num"))
    top = per_ticket.orderBy(pg_desc("ticket_total_revenue_num"), pg_asc("ticket_number")).limit(n)
    # ``top`` holds at most n rows: a bounded broadcast.
    lines = sales.join(F.broadcast(top), "ticket_number")
    return lines.orderBy(*total_order(lines, [
        pg_desc("ticket_total_revenue_num"), "ticket_number", ts_col, "article"])).select(
        year_month_label(ts_col).alias("year_month"),
        "ticket_number",
        F.col("article").alias("item_name"),
        "quantity",
        currency_text("unit_price").alias("unit_price"),
        currency_text(_revenue()).alias("line_revenue"),
        currency_text("ticket_total_revenue_num").alias("ticket_total_revenue"),
    )


def _rank_items(per_item: DataFrame, n: int) -> DataFrame:
    order = [pg_desc("total_revenue"), pg_asc("item_name")]
    # Cut to n rows first; the numbering window then runs over n rows only.
    top = per_item.orderBy(*order).limit(n)
    return top.withColumn("ranking", F.row_number().over(Window.orderBy(*order)))


def _kept(sales: DataFrame, exclude) -> DataFrame:
    # ``article NOT IN exclude`` is NULL for a NULL article: dropped too.
    return sales.where(~F.col("article").isin(list(exclude))) if exclude else sales


def top_items(sales: DataFrame, n: int = 20, exclude=(".",)) -> DataFrame:
    """The ``n`` items with most revenue, ranked 1..n (ROW_NUMBER, ties by
    name). ``article NOT IN exclude`` also drops NULL articles."""
    per_item = _kept(sales, exclude).groupBy(F.col("article").alias("item_name")).agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum(_revenue()).alias("total_revenue"),
    )
    return _rank_items(per_item, n)


def top_items_price_breakdown(sales: DataFrame, n: int = 20, exclude=(".",)) -> DataFrame:
    """Revenue of each of the top ``n`` items per unit price.

    One pass over ``sales``: revenue per (item, price) is aggregated once;
    the item ranking sums those partial sums (exact for DECIMAL, and NULL
    only where every line is NULL, as a direct sum), and the top-n items are
    joined back on the aggregate, not on the raw lines."""
    by_price = sales.groupBy("article", "unit_price").agg(
        F.sum("quantity").alias("_qty"), F.sum(_revenue()).alias("price_revenue"))
    ranked = rank_items(by_price, n, exclude)
    return _by_revenue(by_price.join(F.broadcast(ranked), by_price.article == ranked.item_name))  # n rows


def rank_items(sums: DataFrame, n: int = 20, exclude=(".",)) -> DataFrame:
    """(item_name, ranking) of the top ``n`` items from partial sums: article,
    _qty, price_revenue."""
    per_item = _kept(sums, exclude).groupBy(F.col("article").alias("item_name")).agg(
        F.sum("_qty").alias("total_quantity_sold"),
        F.sum("price_revenue").alias("total_revenue"),
    )
    return _rank_items(per_item, n).select("item_name", "ranking")


def price_breakdown(sales: DataFrame, ranked: DataFrame) -> DataFrame:
    """Revenue per unit price of the items of ``ranked`` (item_name, ranking),
    whose lines alone are grouped."""
    theirs = sales.join(F.broadcast(ranked), sales.article == ranked.item_name)  # n rows
    return _by_revenue(theirs.groupBy("article", "ranking", "unit_price").agg(F.sum(_revenue()).alias("price_revenue")))


def _by_revenue(rows: DataFrame) -> DataFrame:
    return rows.select("article", "ranking", "unit_price", "price_revenue").orderBy(
        pg_desc("price_revenue"), pg_asc("article"), pg_asc("unit_price"))


def _as_date(d):
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))
