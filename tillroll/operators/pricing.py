"""Price history per item.

Scale notes. The LAG window is partitioned by item over the *monthly*
aggregate, so one item holds at most one row per month with sales, however
hot the item is in the raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.fmt import year_month_label
from tillroll.functions.order import pg_asc, total_order


def price_changes(sales: DataFrame, ts_col: str = "sale_datetime") -> DataFrame:
    """Months in which an item's price (the month's highest unit price)
    differs from the previous month with sales of that item. The first
    month on record counts as a change unless its price is NULL."""
    monthly = sales.groupBy(
        "article", F.trunc(F.col(ts_col), "month").alias("month_start"),
    ).agg(F.max("unit_price").alias("month_price"))
    return changes_from_monthly(monthly)


def changes_from_monthly(monthly: DataFrame) -> DataFrame:
    """``price_changes`` on (article, month_start, month_price) rows."""
    w = Window.partitionBy("article").orderBy(pg_asc("month_start"))
    changes = monthly.select(
        "article",
        year_month_label("month_start").alias("year_month"),
        "month_price",
        F.lag("month_price").over(w).alias("previous_price"),
    )
    return changes.where(~F.col("previous_price").eqNullSafe(F.col("month_price")))


def price_effective_months(top: DataFrame, changes: DataFrame) -> DataFrame:
    """Each (item, price) row of ``top`` with the month(s) in which that
    price began; a price that came back matches several months."""
    ch = changes.select(
        F.col("article").alias("_article"), F.col("month_price").alias("_price"), "year_month")
    j = top.join(ch, (top.article == ch._article) & (top.unit_price == ch._price), "left")
    out = j.select(*top.columns, "year_month")
    return out.orderBy(*total_order(out, [pg_asc("ranking"), pg_asc("year_month")]))
