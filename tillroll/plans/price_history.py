"""The sales report session pipeline: price table and top-item table
are materialised once (the scripts' ``CREATE TEMP TABLE ... AS``), then
joined on (item, price).

The sales fact is read twice, each time into a small aggregate: first the highest
price, units and revenue per item and month (the price table, and which items are
the top ones), then units and revenue per price of the top items only. A cube over
(item, month, price) that holds both would be nearly as large as the fact. The
aggregate and both tables are reliable checkpoints in ``spark.checkpoint.dir``: a
lost executor does not force the lineage to be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.pricing import changes_from_monthly, price_effective_months
from tillroll.operators.ranking import price_breakdown, rank_items
from tillroll.sinks import snapshot


def price_history(sales: DataFrame, n: int = 20, ts_col: str = "sale_datetime",
                  exclude=(".",), price_view: str = "price_table",
                  top_view: str = "top20_table") -> DataFrame:
    """Top-``n`` items broken down by price, each price with the month(s)
    it began. Registers the two intermediate tables as temp views.
    """
    monthly = snapshot(
        sales.groupBy("article", F.trunc(F.col(ts_col), "month").alias("month_start"))
        .agg(F.max("unit_price").alias("month_price"), F.sum("quantity").alias("_qty"),
             F.sum(F.col("quantity") * F.col("unit_price")).alias("price_revenue")),
        "_item_months")
    changes = snapshot(changes_from_monthly(monthly), price_view)
    top = snapshot(price_breakdown(sales, rank_items(monthly, n, exclude)), top_view)
    return price_effective_months(top, changes)
