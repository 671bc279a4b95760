"""Data-quality reports: missing values, duplicates, drill-downs, and
date/time consistency.

Scale notes. ``null_profile`` and ``datetime_mismatch_count`` are one
global aggregate each (partial counts per task, one tiny merge).
``duplicate_groups`` is a grouped count: a row repeated a billion times is
one hash-map entry per task before the shuffle. ``rows_sharing_key`` is a
left-semi join; a hot key on the probe side is split by AQE's skew-join
handling, the key side holds keys only and is broadcast by AQE only when its
measured size is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.clock import date_plus_time
from tillroll.functions.order import pg_desc, total_order


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row count and ``missing_<col>`` NULL count for each column."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols],
    )


def rows_sharing_key(df: DataFrame, key: str, condition: Column, distinct_keys: bool = False) -> DataFrame:
    """All rows whose ``key`` also occurs on a row meeting ``condition``
    (e.g. every line of the tickets that have a line without a price).
    NULL keys never match.

    The key side is a plain filter of the fact, from which Spark can make a
    runtime Bloom filter that cuts the fact down before its shuffle (from
    ``spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold``
    on). ``distinct_keys`` reduces it to one row a key first, which Spark makes no
    such filter from: for conditions that a hot key meets on very many rows."""
    # The comparison says the same again: Spark makes a filter of comparisons, not of IS NULL.
    keys = df.where(condition & (condition > F.lit(False))).select(key)
    keys = keys.distinct() if distinct_keys else keys
    out = df.join(keys, on=key, how="left_semi")
    return out.orderBy(*total_order(out, [key]))


def duplicate_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Groups of rows equal on ``cols`` (NULLs equal) occurring more than
    once, with their size, largest first."""
    groups = (df.groupBy(*cols)
              .agg(F.count(F.lit(1)).alias("duplicate_count"))
              .where(F.col("duplicate_count") > 1))
    return groups.orderBy(*total_order(groups, [pg_desc("duplicate_count")]))


def drill_down(df: DataFrame, condition: Column | None = None,
               order_by: Sequence[str | Column] = ("ticket_number",),
               cols: Sequence[str] | None = None) -> DataFrame:
    """Rows meeting ``condition``, in ``order_by`` order (ascending, NULLs
    last, unless a Column with its own order is given), ties broken by the
    remaining columns. ``order_by`` names must be among ``cols``."""
    out = df if condition is None else df.where(condition)
    out = out.select(*cols) if cols else out
    return out.orderBy(*total_order(out, list(order_by))) if order_by else out


def datetime_mismatch_count(df: DataFrame, date_col: str = "sale_date",
                            time_col: str = "sale_time",
                            ts_col: str = "sale_datetime") -> DataFrame:
    """Count of rows where date + time differs from the stored timestamp
    (rows with a NULL part are not counted)."""
    combined = date_plus_time(df, date_col, time_col)
    stored = F.col(ts_col).cast("timestamp_ntz")
    return df.agg(F.count_if(combined != stored).alias("not_aligned"))
