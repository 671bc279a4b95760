"""Date dimension and week list.

The date dimension has one row per day, so its size is fixed by its two
end dates (about 366 rows a year) and never grows with the facts. That
bound is what makes it safe to broadcast. The built-in calendar knows its
number of days; of a table that is passed in, ``within_limit`` counts the rows,
as far as ``DAY_BROADCAST_LIMIT``, and beyond it the planner decides.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.fmt import iso_week_label

# A dimension longer than this many days is not broadcast.
DAY_BROADCAST_LIMIT = 200_000


def _as_date(d) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))


def date_key(c) -> F.Column:
    """yyyyMMdd surrogate key (BIGINT) of a date."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("bigint")


def date_dimension(spark: SparkSession, start="1995-01-01", end="2001-12-31") -> DataFrame:
    """One row per day in [start, end]: sk_date, d, year_week."""
    s, e = _as_date(start), _as_date(end)
    n_days = (e - s).days + 1
    days = spark.range(0, n_days, numPartitions=max(1, min(8, n_days // 4096 + 1)))
    d = F.date_add(F.lit(s), F.col("id").cast("int"))
    out = days.select(d.alias("d")).select(
        date_key(F.col("d")).alias("sk_date"), "d", iso_week_label("d").alias("year_week"))
    return F.broadcast(out) if n_days <= DAY_BROADCAST_LIMIT else out


def week_list(dates: DataFrame) -> DataFrame:
    """Distinct week labels of a date dimension with a dense ordinal.

    ``week_ord`` numbers the labels in label order (1-based). Labels are
    'YYYY-Www', zero padded, so label order is time order. The global
    window runs over the distinct labels only (about 53 a year).
    """
    labels = dates.where(F.col("year_week").isNotNull()).select("year_week").distinct()
    w = Window.orderBy("year_week")
    return labels.select("year_week", F.row_number().over(w).alias("week_ord"))


def day_weeks(dates: DataFrame, weeks: DataFrame) -> DataFrame:
    """sk_date -> (year_week, week_ord); bounded by the number of days."""
    return (dates.select("sk_date", "year_week").join(weeks, "year_week", "left")
            .select("sk_date", "year_week", "week_ord"))


def within_limit(dates: DataFrame, limit: int = DAY_BROADCAST_LIMIT) -> bool:
    """Whether ``dates`` has at most ``limit`` rows; counts no further than that."""
    return dates.select("sk_date").limit(limit + 1).count() <= limit


def week_tables(dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``week_list``, ``day_weeks``), broadcast if the dates are ``within_limit``.
    Runs a small Spark job."""
    weeks = week_list(dates)
    days = day_weeks(dates, weeks)
    return (F.broadcast(weeks), F.broadcast(days)) if within_limit(dates) else (weeks, days)
