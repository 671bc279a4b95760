"""Joins of points to the intervals that hold them.

``point >= lo AND point < hi`` without an equality makes Spark compare every point
with every interval. Here both sides are cut into bins, the join is on bins, and
the bounds are checked on its pairs:

* an interval belongs to the level whose bins are a power of two cells (of ``unit``
  numbers) wide, more than lie between its ends, so it meets at most two bins;
* a point goes to its one bin on each level that some interval has; there are at
  most 64 levels, and as many as the intervals' lengths differ by powers of two.

Long and short intervals may be mixed: a few very long ones meet points only on
their own level. Optional equality keys are part of the join as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str,
               on: Sequence[tuple[str, str]] = (), unit: int = 1) -> DataFrame:
    """Pairs with ``lo <= point < hi`` (all whole numbers) and equal ``on`` columns
    (name in points, name in intervals). All columns of both sides; their names
    must differ. NULL points, bounds or keys and empty intervals match nothing.
    unit: the width of the finest bins. Runs a small Spark job for the levels.
    """
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    shifted = lambda c, by: F.call_function("shiftright", c, by)
    cell = lambda c: F.call_function("div", c - F.pmod(c, F.lit(unit).cast("long")), F.lit(unit)) if unit > 1 else c.cast("long")
    low, high = cell(F.col(lo)), cell(F.col(hi) - 1)
    # Bit length of the number of cells between: bins of that width, two at most.
    level = F.when(high > low, F.length(F.bin(high - low))).otherwise(0)
    wide = intervals.where(F.col(lo) < F.col(hi)).withColumn("_ilevel", level)
    levels = sorted(r._ilevel for r in wide.select("_ilevel").distinct().collect())  # at most 64
    cells = wide.withColumn("_ibin", F.explode(F.sequence(shifted(low, F.col("_ilevel")), shifted(high, F.col("_ilevel")))))
    placed = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    placed = placed.withColumn("_bin", shifted(cell(F.col(point)), F.col("_level")))
    cond = (F.col("_level") == F.col("_ilevel")) & (F.col("_bin") == F.col("_ibin"))
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    held = placed.join(cells, cond & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi)))
    return held.select(*points.columns, *intervals.columns)
