"""ROW_NUMBER() per group that stays balanced when one group is huge.

``Window.partitionBy(key)`` sends every row of a key to one task. When a
key may hold a third of all rows, that task is the whole job. Here rows
are instead range-partitioned on (keys, order) -- Spark samples the
composite key, so a hot key is cut across several partitions -- and each
row's number is

    offset of its (partition, key) run + position inside the run + 1,

where a run's offset is the number of rows of the same key in earlier
partitions (a window over at most one row per partition per key). All
steps are DataFrame operations; no group is ever gathered in one place.

The partition id and the position come from ``spark_partition_id()`` and
``monotonically_increasing_id()`` right after a per-partition sort, and
are pinned with a reliable checkpoint so that every later read (and a
recomputation after a lost executor) sees the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.order import pg_asc
from tillroll.session import ensure_checkpoint_dir


def group_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                     out: str = "row_number", partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = ROW_NUMBER() OVER (PARTITION BY keys ORDER BY
    order). NULL keys form one group. Ties in ``order`` are numbered in an
    arbitrary but fixed order, as with ROW_NUMBER."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sort_cols = [pg_asc(k) for k in keys] + [pg_asc(c) if isinstance(c, str) else c for c in order]
    # Without an explicit count AQE may merge adjacent ranges of a small
    # input; merged ranges stay contiguous and ordered, which is all the
    # numbering needs.
    ranged = (df.repartitionByRange(partitions, *sort_cols) if partitions
              else df.repartitionByRange(*sort_cols))

    pinned = (
        ranged
        .sortWithinPartitions(*sort_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    runs = pinned.groupBy("_pid", *keys).agg(
        F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_len"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_pid").alias("_rpid"),
        *[F.col(k).alias(f"_rk{i}") for i, k in enumerate(keys)],
        "_start",
        F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_off"),
    )
    cond = [F.col("_pid") == F.col("_rpid")] + [
        F.col(k).eqNullSafe(F.col(f"_rk{i}")) for i, k in enumerate(keys)]
    j = pinned.join(runs, cond)
    number = F.col("_off") + F.col("_pos") - F.col("_start") + 1
    return j.select(*df.columns, number.alias(out))
