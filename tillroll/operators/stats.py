"""Summary statistics, exact percentiles and equal-width histograms.

Scale notes.

* ``summary_stats`` reads its input once: a grouped count per distinct
  value (partial aggregation, so a hot value costs one map entry per task),
  from which count, sum, min, max, mean, the centred second moment and the
  quartiles are all derived.
* ``exact_percentiles`` gives PERCENTILE_CONT exactly without Spark's
  ``percentile`` aggregate, whose final step merges a value->count map of
  every distinct value in one task. Here the distinct values (with their
  counts) are range-partitioned, each partition computes a running count,
  per-partition totals (one row per partition) give each partition its
  offset, and the ranks floor/ceil(p*(n-1)) are looked up with a join
  against a table of len(probs) rows. Nothing grows with the data in one
  task. The range-partitioned values are checkpointed so that both reads
  see the same partition assignment, also after a lost executor.
* The histogram joins a one-row (min, max) relation by broadcast and
  buckets with exact integer/decimal arithmetic, like numeric
  ``width_bucket``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.order import pg_asc, pg_desc
from tillroll.session import ensure_checkpoint_dir


def _value_counts_ranged(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` (NULL included) with their row counts,
    range-partitioned by value, with the partition id pinned by a reliable
    checkpoint: columns _v, _c, _p."""
    ensure_checkpoint_dir(df.sparkSession)
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # No explicit count: AQE may merge adjacent ranges of few distinct values.
    return (counts.repartitionByRange("_v")
            .withColumn("_p", F.spark_partition_id())
            .checkpoint(eager=True))


def _percentiles_from_ranged(ranged: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    spark = ranged.sparkSession
    ranged = ranged.where(F.col("_v").isNotNull())
    run_w = (Window.partitionBy("_p").orderBy("_v")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_run", F.sum("_c").over(run_w))
    part_tot = ranged.groupBy("_p").agg(F.sum("_c").alias("_pn"))
    # One row per partition: a global window over it is bounded.
    off_w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_tot.select("_p", F.coalesce(F.sum("_pn").over(off_w), F.lit(0)).alias("_off"))
    cum = local.join(F.broadcast(offsets), "_p").select(
        "_v", "_c", (F.col("_off") + F.col("_run") - F.col("_c")).alias("_first"))

    total = part_tot.agg(F.sum("_pn").alias("_n"))
    wanted = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probs)], "_i int, _q double")
    pos = F.col("_q") * (F.col("_n") - 1)
    targets = F.broadcast(wanted.crossJoin(total).select(
        "_i", pos.alias("_pos"),
        F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi")))

    def pick(rank_col: str, out: str) -> DataFrame:
        hit = (F.col("_first") <= F.col(rank_col)) & (F.col(rank_col) < F.col("_first") + F.col("_c"))
        return cum.join(targets, hit).select("_i", F.col("_v").cast("double").alias(out))

    res = (targets.join(pick("_lo", "_vlo"), "_i", "left")
           .join(pick("_hi", "_vhi"), "_i", "left")
           .select("_i", (F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo")))
                   .alias("_val")))
    return res.agg(*[F.max(F.when(F.col("_i") == i, F.col("_val"))).alias(n) for i, n in enumerate(names)])


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float],
                      names: Sequence[str] | None = None) -> DataFrame:
    """One row: PERCENTILE_CONT(p) of the non-NULL values of ``col`` for
    each p, as DOUBLE (NULL when there are no values)."""
    names = list(names) if names else [f"p{int(round(p * 100))}" for p in probs]
    return _percentiles_from_ranged(_value_counts_ranged(df, col), probs, names)


def summary_stats(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Non-NULL count, rows, min, max, avg, sum, sample stddev, quartiles
    and IQR of ``col``, in one row.

    One pass over ``df``: everything is computed from the count of each
    distinct value (a hot value is combined map-side). Sums over DECIMAL
    values are exact; the sample variance is the centred second moment
    sum(c * (v - mean)^2) / (n - 1), computed after the mean is known, so it
    does not lose precision the way the sum-of-squares formula does.
    """
    name = name or col
    dtype = df.schema[col].dataType
    ranged = _value_counts_ranged(df, col)
    v, c = F.col("_v"), F.col("_c")
    if isinstance(dtype, T.DecimalType):
        sum_type = T.DecimalType(min(38, dtype.precision + 10), dtype.scale)
        avg_type = T.DecimalType(min(38, dtype.precision + 4), min(38, dtype.scale + 4))
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        sum_type, avg_type = T.LongType(), T.DoubleType()
    else:
        sum_type, avg_type = T.DoubleType(), T.DoubleType()
    known = v.isNotNull()
    moments = ranged.agg(
        F.coalesce(F.sum(F.when(known, c).otherwise(0)), F.lit(0)).alias("non_null_rows"),
        F.coalesce(F.sum(c), F.lit(0)).alias("total_rows"),
        F.min(v).alias(f"min_{name}"),
        F.max(v).alias(f"max_{name}"),
        F.sum(v * c).cast(sum_type).alias(f"total_{name}"),
    )
    n = F.col("non_null_rows")
    moments = moments.withColumn(
        f"avg_{name}", F.when(n > 0, F.col(f"total_{name}") / n).cast(avg_type))
    mean = moments.select(F.col(f"avg_{name}").cast("double").alias("_mean"))
    m2 = (ranged.where(known).crossJoin(F.broadcast(mean))  # one-row side
          .agg(F.sum(c * F.pow(v.cast("double") - F.col("_mean"), 2)).alias("_m2")))
    q = _percentiles_from_ranged(ranged, [0.25, 0.5, 0.75],
                                 [f"q1_{name}", f"median_{name}", f"q3_{name}"])
    out = moments.crossJoin(m2).crossJoin(q)  # one row each
    stddev = F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1)))
    return out.select(
        "non_null_rows", "total_rows", f"min_{name}", f"max_{name}", f"avg_{name}",
        f"total_{name}", stddev.alias(f"stddev_{name}"),
        f"q1_{name}", f"median_{name}", f"q3_{name}",
        (F.col(f"q3_{name}") - F.col(f"q1_{name}")).alias(f"iqr_{name}"),
    )


def _bucket_expr(dtype: T.DataType, bins: int):
    """width_bucket(_x, _lo, _hi, bins) for _lo <= _x <= _hi; a constant
    column (lo = hi, an error in PostgreSQL) goes to bucket 1."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)) and bins < 1 << 30:
        inner = f"(CAST(_x AS BIGINT) - _lo) * {bins} div (CAST(_hi AS BIGINT) - _lo) + 1"  # fits 63 bits
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        # (x - lo) * bins div (hi - lo): exact integer quotient, no rounding, in
        # decimals so that neither the difference nor the product overflows.
        scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
        wide = f"DECIMAL({min(38, 21 + scale)}, {scale})"
        x, lo, hi = (f"CAST({c} AS {wide})" for c in ("_x", "_lo", "_hi"))
        inner = f"CAST((({x} - {lo}) * CAST({bins} AS DECIMAL(10,0))) div ({hi} - {lo}) AS BIGINT) + 1"
    else:
        inner = f"CAST(floor((_x - _lo) * {bins} / (_hi - _lo)) AS BIGINT) + 1"
    return F.expr(f"CAST(CASE WHEN _hi = _lo THEN 1 WHEN _x >= _hi THEN {bins + 1} "
                  f"WHEN _x < _lo THEN 0 ELSE {inner} END AS INT)")


def equi_width_histogram(df: DataFrame, col: str, bins: int = 20,
                         count_name: str = "row_count") -> DataFrame:
    """Equal-width histogram over [min, max] of the non-NULL values: bucket
    (1..bins, the max in bins+1), bucket min, bucket max, rows.

    The input is read once: both the bounds and the buckets come from the number
    of rows of each distinct value, whose exchange Spark makes once and reuses."""
    vals = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_x"))
            .agg(F.count(F.lit(1)).alias("_rows")))
    # The sum makes the two uses of ``vals`` one plan, which they must be to be shared.
    bounds = vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_rows").alias("_all")).where("_all > 0")
    j = vals.crossJoin(F.broadcast(bounds))  # one-row side
    bucket = _bucket_expr(df.schema[col].dataType, bins)
    return (
        j.groupBy(bucket.alias("bucket"))
        .agg(F.min("_x").alias("bucket_min"), F.max("_x").alias("bucket_max"),
             F.sum("_rows").alias(count_name))
        .orderBy(pg_asc("bucket"))
    )


def value_counts(df: DataFrame, col: str, count_name: str = "record_count") -> DataFrame:
    """Frequency of each value of ``col`` (NULL included), highest value first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name)).orderBy(pg_desc(col))
