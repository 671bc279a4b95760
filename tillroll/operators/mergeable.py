"""Distinct counts and quantiles that are kept per month and combined on demand.

COUNT(DISTINCT ...) of a quarter cannot be had from its months' counts, so the
plain reports read the fact again for every period. Here a period keeps its set:

* ``distinct_sets``: exact, bitmaps of 32,768 values each. A period's set is one
  row for each stretch of values that it has, so memory and shuffle follow the
  stretches, not the rows; the union is a bitwise OR. Meant for dense whole-number
  ids (ticket and order numbers); ids scattered over a wide range cost 4 KB each.
* ``sketches``: opt-in approximations of any column, Spark's HyperLogLog and KLL
  sketches. A period is one row of bounded size. Exact stays the default of all
  other reports.

Both aggregate on the map side first; a hot group is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches: 2**LG_K registers (error about 1.04 / sqrt(2**LG_K)),
#: and KLL's k (rank error about 1.65 % at 200, falling as k rises).
LG_K, KLL_K = 14, 400


def distinct_sets(df: DataFrame, keys: Sequence[str | Column], value: str) -> DataFrame:
    """``keys``, bucket, bits: the set of the whole numbers in ``value`` for each
    group. NULLs are in no set; a group of NULLs only has no row."""
    v = F.col(value).cast("long")
    return (df.where(v.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(v).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits")))


def union_sets(sets: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The sets of coarser groups: ``keys`` over the key columns of ``sets``."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_sizes(sets: DataFrame, keys: Sequence[str], out: str = "distinct_count") -> DataFrame:
    """``keys`` and the number of members of each group's set."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(out))


def sketches(df: DataFrame, keys: Sequence[str | Column], counted: str, measured: str) -> DataFrame:
    """``keys``, members (HyperLogLog of ``counted``), spread (KLL of ``measured``).
    NULLs are left out."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(counted, F.lit(LG_K)).alias("members"),
                                 F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(KLL_K)).alias("spread"))


def merge_sketches(kept: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The sketches of coarser groups."""
    return kept.groupBy(*keys).agg(F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("spread").alias("spread"))


def estimates(kept: DataFrame, keys: Sequence[str], ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``keys``, distinct_estimate and quantiles (an array, one for each rank)."""
    return kept.select(*keys, F.hll_sketch_estimate("members").alias("distinct_estimate"),
                       F.kll_sketch_get_quantile_double("spread", F.array(*[F.lit(float(r)) for r in ranks])).alias("quantiles"))
