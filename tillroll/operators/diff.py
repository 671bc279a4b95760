"""The rows in which two tables differ.

Row count and highest total (``lifetime.reconcile``) miss faults that make up
for each other. Here each table is digested by ranges of its hashed key: the
number of rows and sums of two row hashes, which do not depend on order and are
combined before the shuffle, so a level costs a scan and one small row a range
and task. Only ranges whose digests differ are divided again, a level deeper;
when few rows are left in them, or most rows are, those rows are compared value
by value. Equal tables cost one scan each and no shuffle of rows. Of tables that
differ, the rows of differing ranges are picked by a broadcast of the ranges
(at most ``BROADCAST_RANGES``) in one more scan each and written; deeper levels
and the comparison read those rows only.

Digests decide only what is looked at: a range whose rows differ passes for equal
if number and all sums of both 64-bit hashes agree by chance, odds of about
2**-128. The sums are of pieces of a hash, ``PIECE_BITS`` each, as longs: exact
up to 2**39 rows a range, without a decimal for every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

#: Bits of the key's hash that each level adds, the level begun with, and the most.
LEVEL_BITS, FIRST_LEVEL, LEVELS = 10, 2, 4
#: Bits of a hash that are summed together.
PIECE_BITS = 24
#: Ranges that are sent to all tasks: as many as the first level has.
BROADCAST_RANGES = 1 << LEVEL_BITS * FIRST_LEVEL
#: Rows of differing ranges that are compared without dividing further.
LEAF_ROWS = 1_000_000


def _range_at(keys: Sequence[str], level: int) -> Column:
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    return F.shiftrightunsigned(hashed, 64 - LEVEL_BITS * level)


def _digests(df: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    hashed = df.select(_range_at(keys, level).alias("_range"), F.xxhash64(*cols).alias("_h"), F.xxhash64(F.lit(1), *cols).alias("_g"))
    piece = lambda h, at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << PIECE_BITS) - 1))
    return hashed.groupBy("_range").agg(
        F.count("*").alias("_rows"),
        *[F.sum(piece(h, at)).alias(f"{h}{at}") for h in ("_h", "_g") for at in range(0, 64, PIECE_BITS)])


def _compared_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    """(_range, _rows, _differs) of all ranges, with the rows of both tables."""
    a, b = _digests(left, keys, level), _digests(right, keys, level)
    both = a.withColumn("_left", F.lit(1)).unionByName(b.withColumn("_left", F.lit(-1)))
    sums = [c for c in a.columns if c != "_range"]
    off = [F.sum(F.col(c) * F.col("_left")) != 0 for c in sums]
    return both.groupBy("_range").agg(F.sum("_rows").alias("_rows"), F.array_contains(F.array(*off), True).alias("_differs"))


def differing_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], level: int = 1) -> DataFrame:
    """(_range, _rows): ranges of the hashed key in which the tables differ, with
    the rows of both."""
    return _compared_ranges(left, right, keys, level).where("_differs").select("_range", "_rows")


def _in_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str], level: int, few: bool) -> DataFrame:
    found = ranges.select(F.col("_range").alias("_differs"))
    return df.join(F.broadcast(found) if few else found, _range_at(keys, level) == F.col("_differs"), "left_semi")


def differing_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows that ``left`` has more often than ``right``, or the other way round:
    all columns, ``side`` ('left' or 'right') and ``copies`` (how many more).

    Both tables have the same columns; order of rows and columns does not matter,
    NULLs are equal to each other. ``keys`` place a row in its range; a hot key
    makes a large range, which the last step compares in many tasks, by all
    columns. Runs Spark jobs when called.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the tables have different columns")
    ensure_checkpoint_dir(left.sparkSession)
    right = right.select(*[F.col(f"`{c}`").cast(left.schema[c].dataType) for c in left.columns])
    level = FIRST_LEVEL
    while True:
        compared = _compared_ranges(left, right, keys, level).checkpoint(eager=True)
        total, rows, n = compared.agg(F.sum("_rows"), F.sum(F.when(F.col("_differs"), F.col("_rows"))), F.count_if("_differs")).first()
        ranges, few = compared.where("_differs"), n <= BROADCAST_RANGES
        # Where most rows are left, neither picking them nor another level pays off.
        if rows and rows > total / 2:
            break
        left, right = (_in_ranges(df, ranges, keys, level, few).checkpoint(eager=True) for df in (left, right))
        if not rows or rows <= leaf_rows or level == LEVELS:
            break
        level += 1
    signed = left.withColumn("_left", F.lit(1)).unionByName(right.withColumn("_left", F.lit(-1)))
    counts = signed.groupBy(*[F.col(f"`{c}`") for c in left.columns]).agg(F.sum("_left").alias("_more")).where("_more != 0")
    return counts.select(*[F.col(f"`{c}`") for c in left.columns], F.when(F.col("_more") > 0, "left").otherwise("right").alias("side"),
                         F.abs("_more").alias("copies"))
