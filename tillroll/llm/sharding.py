"""Shards of nearly equal bytes by sampled splitters.

1. Every row gets a sort key: the MD5 of its text, its id, and a random part
   that tells repeated rows apart. Equal texts lie side by side in key order.
2. Keys are drawn with odds in proportion to the row's size; the weighted
   quantiles of the draw are the splitters of ``ranges_per_shard`` ranges a
   shard, or more if a range would then pass ``range_rows`` rows.
3. A binary search over the splitters gives each row its range. The true bytes
   of all ranges are summed; a range that holds more than twice its share (its
   largest row aside) is drawn from again and subdivided, until none does.
4. Ranges get exact offsets in bytes and rows, rows a running sum inside their
   range. A row's shard is where the middle of its bytes falls when all bytes
   in key order are cut into equal stretches, so a shard's bytes differ from
   the mean by about one row's size. The sample decides only how the work is
   dealt, never the result.

DataFrame functions only. A hot key (a third of the rows with one text, or one
row repeated) is cut over many ranges, because id and random part belong to the
key. The driver holds the splitters, 8 ranges a shard and at least one for each
``range_rows`` rows, never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import saved

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Keys drawn for each range.
DRAWS = 32
RESULT = ("size", "shard", "slot", "part")


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long")


def _sort_key(text: Column, doc_id: Column) -> Column:
    number = F.lpad((doc_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.md5(F.coalesce(text, F.lit(""))), F.coalesce(number, F.lit(" " * 20)),
                    F.lpad(F.hex((F.rand() * F.lit(float(2**52))).cast("long")), 13, "0"))


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at most ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    listed = F.split(F.lit(",".join(splitters)), ",")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(listed, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def _splitters(rows: DataFrame, cell_bytes: Column, draws: int) -> list[str]:
    """Size-weighted quantiles of a draw from ``rows`` (_part, _key, _size), one
    about every ``cell_bytes`` bytes of each part."""
    odds = F.col("_size") * draws / cell_bytes
    drawn = rows.where(F.rand() < odds).select("_part", "_key", F.greatest(odds, F.lit(1.0)).alias("_w"))
    before = F.sum("_w").over(Window.partitionBy("_part").orderBy("_key"))
    cells = drawn.select("_part", "_key", F.floor(before / draws).alias("_cell"))
    firsts = cells.where("_cell > 0").groupBy("_part", "_cell").agg(F.min("_key").alias("_key"))
    return [r._key for r in firsts.select("_key").distinct().collect()]


def shard(docs: DataFrame, shards: int = 40, carry: list[str] | None = None, ranges_per_shard: int = 8,
          range_rows: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with size, shard (0 to ``shards`` - 1), slot (its
    place in the shard, from 0 without gaps) and part (the range it was dealt by).

    carry: the columns of ``docs`` that the result keeps, all by default. Columns
    of ``docs`` named like a result column give way to it. ids are whole numbers.
    A null text counts as empty, a null id sorts before all others; repeated rows
    are rows of their own. An empty table gives an empty result. With fewer rows
    than shards, or rows larger than a shard's share, some shards stay empty.

    Runs Spark jobs when called.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    # Pinned once, since the random part of the key must not change.
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    rows = saved(docs.select(row.alias("_row"), size_of(text).alias("_size"), _sort_key(text, doc_id).alias("_key")))
    total = rows.agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).first()
    total_bytes, n = total.bytes or 1, total.rows
    ranges = max(shards * ranges_per_shard, math.ceil(n / range_rows))
    share = max(1, total_bytes // ranges)

    splitters = sorted(_splitters(rows.withColumn("_part", F.lit(0)), F.lit(float(share)), DRAWS))
    draws = DRAWS
    while True:
        dealt = rows.withColumn("_part", _range_of(F.col("_key"), splitters))
        sizes = dealt.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.max("_size").alias("_largest"), F.count("*").alias("_rows"))
        sizes = saved(sizes)  # one row a range
        full = (F.col("_bytes") - F.col("_largest") > 2 * share) | (F.col("_rows") > 2 * range_rows)
        overfull = sizes.where(full).select(
            F.col("_part").alias("_full"),
            F.least(F.lit(float(share)), F.col("_bytes") / F.ceil(F.col("_rows") / range_rows)).alias("_cell_bytes"))
        if overfull.isEmpty():
            break
        inside = dealt.select("_part", "_key", "_size").join(overfull, F.col("_part") == F.col("_full"))
        splitters = sorted({*splitters, *_splitters(inside, F.col("_cell_bytes"), draws)})
        draws *= 2

    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_offset"))
    in_part = Window.partitionBy("_part").orderBy("_key")
    placed = (dealt.join(offsets, F.col("_part") == F.col("_of"))
              .withColumn("_number", F.row_number().over(in_part))
              .withColumn("_end", F.col("_offset") + F.sum("_size").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_shard", F.expr(f"CAST(least({shards - 1}, (2 * _end - _size) * {shards} div (2 * {total_bytes})) AS INT)")))
    cells = placed.groupBy(F.col("_part").alias("_p"), F.col("_shard").alias("_s")).agg(
        F.count("*").alias("_count"), F.min("_number").alias("_first"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    return placed.join(cells, (F.col("_part") == F.col("_p")) & (F.col("_shard") == F.col("_s"))).select(
        *[F.col("_row")[c].alias(c) for c in kept], F.col("_size").alias("size"), F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_number") - F.col("_first")).cast("long").alias("slot"), F.col("_part").alias("part"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes ``docs`` to ``path``/shard=0, 1, ...; a shard's files follow its
    slots, and several tasks share a shard, since each writes whole ranges."""
    dealt = shard(docs, shards)
    (dealt.repartitionByRange("shard", "part").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
