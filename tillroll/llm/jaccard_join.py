"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with ``100 * |A & B| >= percent * |A | B|`` share a token among the
first ``n - ceil(percent * n / 100) + 1`` tokens of each, whatever total order
of all tokens both use. Candidates must pass this test under every one of
``ORDERS`` orders, and a size test, before the sets themselves are compared.

* The orders put rare tokens first: tokens are counted over all texts in a
  table of ``2 ** COUNTER_BITS`` counters (each token adds to the counter that
  its hash names), and an order sorts by the logarithm of the counter and then
  by a hash of its own. A collision changes places in the order only, never a
  result: the filter holds for every order. The counters are a fixed number of
  bytes, whatever the input.
* The first order generates candidates: its prefix tokens are joined. The first
  token that two sets share must stand early enough in both for the rest to
  reach the similarity. The number of shared prefix tokens then bounds what the
  sets have in common: the prefix that ends earlier in the order has no token
  of the other set but the shared ones. Few candidates pass. The prefixes under
  the other orders have to overlap too, before sets are compared.
* Texts with equal sets are one class from the start; only its smallest id
  takes part. Inside a group that shares a prefix token, all members are first
  compared with a few pivots. What the resulting links connect needs no
  further pair; only pairs of different components are enumerated after that,
  so a group of near copies is linked by a star instead of by all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import sieve
from .components import connected_components
from .runtime import lean, prepare, saved
from .textarrays import seeded, text_sets

COUNTER_BITS, BLOCK = 22, 4096
ORDERS = (1, 2, 3)
_TOP = np.uint64(64 - COUNTER_BITS)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (seeded(tokens, 9) >> _TOP).astype(np.int64)


def token_classes(texts: DataFrame, k: int) -> bytes:
    """The rarity class of every counter: floor(4 * log2(1 + tokens counted)),
    one byte each, counted over the shingle sets of the column ``text``."""

    def count(batches):
        table = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in lean(batches):
            for _, _, tokens, _ in text_sets(batch.column(0), k):
                slot, n = np.unique(_slots(tokens), return_counts=True)
                table[slot] += n.astype(np.uint32)
        small = np.minimum(table, 65535).astype(np.uint16).reshape(-1, BLOCK)
        full = np.flatnonzero(small.any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 64)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([small[i].tobytes() for i in part], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint64)
        for raw in table.column("counts"):
            total += np.frombuffer(raw.as_buffer(), np.uint16)
        level = np.minimum(255, np.floor(4 * np.log2(1.0 + total))).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1], "levels": pa.array([level.tobytes()], pa.binary())})

    rows = (texts.select("text").mapInArrow(count, "block int, counts binary")
            .groupBy("block").applyInArrow(add, "block int, levels binary").collect())  # a fixed size at most
    out = np.zeros((1 << COUNTER_BITS) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK)
    for r in rows:
        out[r.block] = np.frombuffer(r.levels, np.uint8)
    return out.tobytes()


def _prefix(tokens: np.ndarray, keys: np.ndarray, bounds: np.ndarray, percent: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, offsets, last key) of every set's prefix under the order that ``keys`` give."""
    n = np.diff(bounds)
    length = np.where(n > 0, n + (-percent * n) // 100 + 1, 0)
    picked, last = [np.zeros(0, tokens.dtype)], np.zeros(len(n), np.uint64)
    for i, (a, c, p) in enumerate(zip(bounds[:-1], n, length, strict=True)):
        if p:
            at = np.argpartition(keys[a:a + c], p - 1)[:p]
            at = at[np.argsort(keys[a:a + c][at])]
            picked.append(tokens[a:a + c][at])
            last[i] = keys[a + at[-1]]
    return np.concatenate(picked), np.concatenate([[0], np.cumsum(length)]), last


def _keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    return (levels[_slots(tokens)].astype(np.uint64) << np.uint64(56)) | (seeded(tokens, order) >> np.uint64(8))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _is_link(percent: int):
    """Of two packed sorted sets: whether they are similar enough, exactly."""

    @arrow_udf("boolean")
    def verify(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.array(out, pa.bool_())

    return verify


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                       percent: int = 90) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of ``docs``.

    A text's words are maximal runs of bytes other than space and 0x09 to
    0x0D, with A-Z folded; its set holds its distinct ``k``-word shingles, or
    its whole word sequence if it has fewer words. Two texts are linked when
    ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest id
    reachable by links.

    Null and empty texts and texts without words have n_shingles 0 and their
    own id as component_id. Rows that repeat an id count as one document with
    several texts: their links all belong to the id. A row with a null id gets
    a null component_id and links nothing. Other columns are ignored.

    Shingles are compared by 64-bit hashes, classes of equal sets by 128-bit
    hashes. Runs Spark jobs when called.
    """
    spark = prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(token_classes(d, k))

    def sign(batches):
        levels = np.frombuffer(table.value, np.uint8)
        for batch in lean(batches):
            ids = batch.column(0)
            for a, b, tokens, bounds in text_sets(batch.column(1), k):
                digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(tokens[x:y].tobytes()), np.int64)
                                   for x, y in zip(bounds[:-1], bounds[1:], strict=True)], np.int64).reshape(-1, 2)
                first, off, last = _prefix(tokens, _keys(tokens, levels, ORDERS[0]), bounds, percent)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     _lists(first.view(np.int64), off, pa.int64()), pa.array((last ^ np.uint64(1 << 63)).view(np.int64))],
                    ["id", "n", "hi", "lo", "prefix", "last"])

    signed = saved(d.mapInArrow(sign, "id long, n long, hi long, lo long, prefix array<long>, last long"))
    whole = signed.where("n > 0 and id is not null")
    classes = whole.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    postings = (whole.join(classes, ["hi", "lo"]).where("id = rep")
                .select("id", "n", "last", F.posexplode("prefix").alias("pos", "token")))
    shared = saved(postings.groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("token"))
    # Sieves keep what cannot match out of the next two shuffles; the joins decide.
    live = saved(postings.where(sieve.sifted(sieve.build(shared, "token"))("token")).join(shared, "token").distinct())

    def measure(batches):
        levels = np.frombuffer(table.value, np.uint8)
        for batch in lean(batches):
            for a, b, tokens, bounds in text_sets(batch.column(1), k):
                packed = [tokens[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                more = [_lists(*_prefix(seeded(tokens, 5).astype(np.int32), _keys(tokens, levels, o), bounds, percent)[:2], pa.int32())
                        for o in ORDERS[1:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), pa.array(packed, pa.binary()), *more],
                    ["id", "size", "tokens", *(f"p{o}" for o in ORDERS[1:])])

    # The shared prefix tokens of each set: what a pair has in common among prefixes.
    lists = saved(live.groupBy("id", "n", "last").agg(F.collect_set("token").alias("tokens")))
    common = F.ceil(F.expr("n + m") * percent / (100 + percent) - 1e-9)  # tokens in both sets, at least

    def candidates(met: DataFrame) -> DataFrame:
        """Pairs (a, b) that can be similar, from rows (x, n, pos, y, m, at): a
        shared token's place in the prefixes of x and y."""
        sized = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & F.expr("x != y")
        early = (F.expr("n - pos") >= common) & (F.expr("m - at") >= common)
        pairs = met.where(sized & early).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = lists.select(F.col("id").alias("a"), "n", "last", "tokens")
        right = lists.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("last").alias("end"), F.col("tokens").alias("others"))
        prefix = lambda c: c - F.ceil(c * percent / 100 - 1e-9) + 1
        earlier = F.when(F.expr("last <= end"), F.col("n")).otherwise(F.col("m"))
        shared_tokens = F.size(F.array_intersect("tokens", "others"))
        return (pairs.join(left, "a").join(right, "b").where(prefix(earlier) - shared_tokens <= earlier - common)
                .select("a", "b").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs (a, b)."""
        pairs = saved(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = saved(d.where(sieve.sifted(sieve.build(ids, "id"))("id")).join(ids, "id", "left_semi")
                     .mapInArrow(measure, "id long, size long, tokens binary, " + ", ".join(f"p{o} array<int>" for o in ORDERS[1:]))
                     .where("size > 0"))
        left = sets.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in sets.columns if c != "id"))
        right = sets.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in sets.columns if c != "id"))
        near = F.lit(True)
        for o in ORDERS[1:]:
            near &= F.arrays_overlap(f"a_p{o}", f"b_p{o}")
        both = pairs.join(left, "a").join(right, "b").where(near)
        return both.where(_is_link(percent)("a_tokens", "b_tokens")).select("a", "b").distinct()

    one = F.struct("id", "n", "pos")
    chosen = live.groupBy("token").agg(F.min(one).alias("p0"), F.max(one).alias("p1"), F.min_by(one, F.xxhash64("id")).alias("p2"))
    pivots = (chosen.select("token", F.explode(F.array_distinct(F.array("p0", "p1", "p2"))).alias("p"))
              .select("token", F.col("p.id").alias("y"), F.col("p.n").alias("m"), F.col("p.pos").alias("at")))
    links = saved(linked(candidates(live.withColumnRenamed("id", "x").join(pivots, "token"))))

    def named(found: DataFrame) -> DataFrame:
        """(id, component) of the ids that a link touches; those in no link are their own."""
        return connected_components(found).select(F.col("node").alias("id"), "component")

    tagged = saved(live.join(named(links), "id", "left").withColumn("component", F.coalesce("component", "id")))
    # What a component can offer at a token: the longest rest from it on, and its least and greatest set.
    parts = tagged.groupBy("token", "component").agg(F.max(F.expr("n - pos")).alias("rest"), F.min("n").alias("low"), F.max("n").alias("high"))
    split = parts.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    open_parts = saved(parts.join(split, "token"))
    ours = open_parts.select("token", F.col("component").alias("ca"), F.col("rest").alias("ra"), F.col("low").alias("la"), F.col("high").alias("ha"))
    theirs = open_parts.select("token", F.col("component").alias("cb"), F.col("rest").alias("rb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    least = F.ceil(F.expr("la + lb") * percent / (100 + percent) - 1e-9)
    crossing = (ours.join(theirs, "token")
                .where((F.expr("ca < cb")) & (F.expr("least(ra, rb)") >= least)
                       & (F.expr("ha * 100") >= F.expr(f"lb * {percent}")) & (F.expr("hb * 100") >= F.expr(f"la * {percent}")))
                .select("token", "ca", "cb"))
    first = tagged.select("token", F.col("component").alias("ca"), F.col("id").alias("x"), "n", "pos")
    second = tagged.select("token", F.col("component").alias("cb"), F.col("id").alias("y"), F.col("n").alias("m"), F.col("pos").alias("at"))
    rest = candidates(crossing.join(first, ["token", "ca"]).join(second, ["token", "cb"]))
    more = saved(linked(rest.join(links, ["a", "b"], "left_anti")))
    final = named(links.union(more))

    member = (whole.select("id", "hi", "lo").distinct().join(classes, ["hi", "lo"]))
    # An id with several texts ties their classes together.
    tied = saved(member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b"))
    if tied.head(1):
        ties = member.join(tied.select("id", "a"), "id").where("rep != a").select("a", F.col("rep").alias("b"))
        final = named(links.union(more).union(ties))
    reach = (member.groupBy("id").agg(F.min("rep").alias("rep"))
             .join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
             .select("id", F.coalesce("component", "rep").alias("component")))
    return (signed.select("id", F.col("n").alias("n_shingles")).join(reach, "id", "left")
            .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")))
