"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles. Under one hash function a
shingle is the least of every run that holds it and nothing smaller: its
compact window, from behind the next smaller shingle to the left to before the
next smaller one to the right. These windows form the Cartesian tree of the
hashes; only those of ``WIDTH`` shingles or more matter, about ``2 / WIDTH`` a
shingle. All runs of that length of all texts are thereby grouped by their
signature, under each of ``HASHES`` functions.

* Windows with the same shingle under the same function join the texts. Each
  joins the first text (least id) that has such a window, not every other one,
  so a passage that many texts share gives one link a text. Of the windows of a
  shingle that a text repeats those inside another one are left out, so a text
  of one line over and over is one row a key, not one for each line.
* Where windows of ``AGREE`` functions that join the same two texts overlap, the
  two are compared shingle by shingle. A passage of at least ``min_words``
  words whose shingles reach the Jaccard similarity with one of the first text
  is a repeat. The first text keeps it.
* Where an earlier text has part of a passage only, functions divide between it
  and the first text that has all of the passage, and neither pair may reach
  ``AGREE``. So the windows with a centre in joined ranges that no repeat
  explains are joined once more, among themselves: the text with a part has
  none there that the others would join first.
* Last, runs of ``min_words`` words that lie in joined windows of all functions,
  and in no repeat, are looked up by a hash of the whole run: each that any
  earlier text has is a repeat of the first such text.

The centres of wide windows are the minima of the runs of exactly ``WIDTH``
shingles, which sliding minima find for all texts of a batch at once; the
neighbours that bound a wide window are such minima themselves.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import sieve
from .runtime import lean, prepare, saved
from .textarrays import chunks, mix64, seeded, shingles, span_hashes, utf8, words

SHINGLE, WIDTH, HASHES, AGREE = 5, 40, 8, 3
MIN_WORDS, SIMILARITY = 50, 0.8


class Walled:
    """Values laid out with one wall, smaller than everything, before each row
    and after the last: what the compact windows of all functions share."""

    def __init__(self, values: np.ndarray, row: np.ndarray, width: int) -> None:
        n = len(values)
        fresh = np.concatenate([[True], row[1:] != row[:-1]])[:n]
        place = np.arange(n) + np.cumsum(fresh)
        size = n + int(fresh.sum()) + 1
        self.width, self.bits = width, np.uint64(max(20, size.bit_length()))
        self.places = np.arange(size, dtype=np.uint64)
        self.walls = np.concatenate([place[fresh] - 1, [size - 1]])
        self.values = np.zeros(size, np.uint64)
        self.values[place] = values
        self.back = np.zeros(size, np.int64)
        self.back[place] = np.arange(n)

    def windows(self, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(left, centre, right, outer) of the compact windows of a function;
        outer is the centre of a window of an equal value that holds this window,
        -1 if there is none."""
        v = seeded(self.values, seed)
        v |= np.uint64(1 << 63)
        v >>= self.bits
        v <<= self.bits
        v |= self.places
        v[self.walls] = self.walls  # no hash above the place
        if len(v) < self.width:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        least, span = v, 1
        while 2 * span <= self.width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < self.width:
            least = np.minimum(least[:len(v) - self.width + 1], least[self.width - span:])
        # The least place moves on, never back.
        least = least[np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])]
        least = least[least >> np.uint64(63) == 1] & ((np.uint64(1) << self.bits) - np.uint64(1))
        at = np.sort(np.concatenate([least.astype(np.int64), self.walls]), kind="stable")
        value = v[at]
        is_wall = value >> np.uint64(63) == 0
        value[is_wall] = 0
        idx = np.flatnonzero(~is_wall)
        left, right = np.arange(len(at)) - 1, np.arange(len(at)) + 1
        for near in (left, right):
            todo = idx
            while len(todo):
                todo = todo[value[near[todo]] > value[todo]]
                near[todo] = near[near[todo]]
        centre, below = at[idx], at[left[idx]]
        held = ~is_wall[left[idx]] & (self.values[below] == self.values[centre])
        return self.back[below + 1], self.back[centre], self.back[at[right[idx]] - 1], np.where(held, self.back[below], -1)


def compact_windows(values: np.ndarray, row: np.ndarray, width: int, seed: int
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of every compact window of at least ``width``
    elements, as places in ``values``; windows do not cross rows. Equal values
    in a row: the leftmost counts as the smallest."""
    return Walled(values, row, width).windows(seed)[:3]


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = utf8(texts)
    for a, b in chunks(off):
        part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        row, start, end = words(part, o)
        yield a, b, span_hashes(part, start, end), row


def _windows(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """(function, keys, ids, left, centre, right, outer) of a batch (id, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b, h, row in _word_hashes(batch.column(1)):
        s, srow, _ = shingles(h, row, b - a, SHINGLE)
        first = np.searchsorted(srow, np.arange(b - a))
        laid = Walled(s, srow, width)
        for f in range(HASHES):
            left, centre, right, outer = laid.windows(100 + f)
            r = srow[centre]
            yield f, seeded(s[centre], 200 + f).view(np.int64), ids[a:b][r], left - first[r], centre - first[r], right - first[r], np.where(outer < 0, -1, outer - first[r])


def packed(left: np.ndarray, right: np.ndarray, f: int) -> np.ndarray:
    """Windows of a function as longs: 29 bits left, 30 bits length, 4 bits function."""
    return left.astype(np.int64) << 34 | (right - left).astype(np.int64) << 4 | f


def unpacked(windows: np.ndarray) -> np.ndarray:
    """(left, right, function) rows of packed windows."""
    left = windows >> 34
    return np.stack([left, left + (windows >> 4 & (1 << 30) - 1), windows & 15], axis=1)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` elements, from runs of powers of two."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    out, at, size, piece = np.zeros(n, np.uint64), 0, 1, values
    while size <= length:
        if length & size:
            out = mix64(out * factor + piece[at:at + n])
            at += size
        if 2 * size <= length:
            piece = mix64(piece[:-size] * factor + piece[size:])
        size *= 2
    return out


def covered(row: np.ndarray, windows: np.ndarray, agree: int, row_out: np.ndarray | None = None, out: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): the ranges of each row's shingles that windows
    (left, right, function) of at least ``agree`` functions cover, and none of
    the ranges ``out`` (first, last) of the rows ``row_out``."""
    order = np.argsort(row << 33 | windows[:, 2] << 29 | windows[:, 0])
    row, left, right, f = row[order], windows[order, 0], windows[order, 1], windows[order, 2]
    # Windows of one function count once wherever they overlap.
    reach = np.maximum.accumulate((row << 4 | f) << 30 | right) if len(row) else right
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] << 4 | f[1:]) << 30 | left[1:] > reach[:-1]
    begin = np.flatnonzero(fresh)
    end = np.concatenate([begin[1:], [len(row)]])[:len(begin)] - 1
    one, last = row[begin], reach[end] & (1 << 30) - 1
    if row_out is None or out is None:
        row_out, out = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    where = np.concatenate([one << 31 | left[begin], one << 31 | last + 1, row_out << 31 | out[:, 0], row_out << 31 | out[:, 1] + 1])
    order = np.argsort(where, kind="stable")
    where = where[order]
    counts = np.zeros((2, len(where)), np.int64)  # functions, ranges out
    n, m = len(one), len(row_out)
    counts[0, :2 * n] = np.repeat([1, -1], n)
    counts[1, 2 * n:] = np.repeat([1, -1], m)
    counts = counts[:, order].cumsum(axis=1)
    final = np.flatnonzero(np.concatenate([where[1:] != where[:-1], [True]])[:len(where)])
    inside = np.concatenate([[False], (counts[0, final] >= agree) & (counts[1, final] == 0), [False]])
    edge = np.diff(inside.astype(np.int8))
    a, b = where[final[np.flatnonzero(edge == 1)]], where[final[np.flatnonzero(edge == -1)]]
    return a >> 31, a & (1 << 31) - 1, (b & (1 << 31) - 1) - 1


def uncovered(row: np.ndarray, windows: np.ndarray, row_out: np.ndarray, repeated: np.ndarray, least: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (row, first, last) of at least ``least`` shingles that windows of
    ``AGREE`` functions cover, and none of the ranges ``repeated``."""
    r, a, b = covered(row, windows, AGREE, row_out, repeated)
    long = b - a + 1 >= least
    return r[long], a[long], b[long]


def unrepeated(row: np.ndarray, windows: np.ndarray, row_out: np.ndarray, repeated: np.ndarray, length: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (row, first, last) of the first places of runs of ``length``
    shingles that lie in windows (left, right, function) of all functions and in
    none of the ranges ``repeated`` (first, last)."""
    ends = np.array([0, length - 1, 0])
    long = windows[:, 1] - windows[:, 0] + 1 >= length
    longer = repeated[:, 1] - repeated[:, 0] + 1 >= length
    return covered(row[long], windows[long] - ends, HASHES, row_out[longer], repeated[longer] - ends[:2])


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of its list, entry) of the entries of an array of lists."""
    count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), count), lists.flatten()


def by_row(rows: int, row: np.ndarray, names: list[str], columns: list[pa.Array]) -> pa.Array:
    """An array of lists of structs: entries by the row that has them, ascending."""
    entries = pa.StructArray.from_arrays(columns, names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), entries)


def ranges_of(windows: pa.Array, spans: pa.Array, of, least: int) -> pa.Array:
    """``of``, that is ``uncovered`` or ``unrepeated``, on lists of packed windows
    and of known repeats (l, r), as lists of ranges (a, b)."""
    row, w = flat(windows)
    row_out, known = flat(spans)
    known = np.stack([known.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (0, 1)], axis=1)
    r, a, b = of(row, unpacked(w.to_numpy(zero_copy_only=False)), row_out, known, least)
    return by_row(len(windows), r, ["a", "b"], [pa.array(a, pa.int32()), pa.array(b, pa.int32())])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if np.array_equal(x, y):
        return 1.0
    x, y = _distinct(x), _distinct(y)
    both = np.sort(np.concatenate([x, y]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(x) + len(y) - common)


def _places(part: np.ndarray, p: np.ndarray, order: np.ndarray, ranked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where in the other text (its shingles ``ranked`` by ``order``) each shared
    shingle p is: at the place nearest to the diagonal of the one before it."""
    shared, rank = part[p], at[p]
    out = order[rank]
    # Only what the other text has several times leaves a choice.
    several = np.flatnonzero((rank + 1 < len(ranked)) & (ranked[np.minimum(rank + 1, len(ranked) - 1)] == shared))
    if not len(several):
        return out
    high = np.searchsorted(ranked, shared[several], "right")
    own, found, places = p.tolist(), out.tolist(), order.tolist()
    for i, lo, hi in zip(several.tolist(), rank[several].tolist(), high.tolist(), strict=True):
        want = found[i - 1] + own[i] - own[i - 1] if i else 0
        j = bisect_left(places, want, lo, hi)
        if j == hi or j > lo and want - places[j - 1] <= places[j] - want:
            j -= 1
        found[i] = places[j]
    return np.array(found, np.int64)


def repeats(own: np.ndarray, other: np.ndarray, order: np.ndarray, ranges: list[tuple[int, int]], least: int, similarity: float
            ) -> list[tuple[int, int, float]]:
    """(first, last, similarity) of the maximal runs of shingles of ``own``,
    within ``ranges``, that repeat a run of ``other``: at least ``least`` long
    and similar enough. Runs that begin and end with a shared shingle are
    tried; one that fails is split at its widest jump. ``order`` sorts
    ``other``, equal shingles by place."""
    ranked = other[order]
    found = []
    for low, high in ranges:
        part = own[low:high + 1]
        at = np.searchsorted(ranked, part)
        hit = at < len(ranked)
        hit[hit] = ranked[at[hit]] == part[hit]
        p = np.flatnonzero(hit)
        if not len(p) or p[-1] - p[0] + 1 < least:
            continue
        q = _places(part, p, order, ranked, at)
        jumps = np.maximum(np.diff(p), np.minimum(np.abs(np.diff(q - p)) + 1, 1 << 30))
        stack = [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if p[b] - p[a] + 1 < least:
                continue
            jump = jumps[a:b]
            widest = int(jump.argmax()) if len(jump) else -1
            if widest < 0 or jump[widest] <= 3 * SHINGLE:
                x, y = part[p[a]:p[b] + 1], other[q[a:b + 1].min():q[a:b + 1].max() + 1]
                value = _jaccard(x, y)
                if value >= similarity:
                    found.append((int(low + p[a]), int(low + p[b]), value))
                    continue
            if widest >= 0:
                stack += [(a, a + widest), (a + widest + 1, b)]
    return sorted(found)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                      similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, text_hash, start, end, n_words, first_id, similarity): one row
    per repeated passage of a document and earlier document (first_id < id)
    that has it. start and end are code points of the text, end exclusive;
    passages of one document may overlap. text_hash is the document's
    ``xxhash64(text)``.

    Words are separated by white space, A-Z folded. Passages that a document
    repeats itself are no rows. Null and empty texts, and texts of fewer than
    ``min_words`` words, repeat nothing. Rows with a null id are ignored. Rows
    that repeat an id are one document with several texts; text_hash tells
    them apart. Texts of any length are compared whole. Other columns are
    ignored; an empty table gives an empty result.

    Runs of ``min_words`` words that an earlier text has exactly are always in
    a row. A passage at the least similarity is missed with a probability of
    about 0.001 (fewer than 3 of 8 functions agree), more often where several
    earlier texts have different parts of it: what the first of them draws away
    is joined again, what a second one draws away then is not. Runs Spark jobs
    when called.
    """
    prepare(docs.sparkSession)
    least = min_words - SHINGLE + 1
    width = min(WIDTH, least)
    d = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
         .where("id is not null and text is not null"))

    def windows(batches):
        for batch in lean(batches):
            for f, key, ids, left, _, right, outer in _windows(batch, width):
                ok = outer < 0  # a window inside one with the same key adds nothing
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[ok]), pa.array(ids[ok]), pa.array(packed(left[ok], right[ok], f))], ["key", "id", "w"])

    met = saved(_met(d.mapInArrow(windows, "key long, id long, w long")))

    @arrow_udf("array<struct<start:int,end:int,n_words:int,similarity:double,l:int,r:int>>")
    def compare(own: pa.Array, other: pa.Array, windows: pa.Array) -> pa.Array:
        return _compare(own, other, windows, least, similarity)

    def compared(met: DataFrame) -> DataFrame:
        links = met.where(_functions(F.col("windows")) >= AGREE)
        some = sieve.build(links.select("id").union(links.select(F.col("first").alias("id"))).distinct(), "id")
        texts = d.where(sieve.sifted(some)("id"))  # and a few others, which the joins drop
        return saved(links.join(texts, "id").join(texts.select(F.col("id").alias("first"), F.col("text").alias("other")), "first")
                     .select("id", "first", F.xxhash64("text").alias("text_hash"), F.explode(compare("text", "other", "windows")).alias("s")))

    both = compared(met)
    again = _unexplained(d, met, both.select("id", "text_hash", "s.l", "s.r"), width, least)
    both = both.union(compared(saved(_met(again))))
    near = both.select("id", "text_hash", "s.start", "s.end", "s.n_words", "first", "s.similarity")
    exact = _exact_repeats(d, met, both.select("id", "text_hash", "s.l", "s.r"), least)
    return (near.union(exact).distinct()
            .select(F.col("id").alias(id_col), "text_hash", "start", "end", "n_words", F.col("first").alias("first_id"), "similarity"))


def _functions(windows: Column) -> Column:
    """How many functions packed windows are of."""
    return F.size(F.array_distinct(F.transform(windows, lambda w: w.bitwiseAND(F.lit(15)))))


def _met(rows: DataFrame) -> DataFrame:
    """(id, first, windows) of windows (key, id, w) that a text of a lesser id
    has too; first is the least such id."""
    first = F.min("id").over(W.partitionBy("key"))
    return (rows.withColumn("first", first).where("first < id").groupBy("id", "first").agg(F.collect_list("w").alias("windows")))


def _unexplained(d: DataFrame, met: DataFrame, known: DataFrame, width: int, least: int) -> DataFrame:
    """(key, id, w): the windows of texts ``d`` (id, text) with a centre in a
    range, at least ``least`` long, that joined windows ``met`` of ``AGREE``
    functions cover and no known repeat (id, text_hash, l, r)."""

    @arrow_udf("array<struct<a:int,b:int>>")
    def unexplained(windows: pa.Array, spans: pa.Array) -> pa.Array:
        return ranges_of(windows, spans, uncovered, least)

    own = met.groupBy("id").agg(F.flatten(F.collect_list("windows")).alias("windows")).where(_functions(F.col("windows")) >= AGREE)
    spans = known.groupBy("id", "text_hash").agg(F.collect_list(F.struct("l", "r")).alias("spans"))
    some = sieve.build(own, "id")
    hashed = d.where(sieve.sifted(some)("id")).select("id", F.xxhash64("text").alias("text_hash")).distinct()
    todo = saved(hashed.join(own, "id").join(spans, ["id", "text_hash"], "left")
                 .select("id", "text_hash", unexplained("windows", "spans").alias("ranges")).where("size(ranges) > 0"))

    def again(batches):
        for batch in lean(batches):
            ids, ranges = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            row = np.repeat(np.arange(len(ids)), ranges.value_lengths().to_numpy(zero_copy_only=False)) << 32
            first, last = (row + ranges.flatten().field(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), batch.column(1)], ["row", "text"])
            for f, key, r, left, centre, right, outer in _windows(numbered, width):
                place = (r << 32) + np.stack([centre, outer])
                at = np.searchsorted(first, place, "right") - 1
                inside = (at >= 0) & (place <= last[at])
                ok = inside[0] & ~(inside[1] & (outer >= 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[ok]), pa.array(ids[r[ok]]), pa.array(packed(left[ok], right[ok], f))], ["key", "id", "w"])

    these = sieve.build(todo, "id")
    return (d.where(sieve.sifted(these)("id")).withColumn("text_hash", F.xxhash64("text")).join(todo, ["id", "text_hash"])
            .select("id", "text", "ranges").mapInArrow(again, "key long, id long, w long"))


def _exact_repeats(d: DataFrame, met: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Repeats by whole runs of ``least`` shingles: of texts ``d`` (id, text)
    those runs that lie in joined windows ``met`` of all functions and in no
    known repeat (id, text_hash, l, r), and that an earlier text has."""

    @arrow_udf("array<struct<a:int,b:int>>")
    def free(windows: pa.Array, spans: pa.Array) -> pa.Array:
        return ranges_of(windows, spans, unrepeated, least)

    # Texts that share an id share its windows; what is known is a text's own.
    own = met.groupBy("id").agg(F.flatten(F.collect_list("windows")).alias("windows"))
    spans = known.groupBy("id", "text_hash").agg(F.collect_list(F.struct("l", "r")).alias("spans"))
    some = sieve.build(own.where(_functions(F.col("windows")) == HASHES), "id")
    hashed = d.where(sieve.sifted(some)("id")).select("id", F.xxhash64("text").alias("text_hash")).distinct()
    todo = saved(hashed.join(own, "id").join(spans, ["id", "text_hash"], "left")
                 .select("id", "text_hash", free("windows", "spans").alias("free")).where("size(free) > 0"))

    def sought(batches):
        for batch in lean(batches):
            for i, text, digest, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, off = utf8(pa.array([text]))
                row, start, end = words(data, off)
                s, _, _ = shingles(span_hashes(data, start, end), row, 1, SHINGLE)
                h = run_hashes(s, least)
                at = np.concatenate([np.arange(x["a"], x["b"] + 1) for x in ranges])
                at = at[at < len(h)]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), i, np.int64)), pa.array(np.full(len(at), digest, np.int64)),
                     pa.array(at.astype(np.int32)), pa.array(points[start[at]].astype(np.int32)),
                     pa.array(points[end[at + least + SHINGLE - 2]].astype(np.int32))],
                    ["key", "id", "text_hash", "pos", "start", "end"])

    these = sieve.build(todo, "id")
    wanted = saved(d.where(sieve.sifted(these)("id")).withColumn("text_hash", F.xxhash64("text")).join(todo, ["id", "text_hash"])
                   .select("id", "text", "text_hash", "free")
                   .mapInArrow(sought, "key long, id long, text_hash long, pos int, start int, end int").distinct())
    asked = sieve.build(wanted, "key")

    def owners(batches):
        for batch in lean(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, h, row in _word_hashes(batch.column(1)):
                s, srow, _ = shingles(h, row, b - a, SHINGLE)
                key = run_hashes(s, least)
                first = np.searchsorted(srow, np.arange(b - a))
                at = np.flatnonzero(srow[:len(key)] == srow[len(s) - len(key):])
                at = at[sieve.passes(asked, key[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at].view(np.int64)), pa.array(ids[a:b][srow[at]]), pa.array((at - first[srow[at]]).astype(np.int32))],
                    ["key", "id", "pos"])

    firsts = d.mapInArrow(owners, "key long, id long, pos int").groupBy("key").agg(F.min(F.struct("id", "pos")).alias("at"))
    found = (wanted.join(firsts, "key").where(F.col("at.id") < F.col("id"))
             .select("id", "text_hash", "pos", "start", "end", F.col("at.id").alias("first"), (F.col("pos") - F.col("at.pos")).alias("diagonal")))
    line = W.partitionBy("id", "text_hash", "first", "diagonal").orderBy("pos")
    return (found.withColumn("run", F.col("pos") - F.row_number().over(line))
            .groupBy("id", "text_hash", "first", "diagonal", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.count("*") + least + SHINGLE - 2).cast("int").alias("n_words"))
            .select("id", "text_hash", "start", "end", "n_words", "first", F.lit(1.0).alias("similarity")))


def _shingled(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, first byte of each word, last byte behind it, bytes) of each text."""
    data, off = utf8(texts)
    for a, b in chunks(off):
        part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        row, start, end = words(part, o)
        s, srow, _ = shingles(span_hashes(part, start, end), row, b - a, SHINGLE)
        at, sat = (np.searchsorted(x, np.arange(b - a + 1)) for x in (row, srow))
        for i in range(b - a):
            own = slice(at[i], at[i + 1])
            yield s[sat[i]:sat[i + 1]], start[own] - o[i], end[own] - o[i], part[o[i]:o[i + 1]]


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _compare(own: pa.Array, other: pa.Array, windows: pa.Array, least: int, similarity: float) -> pa.Array:
    """Lists of the repeats of each text of ``own`` in the text beside it, in
    ranges that its packed windows of ``AGREE`` functions cover. A text that is
    in several rows of the batch is read once."""
    own, other = own.dictionary_encode(), other.dictionary_encode()
    texts = list(_shingled(own.dictionary))
    others = [s for s, *_ in _shingled(other.dictionary)]
    orders: dict[int, np.ndarray] = {}
    x, y = own.indices.to_numpy(), other.indices.to_numpy()
    row, w = flat(windows)
    w = unpacked(w.to_numpy(zero_copy_only=False))
    fit = w[:, 1] < np.array([len(s) for s, *_ in texts], np.int64)[x[row]]  # windows of another text with this id may not
    row, a, b = covered(row[fit], w[fit], AGREE)
    bounds = np.searchsorted(row, np.arange(len(x) + 1))
    out = []
    for i, (m, n) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        ranges = [(p, q) for p, q in zip(a[m:n].tolist(), b[m:n].tolist(), strict=True) if q - p + 1 >= least]
        if not ranges:
            continue
        if y[i] not in orders:
            orders[y[i]] = np.argsort(others[y[i]], kind="stable")
        s, start, end, data = texts[x[i]]
        for l, r, value in repeats(s, others[y[i]], orders[y[i]], ranges, least, similarity):  # noqa: E741
            p, q = start[l], end[r + SHINGLE - 1]
            head = _points(data[:p])
            out.append((i, head, head + _points(data[p:q]), r - l + SHINGLE, value, l, r))
    columns = list(zip(*out, strict=True)) or [()] * 7
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    return by_row(len(x), np.array(columns[0], np.int64), ["start", "end", "n_words", "similarity", "l", "r"],
                  [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)])


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; all rows and all
    columns stay. A cut leaves one space where words would else touch."""
    found = saved(passages.groupBy(F.col(id_col).alias("_cut_id"), F.col("text_hash").alias("_cut_hash"))
                  .agg(F.collect_list(F.struct("start", "end")).alias("_cut_spans")))
    some = sieve.build(found, "_cut_id")
    hit = F.coalesce(sieve.sifted(some)(F.col(id_col).cast("long")), F.lit(False))

    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if own:
                kept, last = [], 0
                for s in sorted(own, key=lambda s: (s["start"], s["end"])):
                    kept.append(t[last:s["start"]].strip(" "))
                    last = max(last, s["end"])
                kept.append(t[last:].strip(" "))
                t = " ".join(x for x in kept if x)
            out.append(t)
        return pa.array(out, pa.string())

    columns = docs.columns
    touched = docs.where(hit).withColumn("_cut_text_hash", F.xxhash64(text_col))
    joined = touched.join(found, (F.col(id_col).cast("long") == F.col("_cut_id")) & (F.col("_cut_text_hash") == F.col("_cut_hash")), "left")
    changed = joined.withColumn(text_col, cut(F.col(text_col), F.col("_cut_spans"))).select(*columns)
    return docs.where(~hit).union(changed)
