"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds ``S[i] = sum(c[j] * BASE**j for j < i) mod p`` for
two 31-bit primes, c being its code points. Two prefix arrays answer whether
any two spans are equal, and a binary search over span tests finds the longest
common extension of two positions. A text made of spans of others needs no
hashing of its own: its prefix array is put together from theirs.

A fingerprint keeps the length, the hash of the whole text, and the hashes of
prefixes and suffixes at fixed lengths (``marks``): 1 to 16, then 16 a
doubling. Its length grows with the logarithm of the text's length. Two
fingerprints give the likeness of their texts: the longest common prefix and
suffix, found by binary search over the marks, as a share of the longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .runtime import prepare, spread

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)


class _PowerTable:
    def __init__(self) -> None:
        self.rows = np.ones((2, 1), np.uint64)

    def get(self, n: int) -> np.ndarray:
        while self.rows.shape[1] < n:
            k = self.rows.shape[1]
            nxt = np.empty_like(self.rows)
            for r, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
                nxt[r] = self.rows[r] * np.uint64(pow(b, k, p)) % np.uint64(p)
            self.rows = np.concatenate([self.rows, nxt], axis=1)
        return self.rows


_POW = _PowerTable()
_P = np.array(PRIMES, np.uint64).reshape(2, 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_array(points: np.ndarray) -> np.ndarray:
    """S of shape (2, n + 1). Sums stay below 2**63 for texts under 2**32 code points."""
    pw = _POW.get(len(points) + 1)
    out = np.zeros((2, len(points) + 1), np.uint64)
    c = points.astype(np.uint64) + np.uint64(1)
    np.cumsum(c * pw[:, :len(points)] % _P, axis=1, out=out[:, 1:])
    return out % _P


def joined_prefix_array(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The prefix array of the concatenation of two texts, from theirs."""
    k = head.shape[1] - 1
    pw = _POW.get(k + 1)
    return np.concatenate([head, (head[:, -1:] + tail[:, 1:] * pw[:, k:k + 1]) % _P], axis=1)


def same_span(s: np.ndarray, i: int, t: np.ndarray, j: int, n: int) -> bool:
    """Whether text s from i and text t from j agree on n code points (up to hash collisions)."""
    if n <= 0:
        return True
    if i + n >= s.shape[1] or j + n >= t.shape[1]:
        return False
    pw = _POW.get(max(i, j) + 1)
    x = (s[:, i + n] + _P[:, 0] - s[:, i]) % _P[:, 0] * pw[:, j] % _P[:, 0]
    y = (t[:, j + n] + _P[:, 0] - t[:, j]) % _P[:, 0] * pw[:, i] % _P[:, 0]
    return bool((x == y).all())


def common_extension(s: np.ndarray, i: int, t: np.ndarray, j: int) -> int:
    """The most n for which same_span holds, by binary search."""
    low, high = 0, min(s.shape[1] - 1 - i, t.shape[1] - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        if same_span(s, i, t, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


_MARKS = np.array(sorted({*range(1, 17), *(int(2 ** (4 + j / 16)) for j in range(16 * 45))}), np.int64)


def marks(n: int) -> np.ndarray:
    """The fixed prefix lengths below n."""
    return _MARKS[:int(np.searchsorted(_MARKS, n))]


def _folded(s: np.ndarray) -> np.ndarray:
    """Two residues as one 32-bit check value."""
    return ((s[0] * np.uint64(2_654_435_761) + s[1] * np.uint64(40_503)) >> np.uint64(7)).astype(np.uint32)


def fingerprint(s: np.ndarray) -> str:
    """``length:whole:prefix marks:suffix marks`` of the text with prefix array s."""
    n = s.shape[1] - 1
    at = marks(n)
    # Suffix values are shifted to the common power BASE**(n) / BASE**start by multiplying with BASE**length.
    back = (s[:, -1:] + _P - s[:, n - at]) % _P
    pw = _POW.get(n + 1)
    # (S[n] - S[n-m]) * BASE**(m - n) is the hash of the suffix alone; BASE**-1 powers by modular inverse.
    inv = np.array([[pow(pow(b, n, p), -1, p)] for p, b in zip(PRIMES, BASES, strict=True)], np.uint64)
    back = back * inv % _P * pw[:, at] % _P
    return (f"{n}:{int(s[0, -1]):08x}{int(s[1, -1]):08x}:" + _folded(s[:, at]).astype(">u4").tobytes().hex()
            + ":" + _folded(back).astype(">u4").tobytes().hex())


def parsed(f: str) -> tuple[int, str, np.ndarray, np.ndarray]:
    n, whole, front, back = f.split(":")
    return int(n), whole, np.frombuffer(bytes.fromhex(front), ">u4"), np.frombuffer(bytes.fromhex(back), ">u4")


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """The largest mark up to which two mark lists agree: equal prefixes stay
    equal when shortened, so a binary search finds it."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[mid - 1] == y[mid - 1]:
            low = mid
        else:
            high = mid - 1
    return int(_MARKS[low - 1]) if low else 0


def likeness(one: str, other: str) -> float:
    """0 to 1: 1 for equal fingerprints, else the longest marked common prefix
    plus suffix, as a share of the longer text, below 1."""
    if one == other:
        return 1.0
    n, _, xf, xb = parsed(one)
    m, _, yf, yb = parsed(other)
    longest, shortest = max(n, m), min(n, m)
    if not shortest:
        return 0.0
    common = min(_agree(xf, yf) + _agree(xb, yb), shortest)
    return min(common / longest, 1 - 1 / (longest + 1))


def _slices(docs: DataFrame, parts: int) -> list:
    """Ids that cut the table into about ``parts`` slices of equal size."""
    cuts = docs.where("id is not null").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The next document is the next row by ascending id; after the last comes
    the first. The edited text has the last floor(n_chars / 4) code points
    replaced by the first as many (or all) of the next document.

    A null text counts as empty. Rows that repeat an id follow one another in
    the order of a hash of their texts; rows with a null id come first. A lone
    row is its own next. An empty table gives an empty result.

    Rows are dealt out by id ranges; the first row of every range is also sent
    to the range before it. Inside a task rows stream in order, one held back
    at a time, so memory is that of an Arrow batch and two texts.
    """
    spark = prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = _slices(d.select("id"), 4 * spread(d))
    placed = d.withColumn("slice", _searched(cuts)("id"))
    heads = placed.groupBy("slice").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("first")).orderBy("slice").collect()
    if not heads:
        return spark.createDataFrame([], _SCHEMA).withColumnRenamed("id", id_col)
    # A slice's first id goes to the slice before it as well; that of the first slice to the last one.
    guests = {r.first: heads[i - 1].slice for i, r in enumerate(heads)}
    to = _looked_up(guests)(F.coalesce("id", F.lit(-(1 << 63))))
    rows = (placed.withColumn("to", to)
            .select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("slice", F.lit(False).alias("guest"))))
                    .otherwise(F.array(F.struct("slice", F.lit(False).alias("guest")),
                                       F.struct(F.col("to").alias("slice"), F.lit(True).alias("guest"))))).alias("s"))
            .select("id", "text", "s.slice", "s.guest"))
    ordered = (rows.repartition(spread(d) * 2, "slice")
               .withColumn("tie", F.xxhash64("text"))
               .sortWithinPartitions("slice", "guest", F.col("id").asc_nulls_first(), "tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (slice, id, text, prefix array, fingerprint)
        out: list[tuple] = []
        done = None  # the slice whose guest has been used
        for batch in batches:
            for part, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 0, 1)), strict=True):
                if guest and done == part:
                    continue
                s = prefix_array(code_points(text))
                own = fingerprint(s)
                if held is not None and held[0] == part:
                    out.append(_row(held, text, s, own))
                done = part if guest else done
                held = None if guest else (part, doc, text, s, own)
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    return (ordered.select("id", "text", "slice", "guest").mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_col))


_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _row(held: tuple, nxt: str, nxt_array: np.ndarray, after: str) -> tuple:
    _, doc, text, s, own = held
    n = len(text)
    cut = n // 4
    kept, head = n - cut, min(cut, len(nxt))
    other = fingerprint(joined_prefix_array(s[:, :kept + 1], nxt_array[:, :head + 1]))
    edited = text[:kept] + nxt[:cut]
    return (doc, n, hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, after))


def _searched(cuts: list):
    where = np.array(cuts, np.int64)

    @arrow_udf("int")
    def find(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(where, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left")
        return pa.array(at.astype(np.int32))

    return find


def _looked_up(guests: dict):
    @arrow_udf("int")
    def find(ids: pa.Array) -> pa.Array:
        return pa.array([guests.get(i) for i in ids.to_pylist()], pa.int32())

    return find
