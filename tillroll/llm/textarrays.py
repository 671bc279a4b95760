"""Array views of text columns, for the operators that work inside Arrow tasks.

An Arrow string column is one byte buffer plus offsets. The helpers here find
the words of all texts of a batch and hash them with a few array operations,
without one Python object per word. Memory in a task is bounded by the chunk
size (``CHUNK_BYTES``) or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # 5 modulo 8: full order modulo 2**64
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """base**i and base**-i modulo 2**64, grown by doubling."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            step = np.uint64(pow(int(_BASE), k, 1 << 64))
            back = np.uint64(_inverse(int(step)))
            self.up = np.concatenate([self.up, self.up * step])
            self.down = np.concatenate([self.down, self.down * back])
        return self.up, self.down


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """An independent-looking 64-bit hash of ``x`` for each seed."""
    return mix64(x ^ mix64(np.array([seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1], np.uint64))[0])


_BYTE_VALUES = seeded(np.arange(256, dtype=np.uint64), 77)

#: Byte classes: A-Z folded to a-z; white space is 0x20 and 0x09 to 0x0D.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED_VALUES = _BYTE_VALUES[FOLD]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8).copy()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[off[0]:off[-1]]
    return raw, off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes of text, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, end byte) of every word: a maximal run of bytes that
    are no separators, inside one row."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    last = np.zeros(n + 1, bool)
    edge = offsets[(offsets < n)]
    first[:n] = inside
    first[1:n] &= ~inside[:-1]
    first[edge] |= inside[edge]
    last[1:] = inside
    last[1:n] &= ~inside[1:]
    inner = edge[edge > 0]
    last[inner] |= inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(offsets, start, "right") - 1
    return np.minimum(row, rows - 1), start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial modulo 2**64 in random byte
    values, read from one prefix sum over the chunk."""
    up, down = _POWERS.get(len(data) + 1)
    values = (_FOLDED_VALUES if fold else _BYTE_VALUES)[data]
    values *= up[:len(data)]
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return mix64(h + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of every run of ``k`` words in a row."""
    n = len(h)
    if n < k:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    acc = h[:n - k + 1].copy()
    for j in range(1, k):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[j:n - k + 1 + j])
    ok = row[:n - k + 1] == row[k - 1:]
    at = np.flatnonzero(ok)
    return acc[at], row[at], at


def shingle_sets(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each row's sorted distinct k-word shingles. A row of
    1 to k-1 words has its whole word sequence as its one shingle."""
    s, srow, _ = shingles(h, row, rows, k)
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(count)])[short]
        one = np.empty(len(short), np.uint64)
        for i, (a, c) in enumerate(zip(starts, count[short], strict=True)):
            v = mix64(np.array([c], np.uint64))
            for x in h[a:a + c]:
                v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + x)
            one[i] = v[0]
        s, srow = np.concatenate([s, one]), np.concatenate([srow, short])
        o = np.argsort(srow, kind="stable")
        s, srow = s[o], srow[o]
    bounds = np.searchsorted(srow, np.arange(rows + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            s[a:b].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (srow[1:] != srow[:-1])
    s, srow = s[fresh], srow[fresh]
    return s, np.searchsorted(srow, np.arange(rows + 1))


def text_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunk by chunk: (first row, last row, values, offsets) of shingle sets."""
    data, off = utf8(texts)
    for a, b in chunks(off):
        part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        row, start, end = words(part, o)
        h = span_hashes(part, start, end)
        s, bounds = shingle_sets(h, row, b - a, k)
        yield a, b, s, bounds
