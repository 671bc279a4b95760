"""Bounded-space online packing of token streams into fixed windows.

Each task packs its documents in the order in which they arrive, with at most
``OPEN`` windows open at a time. A document's full windows leave at once; its
rest goes into the open window with the least room that still holds it. When
none holds it, the fullest window is topped up with the head of the document
(if its room is at least ``LEAST_PIECE``) and emitted, and the remainder is
placed the same way. What is still open at the end of a task is merged: the
leftovers of ``FAN_IN`` tasks are packed again as if they arrived in one, until
one task is left. A leftover is at most ``OPEN`` windows, so no task ever holds
more than that and a document's tokens.

The last windows are cut into pieces whose lengths are powers of two, which
take no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean, prepare, saved
from .textarrays import SPACE, chunks, span_hashes, utf8, words

WINDOW, OPEN, LEAST_PIECE, FAN_IN = 2048, 16, 16, 8
#: Parts of texts whose ids a worker keeps.
SEEN_PARTS = 400_000

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Normaliser and splitter of a vocabulary file under which a text's
#: ids are those of its parts between white space, one after the other: lower case,
#: white space dropped, and no piece across it.
_NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
             "behavior": "Removed", "invert": True}


def parts_at_spaces(config: dict) -> bool:
    """Whether the tokenizer of this file is known to work between white space."""
    splitters = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    return (config.get("normalizer") == _NORMALISER and splitters[0] == _SPLITTER
            and (config.get("model") or {}).get("end_of_word_suffix") == "</w>")


#: Classes of bytes: white space, letters (with all of non-ASCII), digits, others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[SPACE] = 0


def pieces(data: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, plain) of the pieces into which the splitter above divides
    the words of a chunk: runs of letters, single digits, runs of other marks. Words
    with an apostrophe, or with characters beyond Latin-1's letters, stay whole and
    are not plain."""
    after, before = np.zeros_like(data), np.zeros_like(data)
    after[:-1], before[1:] = data[1:], data[:-1]
    latin = ((data == 0xC3) & (after != 0x97) & (after != 0xB7)) | ((before == 0xC3) & (data != 0x97) & (data != 0xB7))
    strange = np.concatenate([[0], np.cumsum((data == 39) | ((data >= 128) & ~latin))])
    plain = strange[end] == strange[start]
    kind = _CLASS[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    size = end - start
    inside = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))  # the words' bytes
    first = inner[inside] & np.repeat(plain, size)
    first[np.cumsum(size) - size] = True
    at = np.flatnonzero(first)
    begins = inside[at]
    ends = inside[np.concatenate([at[1:], [len(inside)]]) - 1] + 1 if len(at) else begins
    word = np.repeat(np.arange(len(start)), size)[at]
    return row[word], begins, ends, plain[word]


class _Ids:
    """Token ids of texts. Of a vocabulary that works between white space the ids of
    the parts are kept, by their hash, and forgotten when they are too many; texts of
    other vocabularies, and texts with special tokens, are encoded whole."""

    def __init__(self, path: str) -> None:
        self.encoder = _tokenizer(path)
        with open(path, encoding="utf-8") as file:
            self.by_parts = parts_at_spaces(json.load(file))
        self.last = np.zeros(self.encoder.get_vocab_size(), bool)  # tokens that end a word
        for token, i in self.encoder.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, "<u4")
        self.start, self.length, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, hashes: list[int], parts: list[str], plain: bool) -> None:
        if not parts:
            return
        ends = None
        if plain:  # one word each: all in one text, divided behind the tokens that end a word
            ids = np.array(self.encoder.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
        if ends is None or len(ends) != len(parts):
            each = [e.ids for e in self.encoder.encode_batch_fast(parts, add_special_tokens=False)]
            ids, ends = np.array([i for x in each for i in x], "<u4"), np.cumsum([len(x) for x in each])
        k, n = len(self.known), len(parts)
        while k + n > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        begins = np.concatenate([[0], ends[:-1]])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[k:k + n], self.length[k:k + n] = self.used + begins, ends - begins
        self.known.update(zip(hashes, range(k, k + n), strict=True))
        self.used += len(ids)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as ``Tokenizer.encode`` gives them; a null is empty."""
        data, off = utf8(texts)
        for a, b in chunks(off):
            part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            raw = part.tobytes()
            if not self.by_parts or b"<|" in raw:
                whole = [raw[x:y].decode() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                for e in self.encoder.encode_batch_fast(whole, add_special_tokens=False):
                    yield np.array(e.ids, "<u4")
                continue
            row, start, end, plain = pieces(part, *words(part, o))
            h, first, place = np.unique(span_hashes(part, start, end), return_index=True, return_inverse=True)
            if len(self.known) + len(h) > SEEN_PARTS:
                self.forget()
            found = [self.known.get(x) for x in h.tolist()]
            new = np.array([i for i, k in enumerate(found) if k is None], np.int64)
            if len(new):
                for kind in (True, False):
                    own = new[plain[first[new]] == kind]
                    at = first[own]
                    self._learn(h[own].tolist(), [raw[x:y].decode() for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)], kind)
                found = [self.known[x] for x in h.tolist()]
            k = np.array(found, np.int64)[place]
            size = self.length[k]
            until = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(self.start[k] - until[:-1], size) + np.arange(until[-1])]
            bounds = until[np.searchsorted(row, np.arange(b - a + 1))]
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield ids[x:y]


@lru_cache(maxsize=1)
def _ids(path: str) -> _Ids:
    return _Ids(path)


class _Packer:
    """The open windows of one task: each a list of pieces (doc, start, doc_tokens, ids)."""

    def __init__(self, window: int, space: int) -> None:
        self.window, self.space = window, space
        self.open: list[tuple[list, int]] = []  # pieces, tokens

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> Iterator[list]:
        """Places one run of tokens; yields windows that leave."""
        while len(ids) >= self.window:
            yield [(doc, start, total, ids[:self.window])]
            ids, start = ids[self.window:], start + self.window
        while len(ids):
            fits = [(self.window - used, i) for i, (_, used) in enumerate(self.open) if used + len(ids) <= self.window]
            if fits:
                room, i = min(fits)
                pieces, used = self.open[i]
                pieces.append((doc, start, total, ids))
                if room == len(ids):
                    del self.open[i]
                    yield pieces
                else:
                    self.open[i] = (pieces, used + len(ids))
                return
            if len(self.open) < self.space:
                self.open.append(([(doc, start, total, ids)], len(ids)))
                return
            i = max(range(len(self.open)), key=lambda j: self.open[j][1])
            pieces, used = self.open.pop(i)
            room = self.window - used
            if room >= LEAST_PIECE and len(ids) - room >= LEAST_PIECE:
                pieces.append((doc, start, total, ids[:room]))
                ids, start = ids[room:], start + room
            yield pieces


def _rows(windows: list[list], first: int, kept: bool) -> pa.RecordBatch:
    """Pieces of windows as rows; those that stay open carry their ids."""
    cols: list[list] = [[] for _ in range(8)]
    for k, pieces in enumerate(windows):
        at = 0
        for doc, start, total, ids in pieces:
            raw = ids.tobytes()
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, first + k, at, raw if kept else None), strict=True):
                c.append(v)
            at += len(ids)
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], [*names, "ids"])


def _powers(pieces: list) -> list[list]:
    """A part-filled window as windows whose lengths are powers of two."""
    left = sum(len(p[3]) for p in pieces)
    out: list[list] = []
    queue = list(pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        now: list = []
        while size:
            doc, start, total, ids = queue.pop(0)
            if len(ids) > size:
                queue.insert(0, (doc, start + size, total, ids[size:]))
                ids = ids[:size]
            now.append((doc, start, total, ids))
            size -= len(ids)
        out.append(now)
    return out


def pack(docs: DataFrame, vocabulary: str, eos: int, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, space: int = OPEN) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset).

    A document's tokens are its text's ids and then ``eos``; doc_tokens counts
    them, ``start`` those before the piece. ids_crc32 is the CRC-32 of the
    piece's ids as little-endian unsigned 32-bit numbers. ``offset`` is the
    piece's place in its sequence, without gaps from 0. Sequences hold at most
    ``window`` tokens; all but a few hold nearly as many, and the last ones
    have a power of two.

    ``vocabulary`` is the path of a ``tokenizers`` file which every executor
    can read. A null text counts as
    empty: one piece, the eos alone. Rows that repeat an id and rows with a
    null id are documents of their own. Very long texts are cut over several
    sequences. An empty table gives an empty result; other columns are ignored.

    Runs Spark jobs when called: the first pass and each merge are checkpointed.
    """
    prepare(docs.sparkSession)

    def flush(full: list, state: dict) -> pa.RecordBatch:
        batch = _rows(full, state["next"], False)
        state["next"] += len(full)
        full.clear()
        return batch

    def first_id(level: int) -> dict:
        return {"next": (level << 56) | (TaskContext.get().partitionId() << 32)}

    def packed(pieces: Iterator[tuple], level: int, last: bool) -> Iterator[pa.RecordBatch]:
        packer, state, full = _Packer(window, space), first_id(level), []
        for doc, start, total, ids in pieces:
            for done in packer.add(doc, start, total, ids):
                full.append(done)
            if len(full) >= 1000:
                yield flush(full, state)
        left = [p for p, _ in packer.open]
        if last:
            full += [w for p in left for w in _powers(p)]
        yield flush(full, state)
        if left and not last:
            yield _rows(left, state["next"], True)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(vocabulary)

        def pieces():
            end = np.array([eos], "<u4")
            for batch in lean(batches):
                ids = batch.column(0).to_pylist()
                for doc, own in zip(ids, known.of(batch.column(1)), strict=True):
                    yield doc, 0, len(own) + 1, np.concatenate([own, end])

        yield from packed(pieces(), 0, False)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces():
                for batch in batches:
                    for doc, start, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                        yield doc, start, total, np.frombuffer(raw, "<u4")

            yield from packed(pieces(), level, last)

        return run

    schema = f"{_OUT}, ids binary"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = [saved(source.mapInArrow(first, schema))]
    level, tasks = 0, 1 + (parts[0].agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0)
    while True:
        level += 1
        tasks = -(-tasks // FAN_IN)
        left = parts[-1].where("ids is not null").withColumn("at", F.shiftright("sequence_id", 32) % tasks)
        merged = left.repartition(tasks, "at") if tasks > 1 else left.repartition(1)
        parts.append(saved(merged.sortWithinPartitions("sequence_id", "offset").drop("at").mapInArrow(again(level, tasks == 1), schema)))
        if tasks == 1:
            break
    out = parts[0].where("ids is null")
    for p in parts[1:]:
        out = out.union(p.where("ids is null"))
    return out.drop("ids")
