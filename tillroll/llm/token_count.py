"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a
character; dynamic programming over the characters carries the best score and
its number of pieces. The rules are those of the public unigram tokenizers:

* white space becomes the mark U+2581, and one mark is put before the text;
* a segmentation's score is the sum of its pieces' scores;
* of two segmentations with the same score up to a character, the one whose
  last piece starts earlier stays;
* a character that is no piece by itself is unknown: it scores 10 below the
  least piece score, and counts as its UTF-8 bytes if the vocabulary has byte
  pieces, else as one token together with the unknown characters next to it.

No piece has a mark behind another character, so a text's best segmentation is
the best one of each of its parts ``marks + other characters``, and a part's
count is looked up when it has been seen before. The table of parts is cleared
when it reaches ``SEEN_PARTS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SEEN_PARTS = 300_000
_NONE = float("-inf")


@lru_cache(maxsize=1)
def _vocabulary(path: str):
    import ahocorasick
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    automaton, least, byte_pieces = ahocorasick.Automaton(), 0.0, False
    for i in range(model.get_piece_size()):
        byte_pieces |= model.is_byte(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        if re.search(f"[^{MARK}]{MARK}", piece):
            raise ValueError(f"piece {piece!r} has a mark behind another character")
        automaton.add_word(piece, (len(piece), score))
        least = min(least, score)
    automaton.make_automaton()
    return automaton, least - UNKNOWN_PENALTY, byte_pieces


def best_segmentation(part: str, automaton, unknown: float, byte_pieces: bool) -> tuple[float, int]:
    """(score, tokens) of the best segmentation of ``part``."""
    n = len(part)
    score, count = [0.0] * (n + 1), [0] * (n + 1)
    at, best, pieces, single, loose = 1, _NONE, 0, False, False

    def settle(to: int) -> None:
        """Fixes the places before ``to``, of which no more matches come."""
        nonlocal at, best, pieces, single, loose
        while at < to:
            from_unknown = False
            if not single:
                total = score[at - 1] + unknown
                if total > best:
                    size = len(part[at - 1].encode("utf-8", "surrogatepass")) if byte_pieces else int(not loose)
                    best, pieces, from_unknown = total, count[at - 1] + size, True
            score[at], count[at], loose = best, pieces, from_unknown  # loose: the last piece is an unknown character
            at, best, pieces, single = at + 1, _NONE, 0, False

    # Matches come by their end, of one end the longest (the earliest start) first.
    for end, (length, value) in automaton.iter(part):
        if end >= at:
            settle(end + 1)
        total = score[at - length] + value
        if total > best:
            best, pieces = total, count[at - length] + 1
        single |= length == 1
    settle(n + 1)
    return score[n], count[n]


class _Seen(dict):
    """(score, tokens) of parts; a worker keeps it over its tasks."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.vocabulary = _vocabulary(path)

    def __missing__(self, part: str) -> tuple[float, int]:
        if len(self) >= SEEN_PARTS:
            self.clear()
        self[part] = found = best_segmentation(part, *self.vocabulary)
        return found


@lru_cache(maxsize=1)
def _seen(path: str) -> _Seen:
    return _Seen(path)


_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, score), one row per row of ``docs``.

    ``vocabulary`` is the path of a sentencepiece model file that every
    executor can read; its pieces and scores are taken as a unigram model.

    A null or empty text has 0 tokens and score 0. Texts of any length are
    counted whole. Null ids, ties and repeated rows stay as they are; other
    columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _seen(vocabulary)
        for batch in batches:
            tokens, scores = [], []
            for text in batch.column(1).to_pylist():
                found = [seen[p] for p in _PART.findall(MARK + text.replace(" ", MARK))] if text else ()
                tokens.append(sum(c for _, c in found))
                scores.append(float(sum(s for s, _ in found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], [id_col, "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, score double")
