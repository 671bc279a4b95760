"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes up to three long, frozen after
training. A byte is coded in the longest known context: a byte that followed
the context ``c`` times, out of ``n`` with ``d`` different followers, costs
``-log2(c / (n + d))`` bits; any other costs ``-log2(d / (n + d))`` bits for
the escape, plus its cost in the next shorter context; contexts that were never
seen cost nothing to leave, and below the empty context a byte costs 8 bits.
(Symbols excluded by an escape are not taken out of the shorter contexts, so
code lengths are those of a valid, slightly longer code.) The shortest code
length wins. A-Z are folded first; all other bytes, so all scripts, are kept
apart.

A tree is kept as one sorted table an order, of the byte groups and contexts
that were seen, so its size is that of the sample and not of the alphabet. A
chunk of texts looks each of its distinct groups of four bytes up once. Code
lengths are whole numbers of 2**-20 bit, so sums do not depend on how rows are
dealt over batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .textarrays import FOLD, chunks, utf8

ORDER, UNIT = 3, 1 << 20
#: The byte that texts are thought to follow.
START = 32
#: Texts a language from which statistics are learned, about.
SAMPLE = 400
_LETTER = regex.compile(r"\p{L}")


def _cost(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(part / whole) * UNIT).astype(np.int64)


def context_tree(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order from 0: (groups, costs, contexts, escape costs) of what was
    seen, from counts of groups of ORDER + 1 bytes."""
    tree = []
    for order in range(ORDER + 1):
        keep = np.uint32((1 << 8 * (order + 1)) - 1)
        found, where = np.unique(grams.astype(np.uint32) & keep, return_inverse=True)
        c = np.bincount(where, weights=counts, minlength=len(found))
        contexts, of = np.unique(found >> np.uint32(8), return_inverse=True)
        n, d = np.bincount(of, weights=c, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        tree.append((found, _cost(c, (n + d)[of]), contexts, _cost(d, n + d)))
    return tree


def _places(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is in the sorted table, its place) of each wanted value."""
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool), at


def group_costs(grams: np.ndarray, tree: list) -> np.ndarray:
    """The code length, in 1/UNIT bit, of each group's last byte after the others."""
    cost = np.zeros(len(grams), np.int64)
    left = np.arange(len(grams))
    for order in range(ORDER, -1, -1):
        found, costs, contexts, escapes = tree[order]
        g = grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
        seen, at = _places(found, g)
        cost[left[seen]] += costs[at[seen]]
        left, context = left[~seen], g[~seen] >> np.uint32(8)
        known, at = _places(contexts, context)
        cost[left[known]] += escapes[at[known]]
    cost[left] += 8 * UNIT
    return cost


def groups(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte, the number that its context and it make."""
    s = FOLD[data].astype(np.uint32)
    out = s.copy()
    at = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, ORDER + 1):
        before = np.full_like(s, START)
        before[j:] = s[:-j]
        before[at < j] = START
        out |= before << np.uint32(8 * j)
    return out


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
          sample: int = SAMPLE) -> dict:
    """Frozen statistics: {"key", "langs", "grams", "counts"}.

    Learned from about ``sample`` texts a language, whole ones, picked by a
    hash of the id; this bound keeps the statistics small, and is a parameter.
    Null languages and null texts teach nothing. Memory where texts are scored
    is some 50 bytes for each different group of four bytes in a language's sample.
    """
    prepare(train.sparkSession)
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
                        ).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return {"key": 0, "langs": [], "grams": [], "counts": []}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    picked = rows.where((F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        data, off = utf8(table.column("text"))
        g, n = np.unique(groups(data, off), return_counts=True)
        return pa.table({"lang": pa.array([key[0].as_py()]), "grams": pa.array([g.astype("<u4").tobytes()], pa.binary()),
                         "counts": pa.array([n.astype("<u4").tobytes()], pa.binary())})

    found = sorted(picked.select("lang", "text").groupBy("lang").applyInArrow(count, "lang string, grams binary, counts binary").collect())
    seal = hash(tuple((r.lang, bytes(r.grams), bytes(r.counts)) for r in found))
    return {"key": seal, "langs": [r.lang for r in found], "grams": [np.frombuffer(r.grams, "<u4") for r in found],
            "counts": [np.frombuffer(r.counts, "<u4") for r in found]}


_TREES: dict = {}


def _trees(model: dict) -> list:
    """The context tree of each language, built once a worker."""
    key = model["key"]
    if key not in _TREES:
        _TREES.clear()
        _TREES[key] = [context_tree(g, n) for g, n in zip(model["grams"], model["counts"], strict=True)]
    return _TREES[key]


def code_lengths(data: np.ndarray, offsets: np.ndarray, trees: list) -> np.ndarray:
    """(texts, languages) code lengths in 1/UNIT bit."""
    out = np.zeros((len(offsets) - 1, len(trees)), np.int64)
    for a, b in chunks(offsets):
        part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if not len(part):
            continue
        codes, distinct = pd.factorize(groups(part, off))
        run = np.zeros(len(part) + 1, np.int64)
        for i, tree in enumerate(trees):
            np.cumsum(group_costs(distinct, tree)[codes], out=run[1:])
            out[a:b, i] = run[off[1:]] - run[off[:-1]]
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), one row per row of ``docs``.

    lang_pred is the language with the shortest code length for the whole text
    (ties: the first by name), ``und`` if the text is null or has no letter or
    nothing has been learned; score is that language's posterior
    probability, all languages being equally likely before (0 for ``und``).
    Null ids, ties and repeated rows stay as they are; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # the statistics of a bounded sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1)
            named = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if m["langs"]:
                data, off = utf8(texts)
                bits = code_lengths(data, off, _trees(m)) / UNIT
                best = bits.argmin(axis=1)
                with np.errstate(under="ignore"):
                    score = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
            else:
                named[:] = False
                best, score = np.zeros(len(named), np.int64), np.zeros(len(named))
            langs = [m["langs"][b] if ok else "und" for b, ok in zip(best, named, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(named, score, 0.0))], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double")
