"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered 0 .. G-1. A text's score ``s`` is the sum of shared weights
of its hashed features, and ``P(grade <= j) = sigmoid(threshold[j] - s)`` with
increasing thresholds. This gives an expected grade and the probability of the
upper grades, by which texts are selected.

Features are which words (letters and digits, A-Z folded) a text has, which
beginnings of 4, 5 and 6 bytes its words have, and the levels of its shape: shares of capitals, of marks, of repeated and of distinct
words, and its length. They are hashed to ``2 ** BITS`` numbers. A feature
gets a weight if at least ``LEAST_TEXTS`` training texts have it and its shares
below and above some grade differ by ``LEAST_Z`` standard errors, whatever the
size of the training sample.

Training uses a bounded sample of the rated texts (``SAMPLE`` rows, picked by a
hash of the id), in one task. Scoring is a scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .runtime import prepare
from .textarrays import SPACE, chunks, seeded, span_hashes, utf8, words

BITS, SAMPLE, LEAST_TEXTS, LEAST_Z = 30, 8000, 4, 7.0
EPOCHS, RATE, DECAY = 300, 0.05, 1e-5
#: The probability of the highest grade from which a text is selected.
LEAST_TAIL = 0.7
BEGINNINGS = (4, 5, 6)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_MARKS = ~(_LETTER | ((_BYTES >= 48) & (_BYTES <= 57)) | SPACE)
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b".,;:'\"-?()"]] = True
_ODD = _MARKS & ~_PLAIN
_LEVELS = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offsets): the sorted distinct features of each text,
    or those of them that are in the sorted array ``wanted``."""
    data, off = utf8(texts)
    values, sizes = [], []
    for a, b in chunks(off):
        part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        rows = b - a
        row, start, end = words(part, o, ~(_LETTER | ((_BYTES >= 48) & (_BYTES <= 57))))
        h = span_hashes(part, start, end)
        n = np.maximum(1, np.bincount(row, minlength=rows))

        def total(flags, o=o):
            run = np.concatenate([[0], np.cumsum(flags)])
            return run[o[1:]] - run[o[:-1]]

        ranked = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        distinct = np.bincount((ranked >> np.uint64(40)).astype(np.int64), minlength=rows)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        letters = np.maximum(1, total(_LETTER[part]))
        shape = np.stack([total(_UPPER[part]) / letters, total(_ODD[part]) / n, total(part == 124) / n,
                          np.bincount(row, again, minlength=rows) / n, distinct / n,
                          total(part == 33) / n, total(_MARKS[part]) / n, total(part == 10) / n, np.log2(1 + n) / 16], axis=1)
        level = np.searchsorted(_LEVELS, shape) + 16 * np.arange(shape.shape[1])
        kinds = [seeded(h, 42), *(seeded(span_hashes(part, start, np.minimum(start + size, end)), 50 + size) for size in BEGINNINGS),
                 seeded(level.astype(np.uint64), 41).reshape(-1)]
        where = [row, *[row] * len(BEGINNINGS), np.repeat(np.arange(rows), shape.shape[1])]
        f = np.concatenate(kinds) >> np.uint64(64 - BITS)
        r = np.concatenate(where).astype(np.uint64)
        if wanted is not None and len(wanted):
            quick = np.zeros(1 << 20, bool)
            quick[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            ok = quick[(f & np.uint64((1 << 20) - 1)).astype(np.int64)]
            f, r = f[ok], r[ok]
            ok = wanted[np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)] == f
            f, r = f[ok], r[ok]
        pairs = np.unique((r << np.uint64(BITS)) | f)
        values.append((pairs & np.uint64((1 << BITS) - 1)).astype(np.int32))
        sizes.append(np.bincount((pairs >> np.uint64(BITS)).astype(np.int64), minlength=rows))
    return (np.concatenate([np.zeros(0, np.int32), *values]),
            np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _separates(column: np.ndarray, grade: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Which features' shares below and above some grade differ significantly."""
    has = np.stack([np.bincount(column[grade == j], minlength=size) for j in range(len(sizes))])
    out = np.zeros(size, bool)
    for j in range(1, len(sizes)):
        low, high = max(1, sizes[:j].sum()), max(1, sizes[j:].sum())
        x, y = has[:j].sum(axis=0), has[j:].sum(axis=0)
        p = (x + y) / (low + high)
        out |= np.abs(x / low - y / high) >= LEAST_Z * np.sqrt(p * (1 - p) * (1 / low + 1 / high)) + 1e-12
    return out


def fit_ordinal(f: np.ndarray, off: np.ndarray, grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, weights, thresholds) by maximum penalised likelihood (Adam, full batch)."""
    known, seen = np.unique(f, return_counts=True)
    known = known[seen >= LEAST_TEXTS]
    row = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(off))
    column = np.searchsorted(known, f).astype(np.int32)
    kept = column < len(known)
    kept[kept] = known[column[kept]] == f[kept]
    row, column = row[kept], column[kept]
    use = _separates(column, grade[row], np.bincount(grade, minlength=grades), len(known))
    number = np.cumsum(use, dtype=np.int32) - 1
    kept = use[column]
    row, column = row[kept], number[column[kept]]
    known, size = known[use], int(use.sum())
    # Thresholds are the first one and logarithms of the steps, all of which stay increasing.
    w = np.zeros(size + grades - 1)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(1, len(grade)), 0.01, 0.99)
    t = np.log(share / (1 - share))
    w[size], w[size + 1:] = t[0], np.log(np.maximum(0.1, np.diff(t)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    rows = np.arange(len(grade))

    def thresholds():
        return np.concatenate([[w[size]], w[size] + np.cumsum(np.exp(w[size + 1:]))])

    for epoch in range(1, EPOCHS + 1):
        score = np.bincount(row, w[column], minlength=len(grade))
        below = _sigmoid(thresholds()[None] - score[:, None])
        cum = np.concatenate([np.zeros((len(grade), 1)), below, np.ones((len(grade), 1))], axis=1)
        p = np.maximum(1e-9, cum[rows, grade + 1] - cum[rows, grade])
        slope = cum * (1 - cum)
        g_score = (slope[rows, grade + 1] - slope[rows, grade]) / p / len(grade)
        g = np.zeros_like(w)
        g[:size] = np.bincount(column, g_score[row], minlength=size) + DECAY * w[:size]
        g_t = np.zeros(grades - 1)
        for j in range(grades - 1):
            g_t[j] = (-(slope[:, j + 1] / p)[grade == j].sum() + (slope[:, j + 1] / p)[grade == j + 1].sum()) / len(grade)
        g[size] = g_t.sum()
        for j in range(1, grades - 1):
            g[size + j] = g_t[j:].sum() * np.exp(w[size + j])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.999 ** epoch)) + 1e-8)
    return known, w[:size], thresholds()


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> dict:
    """A model {"features", "weights", "thresholds", "grades"} from ``ratings`` (id_col, grade int).

    About ``sample`` rated ids are used, picked by a hash of the id. Several
    ratings of an id count as the lowest. Null ids, grades and texts, and
    grades outside 0 .. grades - 1, teach nothing. Without any rating there is
    nothing to reject a text by: the model gives every text the highest grade.
    Runs Spark jobs when called.
    """
    spark = prepare(docs.sparkSession)
    rated = (ratings.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"))
             .where(f"id is not null and grade between 0 and {grades - 1}"))
    n = rated.agg(F.count("*")).first()[0]
    unrated = {"features": np.zeros(0, np.int32), "weights": np.zeros(0), "thresholds": np.full(grades - 1, -60.0), "grades": grades}
    if not n:
        return unrated
    picked = (rated.where(F.pmod(F.xxhash64("id", F.lit("rated")), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
              .groupBy("id").agg(F.min("grade").alias("grade")))
    chosen = spark.sparkContext.broadcast(dict(picked.collect()))  # about ``sample`` pairs of numbers at most

    def featured(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [i for i, x in enumerate(ids) if x in chosen.value]
            f, off = features(batch.column(1).take(pa.array(at, pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at], pa.int64()), pa.array([chosen.value[ids[i]] for i in at], pa.int32()),
                 pa.array([f[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["id", "grade", "f"])

    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
            .mapInArrow(featured, "id long, grade int, f binary"))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        parts = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("f")]
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        known, w, t = fit_ordinal(np.concatenate(parts), off, table.column("grade").to_numpy().astype(np.int64), grades)
        return pa.table({"f": pa.array([known.astype(np.int32).tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()),
                         "t": pa.array([t.tolist()], pa.list_(pa.float64()))})

    out = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "f binary, w binary, t array<double>").collect()
    if not out:
        return unrated
    return {"features": np.frombuffer(out[0].f, np.int32), "weights": np.frombuffer(out[0].w), "thresholds": np.array(out[0].t), "grades": grades}


def grade_of(spark, model: dict):
    """A column function: text -> struct(expected_grade, tail), tail being the
    probability of the highest grade. A null or empty text has no words and is
    judged by its (empty) shape alone."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # at most the features of the training sample

    @arrow_udf("struct<expected_grade:double,tail:double>")
    def judge(texts: pa.Array) -> pa.Array:
        m = sent.value
        f, off = features(texts, m["features"].astype(np.uint64))
        value = m["weights"][np.searchsorted(m["features"], f)] if len(m["features"]) else np.zeros(len(f))
        run = np.concatenate([[0], np.cumsum(value)])
        score = run[off[1:]] - run[off[:-1]]
        above = _sigmoid(score[:, None] - m["thresholds"][None])
        return pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, -1])], ["expected_grade", "tail"])

    return judge


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the table ``labels``: 0 low quality, 1 toxic, 2 neither."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2).alias("grade"))


def rate(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """(id_col, expected_grade, tail, selected), one row per row of ``docs``;
    selected if the highest grade's probability is ``least_tail`` or more.
    Null ids, ties and repeated rows stay; other columns are ignored."""
    judge = grade_of(docs.sparkSession, model)
    scored = docs.select(F.col(id_col), judge(F.col(text_col)).alias("g"))
    return scored.select(id_col, "g.expected_grade", "g.tail", (F.col("g.tail") >= least_tail).alias("selected"))
