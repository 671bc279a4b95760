"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Entries become whole numbers x = floor(256 c). The fit list holds each
   distinct vector once; its number n and its sums S come from one aggregate.
2. Spark sums the scatter of the centred vectors. They are centred on the
   nearest whole number to the mean, so every product is a whole number and the
   sums are exact, whatever the order of addition; the remainder, at most half
   a unit an entry, is taken off exactly on the driver. Entries are cut into
   limbs of 20 bits, so float products stay below 2**53 for vectors of any size.
3. The driver holds the d x d covariance (d the dimension, never rows). Pivoted
   Cholesky gives its triangular factor up to the numerical rank. One-sided
   Jacobi rotates the factor's columns until they are orthogonal: their squared
   norms are the eigenvalues, the normalised columns the components.
4. The k components (k x d numbers) go to all tasks, which project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import BATCH_ROWS, prepare, saved

SCALE = 256
LIMB = 20
#: Columns count as orthogonal at this cosine; a pivot ends the factor at this share of the trace.
COSINE, LEAST_PIVOT = 1e-15, 1e-13
assert BATCH_ROWS << (2 * LIMB) < 1 << 53  # limb products of a batch are exact floats


@dataclass(frozen=True)
class Whitening:
    """A fitted model. mean, components and scales are in units of x."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # k x d
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is neither null nor holds nulls, NaN or infinities,
    with the whole-number vector in ``_x``. Whole numbers end at 63 bits: entries
    beyond count as the largest or smallest one."""
    c = F.col(f"`{column}`").cast("array<double>")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(c.isNotNull() & ~odd).withColumn("_x", F.transform(c, lambda v: F.floor(v * SCALE).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows; of Python integers if 64 bits are too few to subtract them."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    far = x.size and (x.max() >= 1 << 61 or x.min() < -(1 << 61))
    return x.astype(object) if far else x


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each entry."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            for limb in range(4):  # 16 bits a limb: no sum of a batch can leave 64 bits
                cut = (x >> (16 * limb)) if limb == 3 else (x >> (16 * limb)) & 0xFFFF
                total += cut.sum(axis=0).astype(object) << (16 * limb)
        yield pa.record_batch({"n": pa.array([n] * d, pa.int64()), "j": pa.array(range(d), pa.int32()), "s": pa.array(map(str, total), pa.string())})

    found = (rows.select("_x").mapInArrow(part, "n bigint, j int, s string").groupBy("j")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect())
    return found[0].n, [int(r.s) for r in found]


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Floats of 20 bits each whose sum, shifted by 0, 20, 40 ... bits, is ``y``."""
    out = []
    while True:
        if not len(y) or -(1 << LIMB) <= y.min() and y.max() < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def _summed(rows: DataFrame, centre: list[int], d: int) -> np.ndarray:
    """Exact sums of y and of y y^T over the fit list, y = x - centre, as an
    object array of Python integers with d + 1 rows: the last one holds the sums of y."""
    middle = np.array(centre, object if max(map(abs, centre)) >= 1 << 61 else np.int64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), BATCH_ROWS):
                limbs = _limbs(x[at:at + BATCH_ROWS] - middle)
                ones = np.ones((len(limbs[0]), 1))
                for i, a in enumerate(limbs):
                    for j, b in enumerate(limbs):
                        # The row of ones joins the lowest limb only, so that each sum counts once.
                        block = np.vstack([a.T, ones.T if i == 0 else 0 * ones.T]) @ b
                        at_shift = sums.setdefault(i + j, np.zeros((d + 1, d), np.int64))
                        # A sum is passed on before it could leave 63 bits.
                        at_shift += block.astype(np.int64)
                if any(np.abs(s).max() > 1 << 61 for s in sums.values()):
                    yield from rows_of(sums)
                    sums = {}
        yield from rows_of(sums)

    def rows_of(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for shift, s in sums.items():
            yield pa.record_batch({"shift": pa.array([shift] * (d + 1), pa.int32()), "i": pa.array(range(d + 1), pa.int32()),
                                   "row": pa.array(list(s), pa.list_(pa.int64()))})

    parts = rows.select("_x").mapInArrow(part, "shift int, i int, row array<bigint>")
    cells = (parts.select("shift", "i", F.posexplode("row").alias("j", "v"))
             .groupBy("shift", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
    out = np.zeros((d + 1, d), object)
    for r in cells.collect():  # (d + 1) x d numbers a limb pair
        out[r.i, r.j] += int(r.v) << (LIMB * r.shift)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank) with v = L L^T: each step takes the largest diagonal entry that
    is left. In the order of the pivots L is lower triangular."""
    d = len(v)
    left, factor = np.diag(v).copy(), np.zeros((d, d))
    order, floor = np.arange(d), LEAST_PIVOT * max(np.trace(v), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[order[k:]]))
        if left[order[p]] <= floor:
            return factor[:, :k]
        order[[k, p]] = order[[p, k]]
        at, rest = order[k], order[k + 1:]
        factor[at, k] = np.sqrt(left[at])
        factor[rest, k] = (v[rest, at] - factor[rest, :k] @ factor[at, :k]) / factor[at, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of r columns, dealt into rounds of pairs without a common column."""
    ring = list(range(r + r % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < r]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit components as rows) of factor factor^T: plane
    rotations from the right until all columns of the factor are orthogonal."""
    w = factor.copy()
    r = w.shape[1]
    for _ in range(60):  # converges in about ten sweeps
        worst = 0.0
        for a, b in _rounds(r):
            if not len(a):
                continue
            wa, wb = w[:, a], w[:, b]
            na, nb, c = (wa * wa).sum(0), (wb * wb).sum(0), (wa * wb).sum(0)
            cosine = np.abs(c) / np.sqrt(na * nb)
            worst = max(worst, cosine.max())
            turn = cosine > COSINE
            zeta = (nb - na) / np.where(turn, 2 * c, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            w[:, a], w[:, b] = cos * wa - cos * t * wb, cos * t * wa + cos * wb
        if worst <= 4 * COSINE:
            break
    norms = (w * w).sum(0)
    order = np.argsort(-norms, kind="stable")
    components = (w[:, order] / np.sqrt(norms[order])).T
    return norms[order], components


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates: centred first, then projected."""
    mean = np.array([float(Fraction(s, model.n)) for s in model.sums])
    return (x.astype(np.float64) - mean) @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def fit(vectors: DataFrame, components: int | None = 4, column: str = "embedding") -> Whitening:
    """A whitening of the rows of ``usable(vectors)``, each distinct vector once. Of
    several lengths the one that most distinct vectors have is fitted (of two as
    common the greater).

    components: how many to keep, all if None; never more than the rank. A table
    without usable rows, or with one distinct vector, gives a model without components.
    Runs Spark jobs when called.
    """
    prepare(vectors.sparkSession)
    distinct = saved(usable(vectors, column).select("_x").distinct())
    common = distinct.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    if not d:
        return Whitening(0, 0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    distinct = distinct.where(F.size("_x") == d)
    n, s = _sums(distinct, d)
    centre = [(2 * t + n) // (2 * n) for t in s]
    raw = _summed(distinct, centre, d)
    # n^2 V = n * sum y y^T - (sum y) (sum y)^T, in whole numbers.
    exact = n * raw[:d] - np.outer(raw[d], raw[d])
    v = np.array([[float(Fraction(int(e), n * n)) for e in row] for row in exact])
    trace = float(Fraction(sum(int(exact[i, i]) for i in range(d)), n * n))
    values, found = one_sided_jacobi(pivoted_cholesky(v))
    k = len(values) if components is None else min(components, len(values))
    found = found[:k]
    for row in found:  # of the two signs the one with a positive largest entry
        row *= np.sign(row[np.argmax(np.abs(row))])
    model = Whitening(d, n, tuple(s), found, values[:k], trace, 0.0)
    return Whitening(d, n, tuple(s), found, values[:k], trace, _identity_error(distinct, model))


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity,
    from the data: whitened rows are centred, multiplied, and summed by Spark."""
    k, d = len(model.eigenvalues), model.dimension
    if not k:
        return 0.0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _projected(_matrix(batch.column(0), d), model)
            total += w.T @ w
        yield pa.record_batch({"i": pa.array(range(k), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    sums = (distinct.mapInArrow(part, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    return max(abs(r.v / model.n - (r.i == r.j)) for r in sums)


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows of ``usable(vectors)`` of the model's dimension, with ``deviation``
    (decimal(38,0), the sum of (n x - S)^2, exact; null if it has more digits) and ``whitened`` (one number a
    component). Columns of ``vectors`` with these names give way."""
    prepare(vectors.sparkSession)
    kept = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    rows = usable(vectors, column).where(F.size("_x") == model.dimension).drop("deviation", "whitened")
    n, d = model.n, model.dimension
    middle = np.array(model.sums, object)
    bound = max((abs(s) for s in model.sums), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), d) if d and batch.num_rows else np.zeros((batch.num_rows, d), np.int64)
            # In 64 bits if every square and their sum fit, else in Python integers.
            largest = n * max(map(abs, (int(x.max()), int(x.min())))) + bound if x.size else 0
            wide = largest * largest * max(d, 1) >= 1 << 63
            away = n * (x.astype(object) if wide else x) - (middle if wide else middle.astype(np.int64))
            deviation = (away * away).sum(axis=1) if d else [0] * len(x)
            whitened = list(_projected(x, model)) if d else [[]] * len(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([str(int(v)) for v in deviation], pa.string()), pa.array(whitened, pa.list_(pa.float64()))],
                names=[*batch.schema.names[:-1], "deviation", "whitened"])

    fields = [vectors.schema[c] for c in kept] + [T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    out = rows.select(*[F.col(f"`{c}`") for c in kept], "_x").mapInArrow(project, T.StructType(fields))
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
