"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never gathered, nor is their covariance formed.  Each step
of the bidiagonalisation is one pass over the rows: a task makes its part of
u = Xv (less the last u, as the recurrence asks), and with it its part of X'u, of
u's products with all earlier left vectors and of u's norm.  The left vectors lie
with the rows: each is X times a vector as long as a row, which the driver keeps,
so a task makes its part of them anew.  Both sides are reorthogonalised against
all earlier vectors; the singular values and vectors of the small bidiagonal
matrix give the components and their deviations.

Only vectors as long as a row reach the driver, one for each step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.llm.common import cut

COMPONENTS, SCALE = 4, 256
#: Bytes of a partition of the fit list, and partial sums that the driver adds up itself.
PART_BYTES, PARTIALS = 1 << 24, 64
#: Components whose share of the trace is below this are rounding errors of a vanishing one.
LEAST_SHARE = 1e-13


def integers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and x (floor of scale times each entry, as long) of the rows
    whose vector is not null and holds neither null nor non-finite entries.  An
    entry beyond the longs goes to the nearest long."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    return (vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
            .where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(F.lit(scale) * c)).alias("x")))


def matrix(x: pa.Array, dim: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Fit:
    """What the fit list tells: its length n, sums S (exact), the components
    (one a column, falling eigenvalue), their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def _added(parts: list[bytes]) -> np.ndarray:
    return np.sum([np.frombuffer(v, dtype=np.float64) for v in parts], axis=0)


def _summed(rows: DataFrame, run, length: int) -> np.ndarray:
    """Sum over all tasks of the arrays of ``length`` doubles that ``run`` makes
    of a task's matrices.  The driver adds up at most PARTIALS arrays; more are
    first added up in Spark."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += run(batch.column("x"))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(own: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([_added(own.column("v").to_pylist()).tobytes()], pa.binary())})
    parts = rows.select("x").mapInArrow(task, "v binary")
    if rows.rdd.getNumPartitions() > PARTIALS:
        parts = parts.withColumn("to", F.spark_partition_id() % PARTIALS).groupBy("to").applyInArrow(add, "v binary")
    return _added([r["v"] for r in parts.collect()])


def packed(distinct: DataFrame, dim: int) -> DataFrame:
    """The rows in partitions of about PART_BYTES: they are read once a step."""
    return distinct.coalesce(max(1, -(-distinct.count() * dim * 8 // PART_BYTES)))


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            n += len(x)
            if len(x):
                small = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0 ** 62
                part = x.sum(0) if small else x.astype(object).sum(0)
                total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array([str(v) for v in (*total, n)])], ["i", "v"])
    found = rows.select("x").mapInArrow(task, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by = {r["i"]: int(r["v"] or 0) for r in found.collect()}
    return by.get(dim, 0), [by.get(i, 0) for i in range(dim)]


def bidiagonalise(rows: DataFrame, dim: int, mean: np.ndarray, components: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (one a column) and singular values of the centred
    rows, largest first, as far as there are and at most ``components``; and the
    sum of squares of all entries.

    Steps go on until the values asked for have residuals at rounding level, or
    the rows' whole space is spanned."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal(dim)
    right = [v / np.linalg.norm(v)]
    left: list[np.ndarray] = []       # u = X p: the vectors p
    back: list[np.ndarray] = []       # X'u of each
    alpha: list[float] = []
    beta: list[float] = []
    scale = total = 0.0
    while True:
        q = right[-1] - (beta[-1] * left[-1] if left and beta else 0.0)
        while True:  # u = Xq, held against all earlier left vectors; again where most of it was theirs
            p = np.stack(left, axis=1) if left else np.zeros((dim, 0))
            def products(x: pa.Array, q=q, p=p) -> np.ndarray:
                centred = matrix(x, dim) - mean
                u = centred @ q
                return np.concatenate([centred.T @ u, (centred @ p).T @ u, [u @ u, np.einsum("ij,ij->", centred, centred)]])
            got = _summed(rows, products, dim + p.shape[1] + 2)
            xu, shared, norm2, total = got[:dim], got[dim:-2], got[-2], got[-1]
            if not total:
                return np.zeros((dim, 0)), np.zeros(0), 0.0
            after = norm2 - shared @ shared
            q = q - p @ shared
            xu = xu - (np.stack(back, axis=1) @ shared if back else 0.0)
            if after > 0.25 * norm2 or norm2 <= (1e-15 * np.sqrt(total)) ** 2:
                break
        a = float(np.sqrt(max(after, 0.0)))
        scale = max(scale, a)
        if a <= 1e-14 * np.sqrt(total):
            alpha.append(0.0)  # nothing of the rows lies beyond the vectors found
            left.append(np.zeros(dim))
            back.append(np.zeros(dim))
        else:
            alpha.append(a)
            left.append(q / a)
            back.append(xu / a)
        w = back[-1] - alpha[-1] * right[-1]
        basis = np.stack(right, axis=1)
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        b = float(np.linalg.norm(w))
        small = np.diag(alpha) + np.diag(beta, 1) if beta else np.diag(alpha)  # upper bidiagonal: X V = U B
        us, s, vt = np.linalg.svd(small)
        k = min(components, len(s))
        residual = b * np.abs(us[-1, :k])
        gaps = [min([abs(s[i] - s[j]) for j in (i - 1, i + 1) if 0 <= j < len(s)], default=s[i]) for i in range(k)]
        done = len(right) >= dim or (len(s) > components and all(r <= max(1e-14 * g, 4e-16 * s[0]) for r, g in zip(residual, gaps)))
        if done:
            return basis @ vt[:k].T, s[:k], float(total)
        if b <= 1e-14 * scale:  # an invariant space: go on with a vector outside it
            w = rng.standard_normal(dim)
            for _ in range(2):
                w = w - basis @ (basis.T @ w)
            b, norm = 0.0, np.linalg.norm(w)
            w = w / norm
        else:
            w = w / b
        beta.append(b)
        right.append(w)


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """The fit over the distinct rows x of one length (stored: read once a step)."""
    n, sums = exact_sums(distinct, dim)
    mean = np.array([s / n for s in sums])
    vectors, s, total = bidiagonalise(distinct, dim, mean, min(components, dim))
    values = s ** 2 / n
    real = values > LEAST_SHARE * total / n
    return Fit(n, sums, vectors[:, real], values[real], total / n)


def projected(x: np.ndarray, found: Fit) -> np.ndarray:
    mean = np.array([s / found.n for s in found.sums])
    return (x - mean) @ found.components / np.sqrt(found.values)


def identity_error(distinct: DataFrame, found: Fit, dim: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(found.values)
    def moments(x: pa.Array) -> np.ndarray:
        w = projected(matrix(x, dim), found)
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])
    got = _summed(distinct, moments, k * k + k)
    mean = got[k * k:] / found.n
    return float(np.abs(got[:k * k].reshape(k, k) / found.n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, found: Fit) -> list[int | None]:
    """Exact sums of (n x - S)^2; null where they pass a long."""
    reach = max(float(np.abs(x.astype(np.float64)).max(initial=0.0)), 1.0) * found.n + max(abs(s) for s in found.sums)
    if reach ** 2 * x.shape[1] < 2.0 ** 62:
        d = x * found.n - np.array(found.sums)
        return (d * d).sum(1).tolist()
    exact = [sum((int(e) * found.n - s) ** 2 for e, s in zip(row, found.sums)) for row in x.tolist()]
    return [e if e < 2 ** 63 else None for e in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error of every remaining row, for each of up to ``components``
    components of the fit list (each distinct x once).

    Null vectors and vectors with a null or non-finite entry are dropped; repeated
    rows each have their rows, with a null id too; vectors of different lengths
    are whitened apart, each length by its own fit; a component without variance
    is not returned, so a length with fewer than two distinct vectors, or no
    entries, gives no rows, and neither does an empty table; other columns are not
    read."""
    rows = cut(integers(vectors, scale, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("long")))
    out = None
    for dim in sorted(r["dim"] for r in rows.where("dim > 0").select("dim").distinct().collect()):
        own = rows.where(F.col("dim") == dim)
        distinct = packed(cut(own.select("x").distinct()), dim)
        found = fit(distinct, dim, components)
        if not len(found.values):
            continue
        error = identity_error(distinct, found, dim)

        def run(batches: Iterator[pa.RecordBatch], found=found, error=error, dim=dim) -> Iterator[pa.RecordBatch]:
            k = len(found.values)
            for batch in batches:
                x, n = matrix(batch.column("x"), dim), batch.num_rows
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                     pa.array(np.full(n * k, found.n)), pa.array(deviations(x, found), pa.int64()).take(pa.array(each)),
                     pa.array(projected(x, found).ravel()), pa.array(np.tile(found.values / found.trace, n)), pa.array(np.full(n * k, error))],
                    [c.split()[0] for c in SCHEMA.split(", ")])
        part = own.select("vec_id", "x").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], SCHEMA)
