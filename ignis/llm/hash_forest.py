"""Hash-prefix forest for approximate nearest neighbours (Euclidean distance).

Each tree gives every vector a long string of hash bits (signs of random
projections of the centred vector) and keeps the strings sorted.  A query
descends each tree to the place of its longest matching prefix, then all trees
ascend together, one bit at a time, taking in every vector that shares the
shorter prefix, until the vectors still unseen are unlikely to be nearer than
those found.  Candidates are scored exactly.

The vectors are dealt into blocks; a block's forest is sorted arrays in one
task's memory, and every query meets every block, so a task holds BLOCK vectors
and QUERIES queries whatever the input.  Only each block's best k leave it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.llm.common import cut

TREES, BITS = 48, 32
BLOCK, QUERIES = 8_192, 8_192
#: Chance, at most, that a vector as near as the k-th found is still unseen when the ascent stops.
MISS = 0.04


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array<double>): one row an id and vector; without rows
    whose id or vector is null, or whose vector is empty, zero, or holds a
    component that is null or not finite."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .where(F.exists("v", lambda c: c != 0))
            .dropDuplicates(["vec_id", "v"]))


@lru_cache(maxsize=4)
def projections(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * bits)).astype(np.float32)


def strings(x: np.ndarray, centre: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Hash strings as unsigned integers whose order is the strings' order; shape (rows, trees)."""
    out = np.empty((len(x), trees), dtype=np.uint32)
    for k in range(0, len(x), 1024):
        sign = (x[k:k + 1024] - centre).astype(np.float32) @ projections(x.shape[1], trees, bits, seed) > 0
        packed = np.packbits(sign.reshape(-1, trees, bits), axis=2)
        out[k:k + 1024] = packed.view(">u4")[..., 0]
    return out


class Forest:
    """Sorted strings per tree over one block.

    The trees' arrays lie one after another, each string under its tree's
    number, so that one binary search places a query in all trees at once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 1):
        self.ids, self.x, self.centre, self.bits = ids, x, centre, bits
        keys = strings(x, centre, trees, bits, seed).T.astype(np.uint64)  # one row a tree
        self.tree = np.arange(trees, dtype=np.uint64) << np.uint64(32)
        order = np.argsort(keys, axis=1, kind="stable")
        self.order = order.astype(np.int32).ravel()
        self.sorted = (np.take_along_axis(keys, order, axis=1) | self.tree[:, None]).ravel()
        self.norm = np.linalg.norm(x - centre, axis=1)

    def _descend(self, place: np.ndarray) -> int:
        """The longest prefix, in bits, that any string of any tree shares with the query's."""
        at = np.searchsorted(self.sorted, place)
        near = self.sorted[np.clip(np.stack([at - 1, at]), 0, len(self.sorted) - 1)] ^ place
        return max(0, self.bits - int(np.frexp(near.min())[1]))

    def search(self, query: np.ndarray, key: np.ndarray, own: int, k: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the nearest found and their distances, nearest first, ties to smaller id."""
        n = len(self.ids)
        seen = np.zeros(n, dtype=bool)
        score = np.full(n, np.inf)
        reach = np.linalg.norm(query - self.centre)
        place = self.tree | key.astype(np.uint64)
        low_was = high_was = None
        found = 0
        for depth in range(self._descend(place), -1, -1):
            step = np.uint64(1 << (self.bits - depth))
            low = place // step * step
            first, last = np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low + step)
            if low_was is None:
                starts, ends = first, last
            else:  # what this level adds on either side
                starts, ends = np.concatenate([first, high_was]), np.concatenate([low_was, last])
            low_was, high_was = first, last
            length = ends - starts
            reached = np.zeros(n, dtype=bool)
            reached[self.order[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())]] = True
            rows = np.flatnonzero(reached & ~seen)
            if len(rows):
                seen[rows] = True
                diff = self.x[rows] - query
                score[rows] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                found += int((self.ids[rows] != own).sum())
            if found >= k and depth:
                ok = np.flatnonzero(seen & (self.ids != own))
                kth = ok[np.argpartition(score[ok], k - 1)[:k]]
                r = score[kth].max()
                # the widest angle that a vector at that distance makes with the query, over the norms of those found
                norm = np.maximum(self.norm[kth], 1e-12)
                cosine = np.clip((norm ** 2 + reach ** 2 - r ** 2) / (2 * norm * max(reach, 1e-12)), -1, 1).min()
                same = 1 - np.arccos(cosine) / np.pi
                if (1 - same ** depth) ** len(self.tree) <= miss:
                    break
        ok = np.flatnonzero(seen & (self.ids != own))
        ok = ok[np.lexsort((self.ids[ok], score[ok]))][:k]
        return ok, score[ok]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           trees: int = TREES, bits: int = BITS, block: int = BLOCK, miss: float = MISS, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among the rows
    of ``vectors`` with another id, nearest first, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no
    part, on either side; vectors meet only vectors of their own length; rows
    that repeat an id and vector count once, and an id with several vectors
    scores by its nearest; fewer than k candidates give fewer rows; empty
    tables give none; other columns are not read."""
    rows = cut(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")))
    asks = cut(usable(queries, id_col, vector_col).withColumn("dim", F.size("v")))
    per_dim = {r["dim"]: (r["n"], r["c"]) for r in _centres(rows).collect()}
    asked = {r["dim"]: r["n"] for r in asks.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    spec = [(d, max(1, -(-per_dim[d][0] // block)), max(1, -(-asked[d] // QUERIES))) for d in per_dim if d in asked]
    sizes = vectors.sparkSession.createDataFrame(spec, "dim int, blocks int, chunks int")  # one row a length
    tile = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(F.broadcast(sizes), "dim").select("dim", tile("blocks").alias("block"), every("chunks").alias("chunk"), "vec_id", "v")
    right = asks.join(F.broadcast(sizes), "dim").select("dim", every("blocks").alias("block"), tile("chunks").alias("chunk"), "vec_id", "v")
    centres = {d: np.array(c) for d, (_, c) in per_dim.items()}

    def tile_search(key, mine, theirs):
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        mine = mine.sort_values("vec_id", kind="stable")
        centre = centres[key[0]]
        forest = Forest(mine["vec_id"].to_numpy(), np.stack(mine["v"].to_list()), centre, trees, bits, seed)
        q = np.stack(theirs["v"].to_list())
        keys = strings(q, centre, trees, bits, seed)
        out = []
        for i, own in enumerate(theirs["vec_id"].to_numpy()):
            at, d = forest.search(q[i], keys[i], own, k, miss)
            out.append((np.full(len(at), own), forest.ids[at], d))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})

    by = ["dim", "block", "chunk"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(tile_search, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _centres(rows: DataFrame) -> DataFrame:
    """Per vector length: rows and mean vector."""
    parts = rows.select("dim", F.posexplode("v").alias("i", "c")).groupBy("dim", "i").agg(F.avg("c").alias("c"), F.count("*").alias("n"))
    return parts.groupBy("dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
