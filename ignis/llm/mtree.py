"""Exact top-k search by inner product over an M-tree.

Vectors become integers, and equal vectors one entry with its smallest ids.  The
entries are divided around routing objects, level by level, until a node fits a
page; a page holds leaf nodes, each with a routing object, a covering radius and
its entries' distances to that object (their parent distances).

With |x - p| <= r for every x of a node around p, the triangle inequality and
that of Cauchy and Schwarz give qx <= qp + |q| r: the most that the node can
score.  For a single entry r is its parent distance, which is stored, so the
entry's own score need not be computed where that bound is below the k-th best
found.  Search is best-first: a query first goes to the page with the highest
bound; what it finds there says which other pages can still hold a better or
equal score, and it goes to those, where the nodes are again taken by falling
bound.  Nothing that could belong to the result is passed over.

Queries meet pages in blocks of bounded size; only hits that reach a query's
k-th best so far leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.llm.common import cut, hot_join

#: Entries of a page, entries of a leaf node, children that a node is divided into, queries of a block.
PAGE, LEAF, CHILDREN, QUERIES = 8_192, 128, 64, 4_096
SCALE = 64
#: Divisions by distance; a node that is still too large then is dealt by hash (its bounds hold all the same).
DIVISIONS = 12
_EXACT = 2.0 ** 52


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and x (floor of scale times each component, as long); one row an
    id and vector; without rows whose id or vector is null, or whose vector is
    empty or holds a component that is null or not finite."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(F.lit(scale) * c)).alias("x"))
            .dropDuplicates(["vec_id", "x"]))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """entry, dim, x and ids (the k + 1 smallest ids of the vector, which are all
    that can be among k results beside the query's own) of each distinct vector."""
    order = Window.partitionBy("dim", "x").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)  # cut down before the shuffle, too
    return few.groupBy("dim", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.xxhash64("dim", "x").alias("entry"), "dim", "x", "ids")


def divide(found: DataFrame, page: int = PAGE, children: int = CHILDREN) -> DataFrame:
    """The entries with their page: a key of the node, whose entries are at most
    about ``page``.

    Each round deals the nodes that are too large: routing objects are the entries
    that come first by hash, and every entry goes to the nearest.  A node's
    entries are dealt to several tasks, each with the node's routing objects."""
    left = cut(found.withColumn("node", F.xxhash64("dim")))
    done = None
    for level in range(DIVISIONS + 1):
        sizes = left.groupBy("node").agg(F.count("*").alias("size"))
        sized = cut(hot_join(left, cut(sizes.withColumn("weight", F.col("size"))), ["node"], "weight", ["entry"]))
        fits, big = sized.where(F.col("size") <= page).drop("size"), sized.where(F.col("size") > page)
        done = fits if done is None else done.unionByName(fits)
        if not big.limit(1).count():
            return cut(done)
        if level == DIVISIONS:
            parts = F.ceil(F.col("size") / F.lit(page))
            return cut(done.unionByName(big.withColumn("node", F.xxhash64("node", F.pmod(F.xxhash64("entry", F.lit(level)), parts))).drop("size")))
        dealt = big.withColumn("part", F.pmod(F.xxhash64("entry"), F.ceil(F.col("size") / F.lit(4 * page))).cast("int"))
        first = Window.partitionBy("node").orderBy(F.xxhash64("entry", F.lit(level)), "entry", "x")
        routing = dealt.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= children)  # cut down before the shuffle, too
        routing = routing.where(F.col("nth") <= F.ceil(2 * F.col("size") / F.lit(page)) + 1).select("node", "nth", F.col("x").alias("p"))
        routing = dealt.select("node", "part").distinct().join(routing, "node").select(
            F.col("node").alias("of"), F.col("part").alias("to"), "nth", "p")

        def deal(own: pd.DataFrame, objects: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return own.assign(nth=[])[["entry", "dim", "x", "ids", "node", "nth"]]
            x, p = (np.stack(c.to_list()).astype(np.float64) for c in (own["x"], objects["p"]))
            half = (p * p).sum(1) / 2
            near = np.concatenate([np.argmax(x[i:i + 1024] @ p.T - half, axis=1) for i in range(0, len(x), 1024)])
            return own.assign(nth=objects["nth"].to_numpy()[near])[["entry", "dim", "x", "ids", "node", "nth"]]
        spread = dealt.select("node", "part", "entry", "dim", "x", "ids").groupBy("node", "part").cogroup(routing.groupBy("of", "to")).applyInPandas(
            deal, "entry long, dim int, x array<long>, ids array<long>, node long, nth int")
        left = cut(spread.select("entry", "dim", "x", "ids", F.xxhash64("node", "nth").alias("node")))
    raise AssertionError


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as doubles where these hold them exactly, or as whole numbers."""
    x = np.stack(column.to_list())
    return x.astype(np.float64) if np.abs(x.astype(np.float64)).max(initial=0) < 2.0 ** 31 else x.astype(object)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q (one vector, or one a row)."""
    if x.dtype == object or q.dtype == object:
        return x.astype(object) @ q.astype(object).T
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[-1] < _EXACT:
        return x @ q.T
    return x.astype(np.int64).astype(object) @ q.astype(np.int64).astype(object).T


class Page:
    """The leaf nodes over a page's entries."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF):
        n = len(x)
        real = x.astype(np.float64)
        count = max(1, -(-n // leaf))
        routing = real[np.linspace(0, n - 1, count).astype(int)]
        half = (routing * routing).sum(1) / 2
        parent = np.argmax(real @ routing.T - half, axis=1)
        distance = np.linalg.norm(real - routing[parent], axis=1)
        order = np.lexsort((distance, parent))
        self.x, self.real, self.ids = x[order], real[order], [ids[i] for i in order]
        self.distance, parent = distance[order], parent[order]
        used, self.start = np.unique(parent, return_index=True)
        self.end = np.append(self.start[1:], n)
        self.routing = routing[used]
        self.radius = np.maximum.reduceat(self.distance, self.start)
        self.size = max(1.0, float(np.linalg.norm(self.real, axis=1).max()))

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> tuple[list[tuple[int, int]], int]:
        """(score, id) of the k best of at least ``floor``, and how many scores were computed."""
        real = q.astype(np.float64)
        length = float(np.linalg.norm(real))
        slack = 1e-12 * length * self.size  # rounding of the bounds
        at = self.routing @ real
        bound = at + length * self.radius + slack
        best: list[tuple[int, int]] = []
        least, computed = floor, 0
        for node in np.argsort(-bound, kind="stable").tolist():
            if bound[node] < least:
                break
            start, end = int(self.start[node]), int(self.end[node])
            # parent distances rise within a node: those too short to reach the k-th best stand first
            if length:
                start += int(np.searchsorted(self.distance[start:end], (least - slack - at[node]) / length - 1e-9 * (1 + self.radius[node])))
            score = products(self.x[start:end], q)
            computed += end - start
            hits = np.flatnonzero(score >= least)
            if not len(hits):
                continue
            for i in hits.tolist():
                best += [(-int(score[i]), int(v)) for v in self.ids[start + i] if v != own]
            held: dict[int, int] = {}
            for s, v in sorted(best):  # of an id with several vectors the best
                held.setdefault(v, s)
                if len(held) == k:
                    break
            best = [(s, v) for v, s in held.items()]
            if len(best) == k:
                least = max(least, -best[-1][0])
        return [(-s, v) for s, v in best], computed


def _clip(score: int) -> int:
    return max(-2 ** 63, min(2 ** 63 - 1, score))


_HITS = "query_id long, vec_id long, score long, exact string"


def _visit(visits: DataFrame, pages: DataFrame, k: int, leaf: int, queries: int) -> DataFrame:
    """Hits of the visits (node, query_id, dim, q, floor) among the pages' entries.

    The visits of a page are dealt into blocks, the page's entries copied for each."""
    count = cut(visits.groupBy("node").agg(F.count("*").alias("visits")).withColumn("blocks", F.ceil(F.col("visits") / F.lit(queries)).cast("int")))
    left = hot_join(visits, count.select("node", "blocks", "visits"), ["node"], "visits", ["query_id", "q"]).select("node", F.pmod(F.xxhash64("query_id", "q"), F.col("blocks")).cast("int").alias("block"), "query_id", "q", "floor")
    right = pages.join(count, "node").select(F.col("node").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"),
                                             "entry", "x", "ids")

    def run(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(held):
            held = held.sort_values("entry", kind="stable")
            page = Page(_matrix(held["x"]), held["ids"].to_list(), leaf)
            q = _matrix(asks["q"])
            for i, (own, floor) in enumerate(zip(asks["query_id"].tolist(), asks["floor"].tolist())):
                found, _ = page.search(q[i], own, k, -np.inf if floor is None else int(floor))
                out += [(own, v, _clip(s), str(s)) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "exact"])
    return left.groupBy("node", "block").cogroup(right.groupBy("of", "to")).applyInPandas(run, _HITS)


def _directory(pages: DataFrame) -> DataFrame:
    """dim, node, centre (mean of the entries) and radius of each page."""
    def ball(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["x"].to_list()).astype(np.float64)
        centre = x.mean(0)
        return pd.DataFrame({"dim": [x.shape[1]], "node": own["node"].iloc[:1].to_numpy(), "centre": [centre],
                             "radius": [float(np.linalg.norm(x - centre, axis=1).max())]})
    return pages.select("node", "x").groupBy("node").applyInPandas(ball, "dim int, node long, centre array<double>, radius double")


def _routes(asks: DataFrame, pages: DataFrame, best: bool, queries: int, nodes: int = 8_192) -> DataFrame:
    """Visits (node, query_id, dim, q, floor): each query's page of the highest
    bound, or (``best`` false) all other pages whose bound reaches its floor.
    Blocks of queries meet blocks of pages."""
    tile = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    chunks, shelves = (max(1, -(-df.count() // size)) for df, size in ((asks, queries), (pages, nodes)))
    left = asks.withColumn("chunk", tile(chunks, "query_id", "q")).withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    right = pages.withColumn("shelf", tile(shelves, "node")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(
        F.col("dim").alias("of"), F.col("chunk").alias("c"), F.col("shelf").alias("s"), "node", "centre", "radius")

    def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(held):
            centre, radius, node = np.stack(held["centre"].to_list()), held["radius"].to_numpy(), held["node"].to_numpy()
            size = np.linalg.norm(centre, axis=1) + radius
            for query, dim, q, floor, seen in zip(own["query_id"].tolist(), own["dim"].tolist(), own["q"], own["floor"], own["seen"].tolist()):
                real = np.asarray(q, dtype=np.float64)
                bound = centre @ real + np.linalg.norm(real) * (radius + 1e-9 * size)
                if best:
                    at = int(np.argmax(bound))
                    out.append((node[at], query, dim, q, None, bound[at]))
                else:
                    least = -np.inf if floor is None else int(floor) - abs(int(floor)) * 1e-12
                    out += [(node[j], query, dim, q, floor, bound[j]) for j in np.flatnonzero(bound >= least) if node[j] != seen]
        return pd.DataFrame(out, columns=["node", "query_id", "dim", "q", "floor", "bound"])
    routes = left.groupBy("dim", "chunk", "shelf").cogroup(right.groupBy("of", "c", "s")).applyInPandas(
        run, "node long, query_id long, dim int, q array<long>, floor string, bound double")
    if best:
        order = Window.partitionBy("query_id", "q").orderBy(F.col("bound").desc(), "node")
        routes = routes.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return cut(routes.select("node", "query_id", "dim", "q", "floor"))


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query; of an id with several vectors the best."""
    one = Window.partitionBy("query_id", "vec_id").orderBy(F.col("exact").cast("decimal(38,0)").desc())
    order = Window.partitionBy("query_id").orderBy(F.col("exact").cast("decimal(38,0)").desc(), "vec_id")
    single = hits.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
           page: int = PAGE, leaf: int = LEAF, children: int = CHILDREN, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products
    among the rows of ``vectors`` with another id, ties to the smaller vec_id.

    Vectors that are null, empty, or hold null or non-finite components take no
    part, on either side; vectors meet only vectors of their own length; rows that
    repeat an id and vector count once, and an id with several vectors scores by
    its best; fewer than k candidates give fewer rows; empty tables give none;
    components and scores beyond a long go to the nearest long; other columns are
    not read."""
    pages = divide(entries(integers(vectors, scale, id_col, vector_col), k), page, children)
    directory = cut(_directory(pages))
    asks = cut(integers(queries, scale, id_col, vector_col).select(
        F.col("vec_id").alias("query_id"), "dim", F.col("x").alias("q"), F.lit(None).cast("string").alias("floor"), F.lit(None).cast("long").alias("seen")))
    first = _routes(asks, directory, True, block)
    near = cut(_top(_visit(first, pages, k, leaf, block), k))
    # the k-th best so far; a query with several vectors has one floor for all
    floor = near.where(F.col("rank") == k).select("query_id", F.col("exact").alias("floor"))
    again = cut(first.select("query_id", "dim", "q", F.col("node").alias("seen")).join(floor, "query_id", "left"))
    rest = _visit(_routes(again, directory, False, block), pages, k, leaf, block)
    return _top(near.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
