import math

import duckdb
import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from ignis.llm import mtree, queries

SCHEMA = "vec_id long, embedding array<float>, score string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], SCHEMA)


def brute(rows, asks, k=20):
    usable = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows
              if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for q, x in usable:
        if not asks(q):
            continue
        best = out.setdefault(q, {})
        for i, y in usable:
            if i != q and len(x) == len(y):
                s = sum(a * b for a, b in zip(x, y))
                best[i] = max(best.get(i, s), s)
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    return sorted((q, r, i, clip(s)) for q, best in out.items()
                  for r, (i, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k], 1))


def got(df):
    return sorted(map(tuple, df.collect()))


def test_embeddings_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF01}/embeddings.parquet')")
    want = sorted(con.execute(queries.ORACLE["op13_mtree_topk"]).fetchall())
    assert got(queries.op13_mtree_topk(spark, SF01)) == want and len(want) == 25 * 20


def test_many_pages_and_levels_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((30, 6)) * 4
    rows = [(i, (middle[i % 30] * (1 + i % 3) + rng.standard_normal(6) * 0.1).tolist()) for i in range(1500)]
    rows += [(2000 + i, [0.5, 0.25, 0, 0, 0, 1]) for i in range(200)]      # copies: ties
    rows += [(5000 + i, [(i % 5) / 64, 0, 0, 0, 0, 0]) for i in range(100)]
    rows += [(40 * i, rows[i][1]) for i in range(1, 6)]                     # ids with two vectors
    vectors = frame(spark, rows).repartition(4)
    asks = lambda i: i % 20 == 0
    assert got(mtree.search(vectors, vectors.where("vec_id % 20 = 0"), page=100, leaf=8, children=5, block=16)) == brute(rows, asks)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (20, [0.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [NAN, 1.0]), (40, [INF, 1.0]),
            (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (60, [1.0, 2.0, 3.0]), (9, [0.0, 1.0, 0.0]), (10, [-0.01, -0.01])]
    v = frame(spark, rows).withColumn("rank", F.lit(1)).withColumn("x", F.lit(1)).withColumn("node", F.lit(1))
    asks = lambda i: i % 20 == 0
    assert got(mtree.search(v, v.where("vec_id % 20 = 0"))) == brute(rows, asks)
    assert got(mtree.search(v, v, 2)) == brute(rows, lambda i: True, 2)
    none = spark.createDataFrame([], SCHEMA)
    assert mtree.search(none, none).count() == 0 and mtree.search(v, none).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(2 ** 40 + 2 ** 18 * i), -float(2 ** 40), float(i % 3)]) for i in range(60)]
    v = frame(spark, rows)
    assert got(mtree.search(v, v.where("vec_id % 20 = 0"), 5, page=16, leaf=4)) == brute(rows, lambda i: i % 20 == 0, 5)


def test_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist() if i % 3 else [1.0, 1.0, 1.0, 1.0]) for i in range(3000)]
    v = frame(spark, rows).repartition(6)
    some = v.where("vec_id % 400 = 0")
    assert got(mtree.search(v, some, page=256, leaf=16)) == brute(rows, lambda i: i % 400 == 0)
    distinct = mtree.entries(mtree.integers(v, 64, "vec_id", "embedding"), 20)
    assert max(len(r.ids) for r in distinct.collect()) == 21
    assert "WindowGroupLimit" in distinct._jdf.queryExecution().executedPlan().toString()


def test_bounds_spare_computations():
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((40, 16)) * 3
    x = np.floor(64 * (middle[np.arange(4000) % 40] + 0.2 * rng.standard_normal((4000, 16))))
    page = mtree.Page(x, [np.array([i]) for i in range(4000)])
    total = 0
    for i in range(0, 4000, 40):
        found, computed = page.search(x[i], i, 20, -np.inf)
        scores = x @ x[i]
        order = [j for j in np.lexsort((np.arange(4000), -scores)) if j != i][:20]
        assert [v for _, v in found] == order and [s for s, _ in found] == [int(scores[j]) for j in order]
        total += computed
    assert total < 100 * 4000 * 0.25
    assert (page.radius[np.repeat(np.arange(len(page.start)), page.end - page.start)] >= page.distance).all()


def test_pages_hold_all_entries_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(2000)]
    found = mtree.entries(mtree.integers(frame(spark, rows), 64, "vec_id", "embedding"), 20)
    pages = mtree.divide(found, 150, 6)
    sizes = [r["count"] for r in pages.groupBy("node").count().collect()]
    assert sum(sizes) == found.count() and max(sizes) <= 150
    assert pages.select("dim", "x").distinct().count() == sum(sizes)
