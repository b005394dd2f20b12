import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from ignis.llm import hash_forest, queries

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(ids, x, asks, k=10):
    out = {}
    for i in asks:
        d = np.sqrt(((x - x[list(ids).index(i)]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), d[j]) for j in order]
    return out


def recall(spark, vectors, asks, **more):
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = hash_forest.search(vectors, vectors.where(asks), **more).collect()
    want = brute(ids, x, {r.query_id for r in got})
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    for r in got:
        assert abs(r.score - np.sqrt(((x[ids == r.vec_id][0] - x[ids == r.query_id][0]) ** 2).sum())) < 1e-12
    return hits / sum(len(v) for v in want.values()), got


def test_recall_over_several_blocks(spark):
    vectors = spark.read.parquet(f"{SF01}/embeddings.parquet")
    found, got = recall(spark, vectors, F.col("vec_id") % 10 == 0, block=150)
    assert found >= 0.9
    for q in {r.query_id for r in got}:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_clustered_vectors_stop_early_and_are_found(spark):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((40, 16)) * 3
    x = (middle[np.arange(2000) % 40] + rng.standard_normal((2000, 16)) * 0.2).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    assert recall(spark, vectors, F.col("vec_id") % 50 == 0)[0] >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in hash_forest.search(v, v, 2).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1)]
    assert [s for *_, s in got][:2] == [0.0, 0.0]
    none = spark.createDataFrame([], SCHEMA)
    assert hash_forest.search(none, none).count() == 0 and hash_forest.search(v, none).count() == 0


def test_query_has_all_of_few(spark):
    got = queries.op4_hash_forest(spark, SF01)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert got.count() == 50


def block_recall(x, asks, miss, k=10):
    centre, ids = x.mean(0), np.arange(len(x))
    forest = hash_forest.Forest(ids, x, centre)
    keys = hash_forest.strings(x[asks], centre, hash_forest.TREES, hash_forest.BITS, 1)
    want = brute(ids, x, asks, k)
    return sum(len({*forest.search(x[i], key, i, k, miss)[0].tolist()} & {j for j, _ in want[i]}) for i, key in zip(asks, keys)) / (k * len(asks))


def test_recall_of_a_production_block():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((hash_forest.BLOCK, 16)) * rng.uniform(0.3, 2, (hash_forest.BLOCK, 1))
    asks = list(range(0, hash_forest.BLOCK, 41))
    assert block_recall(x, asks, hash_forest.MISS) >= 0.99  # 0.984 at a miss chance of 0.08
