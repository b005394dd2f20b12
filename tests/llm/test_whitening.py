import math

import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from ignis.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, score string"
NAN, INF = float("nan"), float("inf")


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v], "x") for i, v in enumerate(x)], SCHEMA)


def brute(rows):
    """Per length: {(vec_id, component): values} by dense eigenvectors of the exact integer covariance."""
    out = {}
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
              if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(v) for _, v in usable}:
        own = [(i, v) for i, v in usable if len(v) == dim]
        fit = sorted({tuple(v) for _, v in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        x = np.array(fit, dtype=np.float64) - np.array([s / n for s in sums])
        values, vectors = np.linalg.eigh(x.T @ x / n)
        for k in range(min(4, dim)):
            e, u = values[-1 - k], vectors[:, -1 - k]
            if e <= 1e-12 * values.sum():
                continue
            for i, v in own:
                centred = np.array([c - s / n for c, s in zip(v, sums)])
                out.setdefault((i, k + 1, dim), []).append(
                    (n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), centred @ u / math.sqrt(e), e / values.sum()))
    return out


def check(got, want, tolerance=1e-9):
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        match = [w for (i, c, _), ws in want.items() if (i, c) == (r.vec_id, r.component) for w in ws if w[:2] == (r.n, r.deviation)]
        assert match
        _, _, whitened, explained = match[0]
        assert abs(abs(r.whitened) - abs(whitened)) < tolerance * (1 + abs(whitened)) and abs(r.explained - explained) < 1e-9 * explained + 1e-15
        if abs(whitened) > 1e-6:
            assert signs.setdefault((r.component, r.n), r.whitened * whitened > 0) == (r.whitened * whitened > 0)
        assert r.identity_error < 1e-9


def test_embeddings_equal_dense_eigenvectors(spark):
    vectors = spark.read.parquet(f"{SF01}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    check(queries.op12_lanczos_whitening(spark, SF01).collect(), want)


def test_near_and_low_rank_spectra(spark):
    rng = np.random.default_rng(2)
    for spread in ([9, 8.9, 8.8, 8.7, 8.6, 1, 1, 1], [50, 5, 0.5, 0, 0, 0, 0, 0], [1000, 1, 1e-1, 1e-1, 3e-2, 0, 0, 0]):
        x = rng.standard_normal((400, 8)) * spread
        want = brute([(i, v.tolist()) for i, v in enumerate(x)])
        got = whitening.whiten(frame(spark, x).repartition(3)).collect()
        check([r for r in got if r.component < 4], {k: w for k, w in want.items() if k[1] < 4}, 1e-6)


def test_left_and_right_vectors_stay_orthogonal(spark):
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((300, 12)) @ np.diag(np.geomspace(100, 1e-2, 12))).astype(np.int64)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    vectors, s, total = whitening.bidiagonalise(rows, 12, x.mean(0), 12)
    centred = x - x.mean(0)
    assert np.allclose(s, np.linalg.svd(centred, compute_uv=False), rtol=1e-9, atol=1e-9 * s[0])
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-13 and abs(total - (centred ** 2).sum()) < 1e-9 * total


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.5, 2.0]), (None, [3.0, -1.0]), (4, None), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [0.0, 0.0]), (10, [0.001, -0.001]), (11, [1.0, 2.0, 3.0]), (12, [2.0, 2.0, 3.0]), (13, [7.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).withColumn("x", F.lit("x")).withColumn("dim", F.lit(1))
    got = whitening.whiten(v).collect()
    check([r for r in got if r.vec_id is not None and r.vec_id < 11],
          {k: w for k, w in brute(rows).items() if k[0] is not None and k[2] == 2}, 1e-9)
    assert [r.component for r in got if r.vec_id is None] == [1, 2]
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got if r.vec_id in (11, 12, 13)) == [(11, 1, 2, 256 ** 2), (12, 1, 2, 256 ** 2)]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]])).count() == 0


def test_huge_entries(spark):
    rows = [(i, [float(3e30 * (i - 1)), float(i % 2)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert {r.vec_id for r in got} == set(range(4)) and all(r.deviation is None for r in got)


def test_a_hot_vector_counts_once_in_the_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    many = np.concatenate([x, np.repeat(x[:1], 3000, axis=0)])
    got = whitening.whiten(frame(spark, many).repartition(5))
    check(got.where("vec_id < 200").collect(), brute([(i, v.tolist()) for i, v in enumerate(x)]))
    assert got.count() == 3200 * 4


def test_partial_sums_may_be_added_in_spark(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 5))
    monkeypatch.setattr(whitening, "PARTIALS", 2)
    monkeypatch.setattr(whitening, "packed", lambda rows, dim: rows.repartition(7))
    check(whitening.whiten(frame(spark, x)).collect(), brute([(i, v.tolist()) for i, v in enumerate(x)]))
