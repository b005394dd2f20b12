import numpy as np
import pyarrow as pa
from conftest import SF01
from pyspark.sql import functions as F
from tricky import ROWS, empty, prose, tricky

from ignis.llm import quality_qda as qda
from ignis.llm import queries


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    got = queries.op7_quadratic_discriminant(spark, SF01)
    truth = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.where("held_out").join(truth, "doc_id").select("predicted", "quality", "score").collect()
    assert len(rows) > 50
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) >= 0.98
    assert sum(1 - r.predicted for r in bad) / len(bad) >= 0.8
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_tricky_rows_and_odd_labels(spark):
    truth = labels(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (7, 1, 0), (7, 0, 0), (11, 0, 0), (8, 0, 0), (5, 0, None), (None, 1, 0), (2, None, 0), (99, 0, 0)])
    rows = qda.classify(tricky(spark), truth).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.held_out for r in rows) == sum(d is not None and __import__("zlib").crc32(str(d).encode()) % 5 == 0 for d, *_ in ROWS)
    assert {r.score for r in qda.classify(tricky(spark), labels(spark, [])).collect()} == {0.5}
    assert qda.classify(empty(spark), truth).count() == 0
    kept = qda.keep(tricky(spark), truth)
    assert kept.columns == tricky(spark).columns
    want = sorted(str(r.doc_id) for r in rows if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_score_is_the_gaussian_difference():
    rng = np.random.default_rng(1)
    d = len(qda.FEATURES)
    a, b = rng.standard_normal((d, d)), rng.standard_normal((d, d))
    cov = [a @ a.T + np.eye(d), b @ b.T + np.eye(d)]
    means = rng.standard_normal((2, d))
    factors = [np.linalg.cholesky(c) for c in cov]
    model = qda.Discriminant(np.zeros(d), np.ones(d), (np.log(0.3), np.log(0.7)), (means[0], means[1]),
                             tuple(np.linalg.inv(f) for f in factors), tuple(float(np.log(np.diag(f)).sum()) for f in factors))
    x = rng.standard_normal((5, d))
    log = [np.log((0.3, 0.7)[c]) - 0.5 * np.linalg.slogdet(cov[c])[1]
           - 0.5 * np.einsum("ij,jk,ik->i", x - means[c], np.linalg.inv(cov[c]), x - means[c]) for c in (0, 1)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_moments_add_up_over_partitions(spark):
    texts = [prose(i, 30 + i % 90) + ("!!" if i % 4 == 0 else "") for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    truth = labels(spark, [(i, int(i % 4 != 0), 0) for i in range(120)])
    one, many = (qda.fit(qda.features(docs.repartition(k)), truth) for k in (1, 7))
    x = qda.statistics(pa.array(texts))
    assert np.allclose(one.score(x), many.score(x), atol=1e-6)
    z = (x - one.centre) / one.scale
    assert np.allclose(one.means[1], np.clip(z, -qda.CLIP, qda.CLIP)[[i % 4 != 0 for i in range(120)]].mean(0))
