from pyspark.sql import functions as F
import numpy as np
import pyarrow as pa
from conftest import SF01
from tricky import ROWS, empty, tricky

from ignis.llm import lang_id, queries


def test_held_out_accuracy(spark):
    got = queries.op10_family_svm(spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").where("lang is not null").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert got.where("score < 0 or score > 1 or score is null or lang_pred is null").count() == 0


def test_tricky_rows(spark):
    rows = lang_id.identify(tricky(spark)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id in (4, 5, 6, 11):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert r.lang_pred in {"en", "de", "fr", "und"} and 0 <= r.score <= 1
    assert lang_id.identify(empty(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    docs = tricky(spark).drop("lang").withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in lang_id.identify(docs).collect()} == {("und", 0.0)}


def test_unlisted_languages_are_families_of_their_own(spark):
    rows = [(i, ("qa wo zu " if i % 2 else "mek tir lon ") * (3 + i % 5), "xx" if i % 2 else "yy", None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in lang_id.identify(docs).collect())


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('t', id) as text", "if(id % 10 = 0, 'fr', 'en') as lang")
    n = {r["lang"]: r["count"] for r in lang_id.sample(docs, 600, 500).groupBy("lang").count().collect()}
    assert all(200 < v < 400 for v in n.values())


def test_machines_separate():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.2, 1, -1).astype(np.float32)
    x = rng.standard_normal((200, 8)).astype(np.float32) * 0.1
    x[:, 0] += y * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = lang_id.train_svm(x, y)
    assert ((np.hstack([x, np.ones((200, 1))]) @ w > 0) == (y > 0)).mean() > 0.98


def test_vectors_are_of_whole_texts():
    long = "abc " * 50_000 + "ß" * 50_000
    x = lang_id.vectors(pa.array([long, long[:1000], "", None, "123 !"], pa.string()))
    assert not np.allclose(x[0], x[1]) and not x[2:].any() and np.allclose(np.linalg.norm(x[:2], axis=1), 1, atol=1e-3)


def test_a_column_with_very_many_values(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "en").when(F.col("id") % 4 == 1, "fr").otherwise(F.concat(F.lit("x"), "id")).alias("lang"))
    n = {r["lang"]: r["count"] for r in lang_id.sample(docs, 400, 100, 40).groupBy("lang").count().collect()}
    assert len(n) <= 40 and n["en"] >= 4 and n["fr"] >= 4 and sum(n.values()) < 800
    assert set(n) <= {"en", "fr"} | {f"x{i}" for i in range(3, 400, 4)} | {f"x{i}" for i in range(3, 6000, 4)}
