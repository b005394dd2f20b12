"""Model operators: planted signal is learned, weights move recall,
importances sum to 1, sampled Shapley values add up."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ignis.operators import ml as ML
from ignis.operators import resample as RS
from ignis.plans import views as V


@pytest.fixture(scope="module")
def planted(spark):
    d = V.main_model_rows(spark, SF01)
    # a label with a stronger tie to one feature than the fixture cause has
    d = d.withColumn("label", ((F.col("doy") + (F.col("id") * 31) % 200) > 260).cast("int"))
    return RS.stratified_split(d).persist()


def test_gbt_learns_planted_signal(spark, planted):
    tr, te = planted.where("split = 'train'"), planted.where("split = 'test'")
    model = ML.fit_main_gbt(tr, V.FEATURE_COLS, max_rounds=15,
                            make=lambda rounds: ML.gradient_boosting(max_iter=rounds, depth=4, seed=1, weight="weight"))
    ev = ML.evaluate(ML.score(model, ML.assemble(te, V.FEATURE_COLS))).first()
    assert ev.roc_auc > 0.8
    imp = model.featureImportances.toArray()
    assert abs(sum(imp) - 1.0) < 1e-9
    table = ML.importance_table(spark, V.FEATURE_COLS, imp, V.FEATURE_LABELS).collect()
    assert table[0].feature == "doy" or table[0].feature.startswith("doy")
    assert abs(table[-1].cumulative - 1.0) < 1e-9


def test_class_weights_raise_recall(spark, planted):
    tr, te = planted.where("split = 'train'"), planted.where("split = 'test'")
    x = ML.assemble(tr, V.FEATURE_COLS)
    w = RS.class_weights(x, "label").withColumn("weight", F.when(F.col("label") == 1, 5.0).otherwise(1.0))
    lr_plain = ML.logistic_regression(tr.count(), max_iter=50).fit(w)
    lr_w = ML.logistic_regression(tr.count(), max_iter=50, weight="weight").fit(w)
    t = ML.assemble(te, V.FEATURE_COLS)
    rec = [ML.evaluate(ML.score(m, t)).first().recall for m in (lr_plain, lr_w)]
    assert rec[1] > rec[0]


def test_sampled_shapley_efficiency(spark, planted):
    tr, te = planted.where("split = 'train'"), planted.where("split = 'test'")
    model = ML.gradient_boosting(max_iter=5, depth=3, seed=1).fit(ML.assemble(tr, V.FEATURE_COLS))
    explain = RS.sample_n(te, 20)
    bg = RS.sample_n(tr, 1)          # one background row: sum of phi == f(x) - f(z) exactly
    values = ML.sampled_shapley(ML.model_scorer(model), explain, bg, V.FEATURE_COLS, n_samples=3)
    sums = {r.id: r.s for r in values.groupBy("id").agg(F.sum("shapley_value").alias("s")).collect()}
    fx_ = {r.id: r.score for r in ML.score(model, ML.assemble(explain, V.FEATURE_COLS)).collect()}
    fz = ML.score(model, ML.assemble(bg, V.FEATURE_COLS)).first().score
    for i, s in sums.items():
        assert abs(s - (fx_[i] - fz)) < 1e-9


def test_partial_dependence_grid(spark, planted):
    tr = planted.where("split = 'train'")
    model = ML.gradient_boosting(max_iter=5, depth=3, seed=1).fit(ML.assemble(tr, V.FEATURE_COLS))
    pd_ = ML.partial_dependence(ML.model_scorer(model), RS.sample_n(tr, 500), V.FEATURE_COLS, ["doy", "month"], resolution=10)
    counts = {r.feature: r["count"] for r in pd_.groupBy("feature").count().collect()}
    assert counts["doy"] == 10 and counts["month"] == 10


def test_stopping_round_has_patience():
    falling = [1 / (i + 1) for i in range(1000)]
    assert ML.stopping_round(falling[:200], 20, 1e-4) is None
    stop = ML.stopping_round(falling, 20, 1e-4)
    assert 400 < stop < 500  # improvements by less than the tolerance over 20 rounds don't count
    assert ML.stopping_round([1.0, 0.5] + [0.6] * 10, 20, 1e-4) is None
    flat = [1.0 - 0.1 * i for i in range(5)] + [0.9] * 30
    assert ML.stopping_round(flat, 20, 1e-4) == 22  # the 20 before are no higher
    bump = [1.0, 0.9, 0.95, 0.95, 0.5, 0.4] + [0.4] * 25
    assert ML.stopping_round(bump, 20, 1e-4) > 20


def test_fewer_rounds_are_a_prefix(spark, planted):
    x = ML.assemble(planted, V.FEATURE_COLS).withColumn("weight", F.lit(1.0)).persist()
    long, short = (ML.main_gbt(rounds=r, seed=3).fit(x) for r in (6, 3))
    assert [t.toDebugString.split("\n", 1)[1] for t in long.trees][:3] == [t.toDebugString.split("\n", 1)[1] for t in short.trees]
    assert list(long.treeWeights)[:3] == list(short.treeWeights)


def test_main_model_boosts(spark):
    """The registered fit has many trees and learns the cause."""
    from __spark_entry__ import queries
    r = queries()["train_gbt"](spark, SF01).first()
    assert r.n_trees > 20 and r.roc_auc > 0.8


def test_boosted_trees_split_between_any_of_250_values(spark):
    rows = spark.range(2000).selectExpr("id", "cast(id % 250 as double) AS x")
    for least in (101, 102):  # among 64 quantiles one of the two falls within a bin
        t = ML.assemble(rows.selectExpr("id", "x", f"cast(x >= {least} as int) AS label"), ["x"])
        got = ML.gradient_boosting(max_iter=1, depth=1).fit(t).transform(t)
        assert got.where("prediction != label").count() == 0


def test_main_model_is_as_good_as_mllib(spark):
    """The same settings and as many rounds, on the same rows."""
    from ignis.plans import queries as Q
    d = Q._main_rows(spark, SF01)
    tr, te = d.where("split = 'train'"), d.where("split = 'test'")
    ours, _, _ = Q._main_fit(spark, SF01)
    rows = ML.with_validation_slice(RS.class_weights(tr, "label")).where("NOT is_validation")
    theirs = ML.main_gbt(rounds=len(ours.trees)).fit(ML._fit_rows(ML.assemble(rows, V.FEATURE_COLS).select("label", "weight", "features")).persist())
    a, b = (ML.evaluate(ML.score(m, ML.assemble(te, V.FEATURE_COLS))).first() for m in (ours, theirs))
    assert a.roc_auc > b.roc_auc - 0.005 and a.log_loss < b.log_loss + 0.02 and abs(a.accuracy - b.accuracy) < 0.02
