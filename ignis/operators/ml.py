"""Model training, scoring and explanation on ``pyspark.ml``.

Fits run as MLlib jobs over the partitioned training rows; evaluation reuses
the exact metric operators of ``ignis.operators.metrics``.  Explanations
(partial dependence, sampled Shapley values) expand the explained rows inside
tasks and score the expansion with one distributed ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.functions.hashing import with_mix, with_replicate_mix
from ignis.operators import metrics as M
from ignis.operators.boosting import MAIN, Boosted, Boosting, Settings
from ignis.operators.prefix import plotting_quantiles
from ignis.operators.resample import class_weights, sample_n, stratified_folds

FEATURES = "features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Feature vector column (inputs must already be non-missing)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Scale with the training mean and *population* std (one aggregate on the
    training rows); applies the same expression to every other frame."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()

    def scale(d: DataFrame) -> DataFrame:
        out = d
        for c in cols:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0))
        return out
    return [scale(train)] + [scale(d) for d in others]


def logistic_regression(n_train: int, max_iter: int = 1000, c: float = 1.0, weight: str | None = None) -> LogisticRegression:
    """L2 logistic regression equivalent to C=1 on the summed loss: Spark
    minimises the mean loss, so regParam = 1 / (C * n_train)."""
    lr = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0,
                            standardization=False, featuresCol=FEATURES, labelCol="label")
    if weight:
        lr.setWeightCol(weight)
    return lr


#: Deepest trees that MLlib grows; the closest to trees without a limit.
MAX_DEPTH = 30
MAX_BINS = 256


def random_forest(n_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 42) -> RandomForestClassifier:
    """A forest of trees grown as deep as MLlib allows."""
    return RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, seed=seed, featuresCol=FEATURES,
                                  labelCol="label", maxBins=MAX_BINS, maxMemoryInMB=2048, cacheNodeIds=True,
                                  checkpointInterval=10)


def gradient_boosting(max_iter: int = 100, step: float = 0.1, depth: int = 3, min_leaf: int = 1,
                      subsample: float = 1.0, feature_subset: str = "all", seed: int = 42,
                      weight: str | None = None) -> GBTClassifier:
    g = GBTClassifier(maxIter=max_iter, stepSize=step, maxDepth=depth, minInstancesPerNode=min_leaf,
                      subsamplingRate=subsample, featureSubsetStrategy=feature_subset, seed=seed,
                      featuresCol=FEATURES, labelCol="label", maxBins=MAX_BINS, cacheNodeIds=True, checkpointInterval=10)
    if weight:
        g.setWeightCol(weight)
    return g


#: The main model stops once PATIENCE rounds on end have not improved the validation loss by TOLERANCE.
MAIN_ROUNDS, PATIENCE, TOLERANCE = 500, 20, 1e-4
FIRST_ROUNDS = 125


def main_gbt(weight: str | None = "weight", seed: int = 42, rounds: int = MAIN_ROUNDS) -> GBTClassifier:
    """The main configuration: 500 trees at most, rate 0.05, depth 5, leaf >= 20,
    80% row subsampling, sqrt(p) features per split, class weights."""
    return gradient_boosting(max_iter=rounds, step=0.05, depth=5, min_leaf=20, subsample=0.8, feature_subset="sqrt",
                             seed=seed, weight=weight)


def stopping_round(losses: Sequence[float], patience: int = PATIENCE, tol: float = TOLERANCE) -> int | None:
    """Rounds to keep: the first whose loss is within ``tol`` of, or above, the
    loss of each of the ``patience`` rounds before it; None if there is none yet."""
    for i in range(patience, len(losses)):
        if all(losses[i] + tol >= earlier for earlier in losses[i - patience:i]):
            return i + 1
    return None


def boost_until_stopped(train: DataFrame, validation: DataFrame, make: Callable[[int], GBTClassifier],
                        max_rounds: int = MAIN_ROUNDS, patience: int = PATIENCE, tol: float = TOLERANCE) -> Model:
    """Boosting with early stopping by patience.  Rounds don't depend on how many
    follow (the seed of a tree is the seed plus its round), so the fit is done
    with FIRST_ROUNDS, twice that ... rounds until the validation losses show the
    stop, and then once more with just the rounds to keep."""
    rounds = min(FIRST_ROUNDS, max_rounds)
    while True:
        model = make(rounds).fit(train)
        stop = stopping_round(model.evaluateEachIteration(validation), patience, tol)
        if stop is not None:
            return model if stop == rounds else make(stop).fit(train)
        if rounds == max_rounds:
            return model
        rounds = min(2 * rounds, max_rounds)


def score(model: Model, df: DataFrame, id_col: str = "id") -> DataFrame:
    """id, label, score = P(class 1), pred = score >= 0.5 (or the prediction)."""
    t = model.transform(df)
    if "probability" in t.columns:
        p = vector_to_array(F.col("probability"))[1]
        return t.select(id_col, "label", p.alias("score"), (p >= 0.5).cast("int").alias("pred"))
    return t.select(id_col, "label", F.col("prediction").alias("score"), F.col("prediction").cast("int").alias("pred"))


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: counts, accuracy/precision/recall/F1/specificity/MCC, ROC-AUC,
    average precision, Brier score and log loss."""
    cm = M.metrics_from_counts(M.confusion_counts(scored))
    rk = M.ranking_metrics(M.score_counts(scored)).select("roc_auc", "average_precision")
    return M.combine_rows(cm, rk, M.prob_losses(scored))


def with_validation_slice(train: DataFrame, id_col: str = "id", frac: float = 0.1, seed: int = 7) -> DataFrame:
    from ignis.functions.hashing import RANGE, mix_col
    return train.withColumn("is_validation", mix_col(id_col, seed) < F.lit(int(frac * RANGE)))


#: Rows that a partition of training rows should hold at least: boosting runs several jobs a tree.
ROWS_PER_FIT_PARTITION = 20_000


def _fit_rows(df: DataFrame) -> DataFrame:
    """Training rows in no more partitions than their number is worth."""
    n = df.count()
    return df.coalesce(max(1, -(-n // ROWS_PER_FIT_PARTITION)))


def fit_main_gbt(train: DataFrame, feature_cols: Sequence[str], id_col: str = "id", seed: int = 42,
                 make: Callable[[int], GBTClassifier] | None = None, weighted: bool = True,
                 max_rounds: int = MAIN_ROUNDS) -> Model | Boosted:
    """GBT with early stopping on a 10% validation slice (the main model), grown
    by ``boosting`` round by round; ``make`` fits MLlib's trees instead."""
    t = class_weights(train, "label") if weighted else train.withColumn("weight", F.lit(1.0))
    t = with_validation_slice(t, id_col)
    if make is None:
        rows = boosting_rows(t, feature_cols, id_col)
        return fit_boosted(rows, feature_cols, replace(MAIN, rounds=max_rounds, seed=seed))[0]
    t = assemble(t, feature_cols).select(id_col, "label", "weight", "is_validation", FEATURES).persist()
    try:
        fit, held = (_fit_rows(t.where(F.col("is_validation") == v)).persist() for v in (False, True))
        try:
            return boost_until_stopped(fit, held, make, max_rounds)
        finally:
            fit.unpersist()
            held.unpersist()
    finally:
        t.unpersist()


def boosting_rows(df: DataFrame, feature_cols: Sequence[str], id_col: str = "id", fold: str | None = None) -> DataFrame:
    """Rows as ``boosting`` takes them, stored: held back where ``is_validation``,
    left out by the ensemble that ``fold`` names."""
    out = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = df.select(*feature_cols, F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"),
                     F.xxhash64(id_col).alias("key"), out.alias("out"), F.col("is_validation").alias("held")).checkpoint(eager=True)
    n = rows.count()
    return rows.coalesce(max(1, -(-n // ROWS_PER_FIT_PARTITION)))


def fit_boosted(rows: DataFrame, feature_cols: Sequence[str], settings: Settings = MAIN, count: int = 1) -> list[Boosted]:
    """``count`` ensembles over the rows, each grown until it stops."""
    run = Boosting(rows, feature_cols, settings, count)
    try:
        return run.grow().models()
    finally:
        run.close()


def cross_validate_boosted(df: DataFrame, feature_cols: Sequence[str], settings: Settings = MAIN, k: int = 5, id_col: str = "id",
                           seed: int = 42) -> DataFrame:
    """Stratified k-fold CV of the main model without class weights: the k
    ensembles grow in the same passes over the rows, each without its own fold and
    with its own early stopping."""
    data = with_validation_slice(stratified_folds(df, "label", id_col, k, seed).withColumn("weight", F.lit(1.0)), id_col)
    run = Boosting(boosting_rows(data, feature_cols, id_col, "fold"), feature_cols, settings, k)
    try:
        return fold_summary(fold_metrics(run.grow().left_out())).checkpoint(eager=True)
    finally:
        run.close()


FOLD_METRICS = ("roc_auc", "average_precision", "f1", "accuracy")


def fold_metrics(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """ROC-AUC, average precision, F1 and accuracy of each fold's scored rows, all
    folds in one pass."""
    scored = scored.select(fold, "label", "score", "pred").checkpoint(eager=True)
    rank = M.ranking_metrics(M.score_counts(scored, group_cols=[fold]), [fold]).select(fold, "roc_auc", "average_precision")
    y, p = F.col("label"), F.col("pred")
    cells = {"tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tp": (y == 1) & (p == 1)}
    cm = M.metrics_from_counts(scored.groupBy(fold).agg(*[F.count_if(c).alias(n) for n, c in cells.items()]))
    return rank.join(cm.select(fold, "f1", "accuracy"), fold)


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean, population std, min and max of each metric over the folds."""
    long = per_fold.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                               for m in FOLD_METRICS])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.min("value").alias("min"), F.max("value").alias("max"))


def cross_validate(df: DataFrame, feature_cols: Sequence[str], fit: Callable[[DataFrame], Model], k: int = 5,
                   id_col: str = "id", seed: int = 42) -> DataFrame:
    """Stratified k-fold CV over all rows: ``fit`` is given each fold's training
    rows; the metrics of the folds are summarised.  The k fits run one after
    another, each on the whole cluster."""
    data = stratified_folds(df, "label", id_col, k, seed).checkpoint(eager=True)
    allf = None
    for f in range(k):
        model = fit(data.where(F.col("fold") != f))
        part = score(model, assemble(data.where(F.col("fold") == f), feature_cols), id_col).withColumn("fold", F.lit(f))
        allf = part if allf is None else allf.unionByName(part)
    return fold_summary(fold_metrics(allf))


def standardized_table(train: DataFrame, cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """The training rows scaled by their own mean and population std."""
    return standardize(train, [], cols)[0].select(id_col, *cols)


def importance_table(spark, feature_cols: Sequence[str], importances, labels: dict[str, str] | None = None) -> DataFrame:
    """Impurity importances, most important first, with running total and rank."""
    rows = [(i, c, float(importances[i]), (labels or {}).get(c, c)) for i, c in enumerate(feature_cols)]
    df = spark.createDataFrame(rows, "position int, feature string, importance double, display_name string")
    w = Window.orderBy(F.col("importance").desc(), F.col("position").asc())
    return df.select("feature", "display_name", "importance",
                     F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
                     F.row_number().over(w).alias("rank"))


def grouped_importance(importance: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Sum of importances per feature group (a broadcast dictionary join)."""
    spark = importance.sparkSession
    pairs = [(g, f) for g, fs in groups.items() for f in fs]
    gmap = spark.createDataFrame(pairs, "feature_group string, feature string")
    j = F.broadcast(gmap).join(importance.select("feature", "importance"), "feature", "left")
    return (j.groupBy("feature_group").agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("importance"))
              .withColumn("share_pct", F.col("importance") * 100.0))


#: Scores a frame with a feature array ``__v``: adds ``__p``, the probability of class 1.
Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(model: Model) -> Scorer:
    def run(df: DataFrame) -> DataFrame:
        t = model.transform(df.withColumn(FEATURES, array_to_vector("__v")))
        return t.withColumn("__p", vector_to_array(F.col("probability"))[1]).select(*df.columns, "__p")
    return run


def logistic_scorer(weights: Sequence[float], bias: float) -> Scorer:
    """A fixed logistic score, for a function whose explanations are known."""
    def run(df: DataFrame) -> DataFrame:
        z = F.lit(float(bias))
        for i, w in enumerate(weights):
            z = z + F.lit(float(w)) * F.get("__v", F.lit(i))
        return df.withColumn("__p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return run


def grid_values(sample: DataFrame, col: str, resolution: int, percentiles=(0.05, 0.95)) -> list[float]:
    """Grid values of one feature: its distinct values when there are fewer
    than ``resolution``, else ``resolution`` points between two quantiles (at
    plotting positions)."""
    distinct = sample.select(col).distinct().limit(resolution).collect()
    if len(distinct) < resolution:
        return sorted(float(r[0]) for r in distinct)
    q = {r["p"]: r["q"] for r in plotting_quantiles(sample, col, percentiles).collect()}
    lo, hi = (float(q[p]) for p in percentiles)
    return [lo + (hi - lo) * i / (resolution - 1) for i in range(resolution)]


def partial_dependence(scorer: Scorer, sample: DataFrame, feature_cols: Sequence[str], features: Sequence[str],
                       resolution: int = 50) -> DataFrame:
    """Average predicted probability, and average log odds, when one feature is
    set to each grid value for every sampled row.  All (feature, grid value)
    pairs are expanded in one pass inside the tasks and scored at once."""
    pairs = [(f, float(v)) for f in features for v in grid_values(sample, f, resolution)]
    grid = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("grid_value")) for f, v in pairs])
    x = sample.select(*feature_cols).withColumn("__g", F.explode(grid)).select("*", "__g.*").drop("__g")
    v = F.array(*[F.when(F.col("feature") == c, F.col("grid_value")).otherwise(F.col(c).cast("double"))
                  if c in features else F.col(c).cast("double") for c in feature_cols])
    t = scorer(x.select("feature", "grid_value", v.alias("__v")))
    p = F.least(F.greatest("__p", F.lit(1e-15)), F.lit(1 - 1e-15))
    return t.groupBy("feature", "grid_value").agg(F.avg("__p").alias("average_probability"),
                                                  F.avg(F.log(p / (F.lit(1.0) - p))).alias("average_log_odds"))


def sampled_shapley(scorer: Scorer, explain: DataFrame, background: DataFrame, feature_cols: Sequence[str],
                    id_col: str = "id", n_samples: int = 10, seed: int = 42) -> DataFrame:
    """Sampled Shapley values (Strumbelj & Kononenko, 2014) for every row of
    ``explain``: for each sample a random feature order and a background row;
    phi_j = mean over samples of f(x with j and its predecessors) - f(same
    without j).  Each order is scored once per prefix, and neighbouring
    prefixes share a score.  Output per (id, feature): shapley_value.  The
    background table is broadcast; its size is fixed by the caller (a sample of
    n rows).  Orders and background rows come from the replayable hash."""
    p = len(feature_cols)
    bg = background.select(*feature_cols)
    bg = bg.withColumn("__bg", F.row_number().over(Window.orderBy(*feature_cols)) - 1)
    n_bg = bg.count()
    bg = F.broadcast(bg.select("__bg", F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("__z")))
    x = explain.select(id_col, F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("__x"))
    x = x.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    x = with_mix(x, "__h", id_col, F.col("__s") + F.lit(seed))
    x = x.withColumn("__bg", F.pmod(F.col("__h"), F.lit(n_bg)).cast("int")).join(bg, "__bg")
    for j in range(p):
        x = with_replicate_mix(x.withColumn("__j", F.lit(j)), f"__o{j}", "__h", "__j")
    order = F.array_sort(F.array(*[F.struct(F.col(f"__o{j}").alias("o"), F.lit(j).alias("j")) for j in range(p)]))
    x = x.select(id_col, "__s", "__x", "__z", F.transform(order, lambda e: e["j"]).alias("__order"))
    x = x.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(p))))  # how many features come from x
    ks = F.array(*[F.lit(j) for j in range(p)])
    v = F.transform(ks, lambda j: F.when(F.array_position("__order", j) <= F.col("__k"), F.get("__x", j)).otherwise(F.get("__z", j)))
    t = scorer(x.select(id_col, "__k", "__order", v.alias("__v")))
    ends = F.array(F.struct(F.get("__order", F.col("__k") - 1).alias("j"), F.col("__p").alias("v")),
                   F.struct(F.get("__order", F.col("__k")).alias("j"), (-F.col("__p")).alias("v")))
    names = F.array(*[F.lit(c) for c in feature_cols])
    return (t.select(id_col, F.explode(ends).alias("e")).where(F.col("e.j").isNotNull())
             .groupBy(id_col, F.col("e.j").alias("__j")).agg((F.sum("e.v") / F.lit(n_samples)).alias("shapley_value"))
             .select(id_col, F.get(names, F.col("__j")).alias("feature"), "shapley_value"))


def shapley_summary(values: DataFrame) -> DataFrame:
    """Features ranked by mean |Shapley value| (the ordering of an attribution summary plot)."""
    s = values.groupBy("feature").agg(F.avg(F.abs("shapley_value")).alias("mean_abs_shapley"),
                                    F.avg("shapley_value").alias("mean_shapley"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_shapley").desc(), F.col("feature"))))



def regression_forest(n_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, seed=seed, featuresCol=FEATURES,
                                 labelCol="label", maxBins=MAX_BINS, maxMemoryInMB=2048, cacheNodeIds=True,
                                 checkpointInterval=10)
