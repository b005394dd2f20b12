"""Classification and regression metrics as aggregations.

Ranking metrics collapse the scored rows to one row per distinct score (a
partial aggregate), then take two-level running sums in descending score
order (``ignis.operators.prefix``).  Ties are handled exactly: ROC-AUC counts
a tied positive/negative pair as 1/2, average precision is the step sum over
distinct thresholds (not the trapezoid).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ignis.functions.columns import safe_ratio
from ignis.operators.prefix import bounds_of, following, prefix_sums

# The 9 inner edges of 10 uniform calibration bins, computed the
# way numpy's linspace does (k * 0.1), so boundary scores land in the same bin.
CALIBRATION_EDGES = [k * 0.1 for k in range(1, 10)]


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Side-by-side combination of one-row results without a join: union by
    name (missing columns NULL) and take each column's single non-NULL value."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in u.columns])


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred", weight: str | None = None,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1)
    y, p = F.col(label), F.col(pred)

    def cnt(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w).otherwise(0)), F.lit(0))
    out = df.groupBy(*group_cols).agg(cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
                                      cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp"))
    if weight is None:
        out = out.select(*group_cols, *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])
    return out


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and MCC of the positive
    class from tn/fp/fn/tp columns (ratios with a zero denominator are 0)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec = safe_ratio(tp, tp + fp)
    rec = safe_ratio(tp, tp + fn)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*",
        safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        safe_ratio(2 * prec * rec, prec + rec).alias("f1"),
        safe_ratio(tn, tn + fp).alias("specificity"),
        safe_ratio(tp * tn - fp * fn, den).alias("mcc"),
    )


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return metrics_from_counts(confusion_counts(df, label, pred))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred",
                 names: Sequence[str] = ("Natural", "Human")) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    p0, r0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    f1 = safe_ratio(2 * p1 * r1, p1 + r1)
    f0 = safe_ratio(2 * p0 * r0, p0 + r0)
    s0, s1 = tn + fp, tp + fn
    tot = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_name"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))
    nul = F.lit(None).cast("double")
    rows = [row(names[0], p0, r0, f0, s0), row(names[1], p1, r1, f1, s1),
            row("accuracy", nul, nul, safe_ratio(tp + tn, tot), tot),
            row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
            row("weighted avg", safe_ratio(p0 * s0 + p1 * s1, tot), safe_ratio(r0 * s0 + r1 * s1, tot),
                safe_ratio(f0 * s0 + f1 * s1, tot), tot)]
    return c.select(F.explode(F.array(*rows)).alias("__r")).select("__r.*")


def prob_losses(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-15) -> DataFrame:
    """Brier score and log loss (probabilities clipped to [eps, 1-eps])."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg((p - y) * (p - y)).alias("brier"),
                  (-F.avg(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("log_loss"))


def score_counts(df: DataFrame, label: str = "label", score: str = "score", weight: str | None = None,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """(group, score) -> pos, neg  (weighted if ``weight``): a partial aggregate,
    checkpointed, so that curves and totals read the distinct scores and the
    input is scanned once."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label)
    return (df.where(F.col(score).isNotNull())
              .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
              .agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"),
                   F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg"))
              .checkpoint(eager=True))


def ranking_sums(counts: DataFrame, group_cols: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Descending running totals tp (cum_pos) and fp (cum_neg) per distinct score."""
    return prefix_sums(counts, "score", ["pos", "neg"], group_cols, descending=True, n_blocks=n_blocks, stored=True)


def ranking_metrics(counts: DataFrame, group_cols: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """ROC-AUC (ties = 1/2) and average precision per group, one pass over the
    distinct scores."""
    r = ranking_sums(counts, group_cols, n_blocks)
    pos, neg, cpos, cneg = F.col("pos"), F.col("neg"), F.col("cum_pos"), F.col("cum_neg")
    agg = r.groupBy(*group_cols).agg(
        F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"),
        F.sum(pos * cneg - 0.5 * pos * neg).alias("__disc"),
        F.sum(F.when(cpos + cneg > 0, pos * cpos / (cpos + cneg)).otherwise(0.0)).alias("__ap"))
    P, N = F.col("n_pos"), F.col("n_neg")
    return agg.select(*group_cols, "n_pos", "n_neg",
                      F.when((P > 0) & (N > 0), F.lit(1.0) - F.col("__disc") / (P * N)).alias("roc_auc"),
                      F.when(P > 0, F.col("__ap") / P).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(score_counts(df, label, score)).select("roc_auc")


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(score_counts(df, label, score)).select("average_precision")


def _totals(counts: DataFrame) -> tuple[float, float]:
    row = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return float(row["p"] or 0.0), float(row["n"] or 0.0)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", drop_intermediate: bool = True) -> DataFrame:
    """ROC points (score >= threshold is positive), from the origin, whose threshold
    is infinite, to (1, 1); ``drop_intermediate`` leaves out thresholds that lie
    between two others on a line: those whose next threshold adds just as many
    positives and negatives.  No scored rows, no points."""
    c = score_counts(df, label, score)
    P, N = _totals(c)
    bounds = bounds_of(c, "score")
    r = prefix_sums(c, "score", ["pos", "neg"], descending=True, bounds=bounds, stored=True)
    if drop_intermediate:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        r = following(r, "score", ["pos", "neg"], descending=True, bounds=bounds, source=c)
        r = r.where(first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    share = lambda v, total: F.col(v) / F.lit(total) if total else F.lit(None).cast("double")
    points = r.select(F.col("score").alias("threshold"), share("cum_neg", N).alias("fpr"), share("cum_pos", P).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0 if N else None, 0.0 if P else None)] if P + N else [],
                                             "threshold double, fpr double, tpr double")
    return origin.unionByName(points)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall per distinct score threshold, and the closing point
    (precision 1, recall 0), which has no threshold.  No scored rows, no points."""
    c = score_counts(df, label, score)
    P, N = _totals(c)
    r = ranking_sums(c)
    points = r.select(F.col("score").alias("threshold"),
                      (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                      (F.col("cum_pos") / F.lit(P) if P else F.lit(None).cast("double")).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)] if P + N else [], "threshold double, precision double, recall double")
    return points.unionByName(end)


def _edge_bin(x: Column, edges: list[float], lo: int = 0, hi: int | None = None) -> Column:
    """Number of edges strictly below x (searchsorted, side='left')."""
    if hi is None:
        hi = len(edges)
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x > F.lit(edges[mid]), _edge_bin(x, edges, mid + 1, hi)).otherwise(_edge_bin(x, edges, lo, mid))


def calibration(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """10 uniform bins: mean predicted probability vs fraction of positives;
    empty bins are absent; a boundary value belongs to the lower bin."""
    b = _edge_bin(F.col(score), CALIBRATION_EDGES)
    return (df.where(F.col(score).isNotNull()).groupBy(b.alias("bin"))
              .agg(F.avg(F.col(score).cast("double")).alias("mean_predicted"),
                   F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                   F.count(F.lit(1)).alias("n")))


def baseline_lift(df: DataFrame, label: str = "label", score: str = "score", pred: str = "pred") -> DataFrame:
    """Majority-class accuracy, prevalence (random PR-AUC), 0.5 random ROC-AUC and
    the model's absolute / relative lift over each."""
    df = df.select(label, score, pred).checkpoint(eager=True)  # read by the counts and by the ranking
    cm = metrics_from_counts(confusion_counts(df, label, pred)).select(
        "accuracy", ((F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp"))).alias("prevalence"))
    rk = ranking_metrics(score_counts(df, label, score)).select("roc_auc", "average_precision")
    j = combine_rows(cm, rk)
    maj = F.greatest(F.col("prevalence"), 1 - F.col("prevalence"))
    return j.select(
        maj.alias("majority_accuracy"), "prevalence", "accuracy", "roc_auc", "average_precision",
        (F.col("accuracy") - maj).alias("accuracy_lift"), ((F.col("accuracy") - maj) / maj).alias("accuracy_lift_rel"),
        (F.col("average_precision") - F.col("prevalence")).alias("pr_auc_lift"),
        ((F.col("average_precision") - F.col("prevalence")) / F.col("prevalence")).alias("pr_auc_lift_rel"),
        (F.col("roc_auc") - 0.5).alias("roc_auc_lift"), ((F.col("roc_auc") - 0.5) / 0.5).alias("roc_auc_lift_rel"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MSE, RMSE, R^2 and the RMSE after ``expm1`` (original units)."""
    t, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    d = df.where(t.isNotNull() & p.isNotNull())
    agg = d.agg(F.avg((t - p) * (t - p)).alias("mse"), F.var_pop(t).alias("__vt"),
                F.avg((F.expm1(t) - F.expm1(p)) * (F.expm1(t) - F.expm1(p))).alias("__mse_orig"),
                F.count(F.lit(1)).alias("n"))
    return agg.select("n", "mse", F.sqrt("mse").alias("rmse"),
                      F.when(F.col("__vt") > 0, 1 - F.col("mse") / F.col("__vt")).alias("r2"),
                      F.sqrt("__mse_orig").alias("rmse_original_units"))
