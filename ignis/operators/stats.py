"""Trend lines, correlation matrices and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.operators.prefix import null_safe_join


def linear_trend(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Least-squares line of each ``y`` on ``x``: n, slope, intercept, r, r2 and
    the slope's standard error (scipy ``linregress`` definitions)."""
    parts = []
    for y in ys:
        d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        xs, yv = F.col(x).cast("double"), F.col(y).cast("double")
        agg = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(yv, xs).alias("slope"),
                    F.regr_intercept(yv, xs).alias("intercept"), F.corr(xs, yv).alias("r_value"),
                    F.var_pop(xs).alias("__vx"), F.var_pop(yv).alias("__vy"))
        r = F.col("r_value")
        stderr = F.sqrt((F.lit(1.0) - r * r) * F.col("__vy") / F.col("__vx") / (F.col("n") - 2))
        parts.append(agg.select(F.lit(y).alias("target"), "n", "slope", "intercept", "r_value",
                                (r * r).alias("r2"), F.when(F.col("n") > 2, stderr).alias("stderr")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def yearly_trend(df: DataFrame, x: str, ys: Sequence[str], min_years: int = 11) -> DataFrame:
    """``linear_trend`` of the targets that at least ``min_years`` years tell about."""
    return linear_trend(df, x, ys).where(F.col("n") >= min_years)


def with_trend_p_value(trend: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the two-sided p-value of the slope (t test with n-2 degrees of
    freedom) and whether it is below ``alpha``; NULL without degrees of freedom.

    With a whole number of degrees v the Student tail is a finite sum in
    c = cos^2(atan(t / sqrt(v))): for even v, P(|T| < t) = sin * (1 + c/2 +
    c^2 (1*3)/(2*4) + ...), v/2 terms; for odd v, 2/pi * (angle + sin*cos * (1 +
    c*2/3 + c^2 (2*4)/(3*5) + ...)), (v-1)/2 terms."""
    v, r = F.col("__v"), F.col("r_value")
    t = F.abs(r) * F.sqrt(v / F.greatest((F.lit(1.0) - r) * (F.lit(1.0) + r), F.lit(1e-300)))
    d = trend.withColumn("__v", (F.col("n") - 2).cast("int")).withColumn("__angle", F.atan(t / F.sqrt(v.cast("double"))))
    odd = F.pmod(v, F.lit(2))
    cos2 = F.pow(F.cos("__angle"), F.lit(2))
    terms = F.floor((v - odd) / 2).cast("int")
    # term k is term k-1 times c * (2k - 1 + odd) / (2k + odd)
    step = lambda acc, k: F.struct(
        (acc["term"] * cos2 * (2 * k - 1 + odd) / (2 * k + odd)).alias("term"),
        (acc["total"] + acc["term"] * cos2 * (2 * k - 1 + odd) / (2 * k + odd)).alias("total"))
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.when(terms < 1, F.lit(0.0)).otherwise(
        F.aggregate(F.when(terms < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))),
                    first, step, lambda acc: acc["total"]))
    inside = F.when(odd == 1, F.lit(2 / math.pi) * (F.col("__angle") + F.sin("__angle") * F.cos("__angle") * series)) \
              .otherwise(F.sin("__angle") * series)
    p = F.when((v >= 1) & r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))
    return d.withColumn("p_value", p).withColumn("significant", F.col("p_value") < F.lit(alpha)).drop("__v", "__angle")


def correlation_long(df: DataFrame, cols: Sequence[str], listwise: bool = True) -> DataFrame:
    """Pearson correlations of all pairs in one aggregation; lower triangle
    (incl. diagonal) in long form: feature_a, feature_b, corr."""
    cols = [c for c in cols if c in df.columns]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if listwise:
        d = d.na.drop(subset=cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    one = d.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                        (F.lit(1.0) if a == b else F.col(f"`{a}__{b}`")).alias("corr"))
               for a, b in pairs]
    return one.select(F.explode(F.array(*entries)).alias("__e")).select("__e.*")


def histogram(df: DataFrame, col: str, bins: int = 50, group: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] (per group when given; a NULL group
    is a group): bin (1-based; the max value falls in the last bin), lo, hi, n,
    density = n / (N * width).  Every bin of every group is there, empty ones
    with n = 0.  The ranges are a table of one row per group that the rows are
    joined with, so the input is read twice whatever the number of groups."""
    d = df.where(F.col(col).isNotNull() & ~F.isnan(col))
    keys = [group] if group else []
    x = F.col(col).cast("double")
    ranges = d.groupBy(*keys).agg(F.min(x).alias("__a"), F.max(x).alias("__b"), F.count(F.lit(1)).alias("__tot")).where("__tot > 0")
    flat = F.col("__a") == F.col("__b")
    ranges = ranges.select(*keys, F.when(flat, F.col("__a") - 0.5).otherwise(F.col("__a")).alias("__mn"),
                           F.when(flat, F.col("__b") + 0.5).otherwise(F.col("__b")).alias("__mx"), "__tot").checkpoint(eager=True)
    placed = null_safe_join(d.select(*keys, x.alias("__x")), ranges, keys)
    share = (F.col("__x") - F.col("__mn")) / (F.col("__mx") - F.col("__mn"))
    b = (F.least(F.floor(share * bins), F.lit(bins - 1)) + 1).cast("int")
    counts = placed.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("__mx") - F.col("__mn")) / F.lit(bins)
    h = null_safe_join(spine, counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return h.select(*keys, "bin", (F.col("__mn") + (F.col("bin") - 1) * width).alias("lo"), (F.col("__mn") + F.col("bin") * width).alias("hi"),
                    F.col("n").cast("long").alias("n"), (F.col("n") / (F.col("__tot") * width)).alias("density"))
