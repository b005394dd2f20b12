"""Descriptive tables: value counts, cross-tabs, rates, yearly statistics.

Every group-by drops missing keys first (pandas ``groupby``/``value_counts``
semantics) and every pivot is given its values, so no extra job is run to
discover them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.operators.prefix import quantiles_wide_of_counts


def value_counts(df: DataFrame, col: str, top: int | None = None, out: str = "n") -> DataFrame:
    """Counts per non-missing value, most frequent first (ties by value)."""
    r = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    r = r.orderBy(F.col(out).desc(), F.col(col).asc())
    return r.limit(top) if top is not None else r


def crosstab(df: DataFrame, key: str, target: str = "target", labels: dict[int, str] | None = None) -> DataFrame:
    """Zero-filled counts of ``key`` x binary ``target`` (one column per class)."""
    labels = labels or {0: "natural", 1: "human"}
    counts = (df.where(F.col(key).isNotNull() & F.col(target).isNotNull())
                .groupBy(key).pivot(target, list(labels)).agg(F.count(F.lit(1))))
    return counts.select(key, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(name)
                                for v, name in labels.items()])


def row_percentages(tab: DataFrame, key: str, cols: Sequence[str] = ("natural", "human"),
                    sort_by: str | None = "human") -> DataFrame:
    """Row shares (in %) of a cross-tab."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    out = tab.select(key, *[(F.col(c) * 100.0 / total).alias(f"{c}_pct") for c in cols])
    return out.orderBy(F.col(f"{sort_by}_pct").asc(), F.col(key).asc()) if sort_by else out


def group_rate(df: DataFrame, key: str, target: str = "target", top: int | None = 3) -> DataFrame:
    """Mean of the binary target per group, highest first."""
    r = (df.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.avg(F.col(target).cast("double")).alias("human_rate"))
           .orderBy(F.col("human_rate").desc(), F.col(key).asc()))
    return r.limit(top) if top is not None else r


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Count and share per class (the total comes from a tiny grouped table)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the per-class table (one row per class), not raw rows
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(target, "n", (F.col("n") / total).alias("share"))


def class_means(df: DataFrame, target: str = "target", doy: str = "doy", log_size: str = "log_size") -> DataFrame:
    """Mean day of year and geometric-mean size (exp of mean log1p) per class."""
    return df.groupBy(target).agg(F.avg(doy).alias("mean_doy"), F.exp(F.avg(log_size)).alias("typical_size"))


def yearly_stats(df: DataFrame, year: str = "yr", size: str = "fire_size",
                 year_range: tuple[int, int] = (1980, 2024), digits: int = 1) -> DataFrame:
    """Count, total, mean, exact median and max of the size per year, rounded
    half-to-even; the total over only-missing sizes is 0."""
    # rows per (year, size): the one pass over the input; everything else reads it
    counts = (df.where(F.col(year).isNotNull()).groupBy(year, F.col(size).alias("__size"))
              .agg(F.count(F.lit(1)).alias("__c")).checkpoint(eager=True))
    present = counts.where(F.col("__size").isNotNull() & ~F.isnan("__size"))
    rows, total = F.sum(F.when(F.col("__size").isNotNull(), F.col("__c"))), F.sum(F.col("__size") * F.col("__c"))
    agg = counts.groupBy(year).agg(F.coalesce(rows, F.lit(0)).alias("num_fires"), F.coalesce(total, F.lit(0.0)).alias("total_area"),
                                   (total / rows).alias("mean_size"), F.max("__size").alias("max_size"))
    med = quantiles_wide_of_counts(present, "__size", {"median_size": 0.5}, [year])
    r = agg.join(med, year, "left").where(F.col(year).between(*year_range))
    return r.select(year, "num_fires",
                    *[F.bround(F.col(c), digits).alias(c) for c in ("total_area", "mean_size", "median_size", "max_size")])


def group_sizes(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def agency_stats(df: DataFrame, key: str = "agency", size: str = "fire_size") -> DataFrame:
    """Non-missing size count and total per agency, smallest count first."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(size).alias("n"), F.coalesce(F.sum(size), F.lit(0.0)).alias("total_area"))
              .orderBy(F.col("n").asc(), F.col(key).asc()))


def first_non_null(df: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key, each column's first non-missing value in ``order`` (a per-column
    filtered ``min_by``).  Rows that agree in all but the first of ``order`` are
    first reduced to its least value, where a missing one comes first."""
    first, *rest = order
    alike = [c for c in dict.fromkeys([key, *cols, *rest]) if c != first]
    if first not in cols and first != key:
        df = df.groupBy(*alike, F.col(first).isNull().alias("__none")).agg(F.min(first).alias(first))
    ordering = F.struct(*[F.col(c) for c in order])
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordering)).alias(c) for c in cols]))
