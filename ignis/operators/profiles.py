"""Data-quality profiles computed in a single aggregation pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ignis.operators.prefix import quantiles_wide


def _stack(one_row: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "column_name") -> DataFrame:
    """Wide one-row aggregate (``{name}__{field}``) -> one row per name."""
    entries = [F.struct(F.lit(n).alias(key), *[F.col(f"`{n}__{f}`").alias(f) for f in fields]) for n in names]
    return one_row.select(F.explode(F.array(*entries)).alias("__e")).select("__e.*")


def null_profile(df: DataFrame, top: int | None = 15, digits: int = 1) -> DataFrame:
    """Missing count and percent per column (only columns with missing values),
    most missing first."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        dtype = df.schema[c].dataType
        miss = F.col(c).isNull()
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(F.col(c))
        aggs.append(F.count_if(miss).alias(f"{c}__missing"))
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}__missing`").alias("missing")) for c in cols]
    long = one.select("__rows", F.explode(F.array(*entries)).alias("__e")).select("__rows", "__e.*")
    out = (long.where(F.col("missing") > 0)
               .select("column_name", "missing", F.bround(F.col("missing") * 100.0 / F.col("__rows"), digits).alias("percent"))
               .orderBy(F.col("percent").desc(), F.col("column_name").asc()))
    return out.limit(top) if top is not None else out


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-missing count and percent per listed column (absent columns skipped)."""
    cols = [c for c in cols if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(c)).alias(f"{c}__non_null") for c in cols]
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"`{c}__non_null`").alias("non_null"))
               for i, c in enumerate(cols)]
    long = one.select("__rows", F.explode(F.array(*entries)).alias("__e")).select("__rows", "__e.*")
    return long.select("position", "feature", "non_null",
                       F.when(F.col("__rows") > 0, F.col("non_null") * 100.0 / F.col("__rows")).alias("pct"))


def numeric_profile(df: DataFrame, limit_cols: int | None = 10) -> DataFrame:
    """Non-missing count and mean of the first numeric columns (schema order);
    columns without any value are left out."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if limit_cols is not None:
        num = num[:limit_cols]
    aggs = []
    for c in num:
        aggs += [F.count(F.col(c)).alias(f"{c}__non_null"), F.avg(F.col(c).cast("double")).alias(f"{c}__mean")]
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                        F.col(f"`{c}__non_null`").alias("non_null"), F.col(f"`{c}__mean`").alias("mean"))
               for i, c in enumerate(num)]
    long = one.select(F.explode(F.array(*entries)).alias("__e")).select("__e.*")
    return long.where(F.col("non_null") > 0)


def describe_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, min, max, mean, exact median and sample std over the positive values
    of each column (one aggregate pass + one distributed median per column)."""
    cols = [c for c in cols if c in df.columns]
    parts = []
    for c in cols:
        pos = df.select(F.col(c).cast("double").alias("v")).where(F.col("v") > 0)
        stats = pos.agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
                        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
        med = quantiles_wide(pos, "v", {"median": 0.5})
        from ignis.operators.metrics import combine_rows
        one = combine_rows(stats, med).withColumn("column_name", F.lit(c))
        parts.append(one.select("column_name", "n", "min", "max", "mean", "median", "std"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column_name string, n bigint, min double, max double, mean double, median double, std double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
