"""Incident cleaning and feature columns (one narrow projection each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.functions.columns import clip_lower, lenient_double, lenient_int
from ignis.functions.dates import day_of_week, day_of_year, doy_cos, doy_sin, safe_date, weekend_flag

# Cause codes of the incident data.
KNOWN_CAUSES = ("N", "H", "H-PB")
NATURAL_CAUSE = "N"
UNKNOWN_CAUSE = "U"

# Raw (landed) incident column names -> clean snake_case names.
RAW_INCIDENT_COLUMNS = {
    "FIRE_ID": "inc_id", "YEAR": "yr", "MONTH": "mo", "DAY": "dy", "CAUSE": "cause",
    "SRC_AGENCY": "agency", "LATITUDE": "lat", "LONGITUDE": "lon",
    "SIZE_HA": "size_ha", "CALC_HA": "calc_ha",
}
_INT_COLS = ("yr", "mo", "dy")
_DOUBLE_COLS = ("lat", "lon", "size_ha", "calc_ha")


def standardize_incidents(raw: DataFrame) -> DataFrame:
    """Rename landed columns to snake_case and coerce leniently (bad text -> NULL).
    Columns that are absent are tolerated and simply not produced."""
    dtypes = {f.name: f.dataType for f in raw.schema.fields}
    out = []
    for src, dst in RAW_INCIDENT_COLUMNS.items():
        name = src if src in dtypes else (dst if dst in dtypes else None)
        if name is None:
            continue
        if dst in _INT_COLS:
            out.append(lenient_int(name, dtypes[name]).alias(dst))
        elif dst in _DOUBLE_COLS:
            out.append(lenient_double(name, dtypes[name]).alias(dst))
        elif dst == "inc_id":
            out.append(F.col(name).cast("long").alias(dst))
        else:
            out.append(F.col(name).cast("string").alias(dst))
    return raw.select(*out)


def binary_target(cause_col: str = "cause") -> F.Column:
    """0 = natural, 1 = human (any known non-natural code)."""
    return F.when(F.col(cause_col) == NATURAL_CAUSE, 0).otherwise(1)


def clean_incidents(df: DataFrame, causes: Sequence[str] = KNOWN_CAUSES,
                    year_range: tuple[int, int] = (1972, 2024), require_coords: bool = True,
                    month_range: tuple[int, int] | None = (1, 12)) -> DataFrame:
    """Known-cause incidents with a plausible year, coordinates and month, plus
    the binary ``target``.  A conjunction of pushed-down predicates."""
    cond = F.col("cause").isin(list(causes)) & F.col("yr").between(*year_range)
    if require_coords:
        cond &= F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if month_range is not None:
        cond &= F.col("mo").between(*month_range)
    return df.where(cond).withColumn("target", binary_target())


def cause_filtered(df: DataFrame, causes: Sequence[str] = KNOWN_CAUSES) -> DataFrame:
    """Known-cause filter only (older pipeline) with ``target``."""
    return df.where(F.col("cause").isin(list(causes))).withColumn("target", binary_target())


def size_features(df: DataFrame) -> DataFrame:
    """Size columns: ``fire_size`` = size else computed size; ``log_size`` =
    log1p of the size clipped at 0 (NULL stays NULL); ``log_size_fallback`` =
    log1p of ``fire_size``; ``log10_size`` for positive sizes."""
    fire_size = F.coalesce(F.col("size_ha"), F.col("calc_ha"))
    return df.select(
        "*",
        fire_size.alias("fire_size"),
        F.log1p(clip_lower("size_ha", 0.0)).alias("log_size"),
        F.log1p(fire_size).alias("log_size_fallback"),
        F.when(fire_size > 0, F.log10(fire_size)).alias("log10_size"),
    )


def temporal_features(df: DataFrame, variant: str = "main") -> DataFrame:
    """Calendar features.

    ``main``: doy on the leap-2000 calendar (bad date -> NULL), cyclic
    encodings over 365, weekday (0 = Monday) of the real date and a weekend flag
    where a missing weekday counts as 0.
    ``older``: doy needs year and 1<=month<=12, 1<=day<=31; weekday needs a
    year in 1900..2030; a missing weekday keeps the flag missing; decade.
    ``exploratory``: doy on the real calendar with fallbacks to 1.
    """
    y, m, d = F.col("yr"), F.col("mo"), F.col("dy")
    if variant == "main":
        doy = day_of_year(y, m, d, calendar="leap2000")
        dow = day_of_week(y, m, d)
        return (df.withColumn("doy", doy)
                  .withColumn("doy_sin", doy_sin("doy")).withColumn("doy_cos", doy_cos("doy"))
                  .withColumn("dow", dow)
                  .withColumn("is_weekend", weekend_flag("dow", missing_as_zero=True))
                  .withColumn("month", m).withColumn("year", y))
    if variant == "older":
        doy = day_of_year(y, m, d, calendar="leap2000", on_bad="strict_parts")
        dow = day_of_week(y, m, d, year_range=(1900, 2030))
        return (df.withColumn("doy", doy)
                  .withColumn("doy_sin", doy_sin("doy")).withColumn("doy_cos", doy_cos("doy"))
                  .withColumn("dow", dow)
                  .withColumn("is_weekend", weekend_flag("dow", missing_as_zero=False))
                  .withColumn("decade", (F.floor(y / 10) * 10).cast("int")))
    if variant == "exploratory":
        return df.withColumn("doy", day_of_year(y, m, d, calendar="actual", on_bad="fallback"))
    raise ValueError(f"unknown variant {variant!r}")


def fire_date(df: DataFrame) -> DataFrame:
    return df.withColumn("fire_date", safe_date("yr", "mo", "dy"))


def label_encode(df: DataFrame, col: str, out: str, fill: str | None = None) -> DataFrame:
    """Dense alphabetical index of ``col`` (0-based) joined back by value.

    ``fill=None`` keeps a missing value missing; otherwise missing values are
    first replaced by ``fill`` and encoded like any other value.  The dictionary
    of distinct values is stored and ranked once; whether it is broadcast or
    shuffled is decided by its measured size at run time.
    """
    src = F.coalesce(F.col(col), F.lit(fill)) if fill is not None else F.col(col)
    keyed = df.withColumn("__enc_key", src)
    dictionary = keyed.select("__enc_key").where(F.col("__enc_key").isNotNull()).distinct()
    from ignis.operators.prefix import dense_rank_values
    codes = dense_rank_values(dictionary, "__enc_key", out).checkpoint(eager=True)
    known = keyed.where(F.col("__enc_key").isNotNull()).join(codes, "__enc_key").select(*df.columns, out)
    if fill is not None:
        return known
    # rows without a value take no part in the join, where they would all meet in one task
    return known.unionByName(df.where(F.col(col).isNull()).withColumn(out, F.lit(None).cast(codes.schema[out].dataType)))


def climate_derived(df: DataFrame) -> DataFrame:
    """Day-of diurnal range, anomaly against the 30-day mean, and the fire-weather
    index (missing inputs count as 0, so the index is never missing)."""
    return df.select(
        "*",
        (F.col("temp_max") - F.col("temp_min")).alias("diurnal_range"),
        (F.col("temp_mean") - F.col("temp_mean_30d")).alias("temp_anomaly"),
        (F.coalesce(F.col("temp_max"), F.lit(0.0))
         - F.coalesce(F.col("precip"), F.lit(0.0)) * 2
         + F.coalesce(F.col("wind_gust"), F.lit(0.0)) * 0.5).alias("fire_weather_index"),
        F.col("station_dist_km").alias("station_dist"),
    )


def has_columns(df: DataFrame, cols: Sequence[str]) -> bool:
    return all(c in df.columns for c in cols)

