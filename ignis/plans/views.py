"""The derived tables the reference builds step by step, as lazy DataFrames:
clean incidents -> nearest site -> weather features -> model features."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ignis.operators import clean as C
from ignis.operators.climate import attach_weather
from ignis.operators.nearest import nearest_site
from ignis.operators.tables import first_non_null
from ignis.session import scratch_path
from ignis.sources import files as FS
from ignis.sources import fixtures as fx

# The 33 model features, their groups, and the core features a
# model row must have.
FEATURE_COLS = [
    "doy", "doy_sin", "doy_cos", "month", "year", "is_weekend",
    "province_code", "latitude", "longitude",
    "log_size",
    "temp_max", "temp_min", "temp_mean", "precip", "rain", "snow_ground", "wind_gust", "diurnal_range",
    "temp_mean_7d", "temp_max_7d", "precip_total_7d", "rain_total_7d", "dry_days_7d", "temp_range_7d",
    "temp_mean_30d", "temp_max_30d", "precip_total_30d", "rain_total_30d", "dry_days_30d", "temp_range_30d",
    "temp_anomaly", "fire_weather_index", "station_dist",
]
FEATURE_GROUPS = {
    "Temporal": ["doy", "doy_sin", "doy_cos", "month", "year", "is_weekend"],
    "Geographic": ["province_code", "latitude", "longitude"],
    "Fire size": ["log_size"],
    "Climate": ["temp_max", "temp_min", "temp_mean", "precip", "rain", "snow_ground", "wind_gust", "diurnal_range",
                "temp_mean_7d", "temp_max_7d", "precip_total_7d", "rain_total_7d", "dry_days_7d", "temp_range_7d",
                "temp_mean_30d", "temp_max_30d", "precip_total_30d", "rain_total_30d", "dry_days_30d",
                "temp_range_30d", "temp_anomaly", "fire_weather_index"],
    "Station": ["station_dist"],
}
CORE_FEATURES = ["doy", "province_code", "latitude", "longitude", "log_size", "year"]
MISSING_FILL = -999.0


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_incidents(fx.incidents(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
           partition_by: Sequence[str] = (), params: object = None) -> DataFrame:
    """A derived table, built and written once per state of its input files, of
    the code and of the build's parameters, and read by every later step."""
    return FS.materialize(spark, build, stored_path(spark, sf_dir, name, params), partition_by)


def stored_path(spark: SparkSession, sf_dir: str, name: str, params: object = None) -> str:
    base = sf_dir.rstrip("/")
    inputs = FS.fingerprint(spark, [f"{base}/{t}.parquet" for t in ("orders", "customer", "nation", "supplier", "lineitem")])
    key = hashlib.sha1(repr((inputs, FS.code_version(), params)).encode()).hexdigest()[:16]
    return scratch_path(spark, f"{name}-{key}")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station table from the observations: per station name the least id and the
    first known coordinates, in file order."""
    obs = fx.daily_obs(spark, sf_dir)
    first = first_non_null(obs, "site_name", ["site_id", "site_lat", "site_lon"], ["dn", "copy_no"])
    return first.select("site_id", "site_name", "site_lat", "site_lon")


def with_nearest(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    sites = stored(spark, sf_dir, "stations", lambda: stations(spark, sf_dir))
    return nearest_site(base if base is not None else clean(spark, sf_dir), sites)


def joined(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Incidents + nearest site + day-of and 7/30-day weather, built anew; the
    incidents are read several times on the way, so they and their sites are written
    once."""
    once = lambda df, name: FS.materialize(spark, lambda: df, scratch_path(spark, f"{name}_{uuid.uuid4().hex}"))
    base = once(base if base is not None else clean(spark, sf_dir), "incidents")
    inc = C.fire_date(once(with_nearest(spark, sf_dir, base), "sited"))
    return attach_weather(inc, fx.daily_obs(spark, sf_dir), site_col="nearest_site", date_col="fire_date")


def joined_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined table with the agency code, stored by year."""
    def build():
        # the dictionary only depends on the clean incidents, so it is built before the expensive joins
        base = C.label_encode(clean(spark, sf_dir), "agency", "province_code")
        return joined(spark, sf_dir, base).withColumn("by_year", F.col("yr"))
    return stored(spark, sf_dir, "joined", build, ["by_year"]).drop("by_year")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored joined table + temporal, geographic, size and derived climate features."""
    j = C.climate_derived(joined_stored(spark, sf_dir))
    j = C.temporal_features(j, "main")
    j = C.size_features(j)
    return j.withColumn("latitude", F.col("lat")).withColumn("longitude", F.col("lon"))


def model_dataset(spark: SparkSession, sf_dir: str, fill: bool = True) -> DataFrame:
    """Rows with every core feature; other missing features filled with -999."""
    f = features(spark, sf_dir).na.drop(subset=CORE_FEATURES + ["target"])
    cols = [F.col("inc_id"), F.col("target")]
    for c in FEATURE_COLS:
        v = F.col(c).cast("double")
        cols.append((F.coalesce(v, F.lit(MISSING_FILL)) if fill else v).alias(c))
    return f.select(*cols)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scored(spark, sf_dir)

# Display names of the model features.
FEATURE_LABELS = {
    "doy_sin": "Day of Year (sin)", "doy_cos": "Day of Year (cos)", "doy": "Day of Year",
    "month": "Month", "year": "Year", "is_weekend": "Weekend",
    "province_code": "Province", "latitude": "Latitude", "longitude": "Longitude",
    "log_size": "Fire Size (log ha)", "temp_max": "Max Temp (°C)",
    "temp_min": "Min Temp (°C)", "temp_mean": "Mean Temp (°C)",
    "precip": "Precipitation (mm)", "rain": "Rainfall (mm)",
    "snow_ground": "Snow on Ground (cm)", "wind_gust": "Wind Gust (km/h)",
    "diurnal_range": "Diurnal Temp Range (°C)",
    "temp_mean_7d": "7-day Mean Temp", "temp_max_7d": "7-day Max Temp",
    "precip_total_7d": "7-day Precip Total", "rain_total_7d": "7-day Rain Total",
    "dry_days_7d": "7-day Dry Days", "temp_range_7d": "7-day Temp Range",
    "temp_mean_30d": "30-day Mean Temp", "temp_max_30d": "30-day Max Temp",
    "precip_total_30d": "30-day Precip Total", "rain_total_30d": "30-day Rain Total",
    "dry_days_30d": "30-day Dry Days", "temp_range_30d": "30-day Temp Range",
    "temp_anomaly": "Temp Anomaly (°C)", "fire_weather_index": "Fire Weather Index",
    "station_dist": "Station Distance (km)",
}

# Features of the earlier model comparison (no weather).
OLDER_FEATURES = ["month", "doy", "doy_sin", "doy_cos", "region_code", "log_size", "year"]
# Partial-dependence features.
PDP_FEATURES = ["doy_sin", "latitude", "longitude", "month"]


def older_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-cause incidents with the earlier pipeline's features (missing
    agency encoded as 'Unknown', size falling back to the computed size)."""
    d = C.cause_filtered(fx.incidents(spark, sf_dir))
    d = C.temporal_features(d, "older")
    d = C.label_encode(d, "agency", "region_code", fill="Unknown")
    d = C.size_features(d)
    d = d.select(F.col("inc_id").alias("id"), F.col("target").alias("label"),
                 F.col("mo").cast("double").alias("month"), F.col("doy").cast("double").alias("doy"),
                 "doy_sin", "doy_cos", F.col("region_code").cast("double").alias("region_code"),
                 F.col("log_size_fallback").alias("log_size"), F.col("yr").cast("double").alias("year"))
    return d.na.drop()


def main_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_dataset with id/label names for the estimators."""
    return model_dataset(spark, sf_dir).withColumnRenamed("inc_id", "id").withColumnRenamed("target", "label")


def size_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size regression rows: positive sizes, month/year/agency/cause codes -> log1p(size)."""
    d = C.size_features(fx.incidents(spark, sf_dir)).where(F.col("fire_size") > 0)
    d = C.label_encode(d, "agency", "agency_code", fill="Unknown")
    d = C.label_encode(d, "cause", "cause_code", fill="U")
    d = d.select(F.col("inc_id").alias("id"), F.col("log_size_fallback").alias("label"),
                 F.col("mo").cast("double").alias("month"), F.col("yr").cast("double").alias("year"),
                 F.col("agency_code").cast("double").alias("agency_code"),
                 F.col("cause_code").cast("double").alias("cause_code"))
    return d.na.drop()


#: A fixed ensemble over the main features (tree, node, feature, threshold, left, right, value), whose covers are
#: those of the rows it is applied to.
FIXED_TREES = [
    (0, 0, "latitude", 50.8, 1, 2, 0.0), (0, 1, "doy_sin", 0.07, 3, 4, 0.0), (0, 2, "latitude", 55.2, 5, 6, 0.0),
    (0, 3, None, 0.0, -1, -1, 0.42), (0, 4, "month", 4.0, 7, 8, 0.0), (0, 5, None, 0.0, -1, -1, -0.31), (0, 6, "longitude", -97.3, 9, 10, 0.0),
    (0, 7, None, 0.0, -1, -1, 0.11), (0, 8, None, 0.0, -1, -1, 0.27), (0, 9, None, 0.0, -1, -1, -0.64), (0, 10, None, 0.0, -1, -1, 0.08),
    (1, 0, "month", 6.0, 1, 2, 0.0), (1, 1, "log_size", 5.53, 3, 4, 0.0), (1, 2, "doy_sin", -0.66, 5, 6, 0.0), (1, 3, None, 0.0, -1, -1, 0.19),
    (1, 4, "longitude", -118.5, 7, 8, 0.0), (1, 5, None, 0.0, -1, -1, -0.23), (1, 6, None, 0.0, -1, -1, 0.36), (1, 7, None, 0.0, -1, -1, -0.15),
    (1, 8, None, 0.0, -1, -1, 0.05),
    (2, 0, "longitude", -76.0, 1, 2, 0.0), (2, 1, "longitude", -118.5, 3, 4, 0.0), (2, 2, None, 0.0, -1, -1, -0.4),
    (2, 3, None, 0.0, -1, -1, 0.21), (2, 4, "latitude", 46.4, 5, 6, 0.0), (2, 5, None, 0.0, -1, -1, 0.33), (2, 6, None, 0.0, -1, -1, -0.07)]
