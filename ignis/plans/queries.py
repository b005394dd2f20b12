"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs over the whole driver tables (through the fixture views of
``ignis.sources.fixtures``).  Doubles are rounded to 6 decimals at this
boundary only, so the DuckDB oracle comparison is not at the mercy of the last
floating-point bit; the operators themselves return full precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ignis.functions.dates import day_of_week, day_of_year, weekend_flag
from ignis.operators import boosting as BO
from ignis.operators import clean as C
from ignis.operators import forest as FO
from ignis.operators import metrics as M
from ignis.operators import ml as ML
from ignis.operators import profiles as PR
from ignis.operators import resample as RS
from ignis.operators import resample_counts as RC
from ignis.operators import stats as ST
from ignis.operators import tables as TB
from ignis.operators import trees as TR
from ignis.operators.climate import DAY_OF_MEASURES
from ignis.operators.nearest import nearest_site
from ignis.operators.prefix import quantiles_wide
from ignis.plans import views as V
from ignis.session import scratch_path
from ignis.sources import files as FS
from ignis.sources import fixtures as fx
from ignis.sources import stations as STN

DIGITS = 6
SEED = 42


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (and turn -0.0 into 0.0)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# Column names of the derived tables.
WINDOW_COLS = {w: [f"temp_mean_{w}d", f"temp_max_{w}d", f"precip_total_{w}d", f"rain_total_{w}d",
                   f"dry_days_{w}d", f"temp_range_{w}d"] for w in (7, 30)}
CLIMATE_CORR_COLS = ["temp_max", "temp_min", "temp_mean", "precip", "rain", "diurnal_range", "temp_mean_7d",
                     "precip_total_7d", "dry_days_7d", "temp_mean_30d", "precip_total_30d", "dry_days_30d",
                     "temp_anomaly", "fire_weather_index"]


# ---------------------------------------------------------------- scans
def q_incident_scan(spark, sf):
    return finish(fx.incidents(spark, sf))


def q_incident_landed_scan(spark, sf):
    """Incidents landed as text under their raw column names, scanned with a
    declared all-string schema and coerced leniently (the raw-ingest path)."""
    raw = fx.incidents(spark, sf).select(
        F.col("inc_id").alias("FIRE_ID"), F.col("yr").alias("YEAR"), F.col("mo").alias("MONTH"),
        F.col("dy").alias("DAY"), F.col("cause").alias("CAUSE"), F.col("agency").alias("SRC_AGENCY"),
        F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), F.col("size_ha").alias("SIZE_HA"),
        F.col("calc_ha").alias("CALC_HA"))
    path = scratch_path(spark, f"incidents_csv_{uuid.uuid4().hex}")
    FS.write_csv(raw, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns])
    landed = FS.read_optional(spark, path, schema, fmt="csv", header="true")
    return finish(C.standardize_incidents(landed))


def q_table_shape(spark, sf):
    shape, _ = FS.preview(fx.incidents(spark, sf))
    return shape


def q_table_preview(spark, sf):
    _, head = FS.preview(fx.incidents(spark, sf), 10, ["inc_id"])
    return finish(head)


def q_obs_union_by_name(spark, sf):
    """Observation files written in two layouts (before 1998 without snow and
    gust columns, in another column order), then scanned back and unioned by
    column name."""
    obs = fx.daily_obs(spark, sf)
    out = scratch_path(spark, f"obs_csv_{uuid.uuid4().hex}")
    old = obs.where(F.col("obs_date") < F.lit("1998-01-01").cast("date")).select(
        "obs_date", "site_id", "copy_no", "temp_min", "temp_max", "temp_mean", "precip", "rain")
    new = obs.where(F.col("obs_date") >= F.lit("1998-01-01").cast("date")).select(
        "site_id", "obs_date", "copy_no", "temp_max", "temp_min", "temp_mean", "precip", "rain",
        "snow_ground", "wind_gust")
    FS.write_csv(old, f"{out}/old")
    FS.write_csv(new, f"{out}/new")
    u = FS.read_csv_union(spark, f"{out}/*/*.csv", lineage=False)
    from ignis.functions.columns import lenient_double
    return finish(u.select(F.col("site_id").cast("long").alias("site_id"),
                           F.col("obs_date").cast("date").alias("obs_date"),
                           F.col("copy_no").cast("int").alias("copy_no"),
                           *[lenient_double(c).alias(c) for c in
                             ("temp_max", "temp_min", "temp_mean", "precip", "rain", "snow_ground", "wind_gust")]))


def q_csv_rejects(spark, sf):
    """Orders written as CSV files with every 200th line cut short by an open
    quote, then scanned; the malformed lines of each file are counted."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    bad = F.col("o_orderkey") % 200 == 0
    line = F.when(bad, F.concat(F.col("o_orderkey").cast("string"), F.lit(',a,b,"c'))).otherwise(
        F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderpriority")))
    path = scratch_path(spark, f"orders_csv_{uuid.uuid4().hex}")
    # each task writes one file, which its first row (place 0 of the partition) gives its header
    header = "o_orderkey,o_orderpriority"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    body = o.select(F.when(first, F.concat(F.lit(f"{header}\n"), line)).otherwise(line).alias("line"))
    head = spark.createDataFrame([(header,)], "line string")  # a file of its own, also where there are no orders
    head.unionByName(body).write.option("maxRecordsPerFile", 0).text(f"{path}/csv")
    found = FS.rejected_files(spark, f"{path}/csv/*.txt")
    return found.groupBy("reason").agg(F.sum("rejected").alias("rejected"))


def q_geojson_features(spark, sf):
    """Customers written as FeatureCollections, one document a file, whose names hold
    braces, quotes and backslashes, then scanned; the features of one country are kept."""
    c = fx.table(spark, sf, "customer")
    files = max(4, c.count() // 100_000)
    name = F.concat(F.col("c_name"), F.lit(' {"'), F.col("c_custkey").cast("string"), F.lit('\\"}], [{'))
    code = F.when(F.col("c_nationkey") == 3, F.lit("CA")).otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("c_acctbal").cast("double"), (F.col("c_custkey") % 90).cast("double")).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(code.alias("iso_a2"), F.col("c_custkey").alias("id"), name.alias("name")).alias("properties"),
                                 point.alias("geometry")))
    rows = c.select((F.col("c_custkey") % files).cast("int").alias("file"), F.lit(1).alias("part"), F.col("c_custkey").alias("key"), feature.alias("line"))
    least = rows.groupBy("file").agg(F.min("key").alias("least"))
    rows = rows.join(F.broadcast(least), "file").withColumn("line", F.when(F.col("key") == F.col("least"), F.col("line")).otherwise(F.concat(F.lit(","), "line")))
    ends = [least.select("file", F.lit(part).alias("part"), F.lit(0).cast("long").alias("key"), F.lit(text).alias("line"))
            for part, text in ((0, '{"type": "FeatureCollection", "features": ['), (2, "]}"))]
    path = scratch_path(spark, f"features_{uuid.uuid4().hex}")
    whole = rows.drop("least").unionByName(ends[0]).unionByName(ends[1])
    whole.repartition(files, "file").sortWithinPartitions("file", "part", "key").select("file", "line").write.partitionBy("file").text(path)
    found = FS.read_geojson_features(spark, f"{path}/*/*.txt", keep="CA")
    return finish(found.select("code", F.col("properties.id").cast("long").alias("id"), F.col("properties.name").alias("name"),
                               F.get(F.col("geometry.coordinates"), F.lit(0)).cast("double").alias("x"), F.get(F.col("geometry.coordinates"), F.lit(1)).cast("double").alias("y")))


def _catalogue_csv(spark, sf):
    path = scratch_path(spark, f"catalogue_{uuid.uuid4().hex}")
    cat = STN.catalogue_fixture(spark, sf)
    FS.write_csv(cat, path)
    return STN.read_catalogue(spark, path)


STATION_PERIOD = (1996, 2000)


def q_station_filter(spark, sf):
    st = STN.filter_stations(_catalogue_csv(spark, sf), *STATION_PERIOD)
    return st.select(F.col("STATION_ID").alias("station_id"), F.col("START_YEAR").alias("start_year"),
                     F.col("END_YEAR").alias("end_year"), F.col("NAME").alias("name"))


def q_station_geo(spark, sf):
    cat = _catalogue_csv(spark, sf)
    g = STN.station_geo(STN.filter_stations(cat, *STATION_PERIOD), cat)
    return finish(g.select(F.col("STATION_ID").alias("station_id"), F.col("START_YEAR").alias("start_year"),
                           F.col("END_YEAR").alias("end_year"), F.col("NAME").alias("name"), "x", "y"))


def _existing_files(spark, sf):
    """Already fetched files: one per supplier x ship year; size = returned items
    (0 = an empty file, which is fetched again); size = items shipped at the maximum quantity."""
    li = fx.table(spark, sf, "lineitem")
    st = STN.filter_stations(STN.catalogue_fixture(spark, sf), *STATION_PERIOD)
    per = li.groupBy(F.col("l_suppkey").alias("STATION_ID"), F.year("l_shipdate").alias("year")).agg(
        F.count_if(F.col("l_quantity") >= 50).alias("size"))
    return per.join(st.select("STATION_ID", "NAME"), "STATION_ID").select(
        F.format_string("climate_daily_%s_%d.csv", F.col("NAME"), F.col("year")).alias("file_name"), "size")


def q_fetch_manifest(spark, sf):
    st = STN.filter_stations(STN.catalogue_fixture(spark, sf), *STATION_PERIOD)
    m = STN.fetch_manifest(st, _existing_files(spark, sf), "bulk://climate/daily")
    return m.select(F.col("STATION_ID").alias("station_id"), F.col("NAME").alias("name"), "year", "file_name", "url")


# ---------------------------------------------------------------- cleaning / features
def q_clean_incidents(spark, sf):
    return finish(V.clean(spark, sf))


def q_size_features(spark, sf):
    s = C.size_features(fx.incidents(spark, sf))
    return finish(s.select("inc_id", "fire_size", "log_size", "log_size_fallback", "log10_size"))


def q_temporal_features(spark, sf):
    c = V.clean(spark, sf)
    t = C.temporal_features(c, "main")
    y, m, d = F.col("yr"), F.col("mo"), F.col("dy")
    t = t.select("inc_id", "doy", "doy_sin", "doy_cos", "dow", "is_weekend", "month", "year",
                 day_of_year(y, m, d, "leap2000", "strict_parts").alias("doy_older"),
                 weekend_flag(day_of_week(y, m, d, (1900, 2030)), missing_as_zero=False).alias("is_weekend_older"),
                 (F.floor(y / 10) * 10).cast("int").alias("decade"),
                 day_of_year(y, m, d, "actual", "fallback").alias("doy_actual"))
    return finish(t)


def q_label_encode(spark, sf):
    c = V.clean(spark, sf)
    e = C.label_encode(c, "agency", "province_code")
    e = C.label_encode(e, "agency", "agency_code_filled", fill="Unknown")
    return e.select("inc_id", "agency", "province_code", "agency_code_filled")


# ---------------------------------------------------------------- sites and weather
def q_site_dimension(spark, sf):
    obs = fx.daily_obs(spark, sf)
    d = TB.first_non_null(obs, "site_name", ["site_lon", "site_lat", "climate_id"], ["dn", "copy_no"])
    return finish(d.select(F.col("site_name").alias("station_name"), F.col("site_lon").alias("stn_lon"),
                           F.col("site_lat").alias("stn_lat"), "climate_id"))


def q_nearest_site(spark, sf):
    return finish(V.with_nearest(spark, sf).select("inc_id", "nearest_site", "nearest_name", "station_dist_km"))


def q_nearest_poles(spark, sf):
    """Nearest site where sites and points lie at the poles and round the
    antimeridian: latitudes stretched to -90 ... 90, longitudes to 0 ... 360."""
    sites = fx.sites(spark, sf).select(
        "site_id", "site_name", F.when(F.col("site_id") % 9 == 0, 90.0).when(F.col("site_id") % 9 == 1, -90.0)
        .otherwise((F.col("site_lat") - 51.0) * 10.0).alias("site_lat"), ((F.col("site_id") * 577) % 3600 / 10.0).alias("site_lon"))
    c = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("point_id"), F.when(F.col("c_custkey") % 11 == 0, 90.0).when(F.col("c_custkey") % 11 == 1, -90.0)
        .when(F.col("c_custkey") % 11 == 2, 89.5).otherwise((F.col("c_custkey") * 37) % 1800 / 10.0 - 90.0).alias("lat"),
        ((F.col("c_custkey") * 91) % 3600 / 10.0 - 180.0).alias("lon"))
    # where sites are equally near to the last bits, engines may differ in which comes first: the distance is what counts
    return finish(nearest_site(c, sites).select("point_id", "station_dist_km"), 5)


def q_site_distance_quantiles(spark, sf):
    n = V.joined_stored(spark, sf)
    return finish(quantiles_wide(n, "station_dist_km", {"p50_km": 0.5, "p90_km": 0.9}))


def q_climate_day_of(spark, sf):
    return finish(V.joined_stored(spark, sf).select("inc_id", *DAY_OF_MEASURES))


def q_climate_7d(spark, sf):
    return finish(V.joined_stored(spark, sf).select("inc_id", *WINDOW_COLS[7]))


def q_climate_30d(spark, sf):
    return finish(V.joined_stored(spark, sf).select("inc_id", *WINDOW_COLS[30]))


def q_climate_derived(spark, sf):
    d = C.climate_derived(V.joined_stored(spark, sf))
    return finish(d.select("inc_id", "diurnal_range", "temp_anomaly", "fire_weather_index", "station_dist"))


def q_joined_features(spark, sf):
    j = V.joined(spark, sf)
    return finish(j.select("inc_id", "target", "nearest_site", "station_dist_km", "fire_date",
                           *DAY_OF_MEASURES, *WINDOW_COLS[7], *WINDOW_COLS[30]))


def q_model_dataset(spark, sf):
    return finish(V.model_dataset(spark, sf))


# ---------------------------------------------------------------- profiles
def q_feature_coverage(spark, sf):
    return finish(PR.coverage(V.features(spark, sf), V.FEATURE_COLS))


def q_null_profile(spark, sf):
    return finish(PR.null_profile(fx.incidents(spark, sf)))


def q_numeric_profile(spark, sf):
    return finish(PR.numeric_profile(fx.daily_obs(spark, sf)))


def q_cause_counts(spark, sf):
    return TB.value_counts(fx.incidents(spark, sf), "cause")


def q_top_years(spark, sf):
    return TB.value_counts(fx.incidents(spark, sf), "yr", top=10)


def q_class_distribution(spark, sf):
    return finish(TB.class_distribution(V.clean(spark, sf)))


def q_class_means(spark, sf):
    d = C.size_features(C.temporal_features(C.cause_filtered(fx.incidents(spark, sf)), "older"))
    return finish(TB.class_means(d, doy="doy", log_size="log_size_fallback"))


def q_size_describe(spark, sf):
    return finish(PR.describe_positive(fx.incidents(spark, sf), ["size_ha", "calc_ha"]))


# ---------------------------------------------------------------- cross-tabs
def _clean_t(spark, sf):
    return C.temporal_features(V.clean(spark, sf), "main").withColumn("decade", (F.floor(F.col("yr") / 10) * 10).cast("int"))


def q_cause_by_month(spark, sf):
    return TB.crosstab(V.clean(spark, sf), "mo")


def q_cause_by_agency(spark, sf):
    return TB.crosstab(V.clean(spark, sf), "agency")


def q_cause_by_year(spark, sf):
    return TB.crosstab(V.clean(spark, sf).where(F.col("yr") >= 1980), "yr")


def q_cause_by_decade(spark, sf):
    return TB.crosstab(_clean_t(spark, sf), "decade")


def q_cause_by_weekday(spark, sf):
    return TB.crosstab(_clean_t(spark, sf), "dow")


def q_agency_cause_pct(spark, sf):
    return finish(TB.row_percentages(TB.crosstab(V.clean(spark, sf), "agency"), "agency"))


def q_weekday_cause_pct(spark, sf):
    return finish(TB.row_percentages(TB.crosstab(_clean_t(spark, sf), "dow"), "dow", sort_by=None))


def q_human_rate_top(spark, sf):
    return finish(TB.group_rate(V.clean(spark, sf), "agency", top=3))


def _sized(spark, sf):
    return C.size_features(fx.incidents(spark, sf))


def q_yearly_stats(spark, sf):
    return finish(TB.yearly_stats(_sized(spark, sf)))


def q_monthly_counts(spark, sf):
    return TB.group_sizes(fx.incidents(spark, sf), "mo")


def q_agency_stats(spark, sf):
    return finish(TB.agency_stats(_sized(spark, sf)))


def _trend_input(spark, sf):
    return TB.yearly_stats(_sized(spark, sf)).where(F.col("num_fires") > 10)


#: Years that a trend takes: the fixture spans seven, so fewer than the operator's own default.
TREND_YEARS = 3


def q_yearly_trend(spark, sf):
    return finish(ST.yearly_trend(_trend_input(spark, sf), "yr", ["num_fires", "total_area"], TREND_YEARS))


def q_yearly_trend_pvalue(spark, sf):
    return finish(ST.with_trend_p_value(ST.yearly_trend(_trend_input(spark, sf), "yr", ["num_fires", "total_area"], TREND_YEARS)))


def q_climate_correlation(spark, sf):
    return finish(ST.correlation_long(V.model_dataset(spark, sf, fill=False), CLIMATE_CORR_COLS))


def q_size_histogram(spark, sf):
    return finish(ST.histogram(_sized(spark, sf), "log10_size", bins=50))


def q_histogram_sparse(spark, sf):
    """A histogram most of whose bins are empty: sizes of the incidents of one
    day of the year per agency (missing agencies are a group too)."""
    return finish(ST.histogram(_sized(spark, sf).where((F.col("mo") == 2) & (F.col("dy") == 29)), "fire_size", bins=50, group="agency"))


def q_score_histogram(spark, sf):
    return finish(ST.histogram(V.scored(spark, sf), "score", bins=50, group="label"))


# ---------------------------------------------------------------- metrics
def q_confusion_matrix(spark, sf):
    return M.confusion_counts(V.scored(spark, sf))


def q_binary_metrics(spark, sf):
    return finish(M.binary_metrics(V.scored(spark, sf)))


def q_class_report(spark, sf):
    return finish(M.class_report(V.scored(spark, sf)))


def q_prob_losses(spark, sf):
    return finish(M.prob_losses(V.scored(spark, sf)))


def q_baseline_lift(spark, sf):
    return finish(M.baseline_lift(V.scored(spark, sf)))


def q_roc_auc(spark, sf):
    return finish(M.roc_auc(V.scored(spark, sf)))


def q_roc_curve(spark, sf):
    return finish(M.roc_curve(V.scored(spark, sf)))


def q_average_precision(spark, sf):
    return finish(M.average_precision(V.scored(spark, sf)))


def q_pr_curve(spark, sf):
    return finish(M.pr_curve(V.scored(spark, sf)))


def q_calibration(spark, sf):
    return finish(M.calibration(V.scored(spark, sf)))


def q_regression_metrics(spark, sf):
    s = _sized(spark, sf).where(F.col("fire_size") > 0)
    r = s.select(F.log1p("fire_size").alias("y"), F.log1p("calc_ha").alias("yhat"))
    return finish(M.regression_metrics(r))


# ---------------------------------------------------------------- splits and resampling
def _split(spark, sf):
    return RS.stratified_split(V.scored(spark, sf), seed=SEED)


def q_stratified_split(spark, sf):
    return _split(spark, sf).select("id", "label", "split")


def q_class_weights(spark, sf):
    tr = _split(spark, sf).where(F.col("split") == "train")
    return finish(RS.class_weights(tr).select("id", "label", "weight"))


def q_stratified_folds(spark, sf):
    return RS.stratified_folds(V.scored(spark, sf), seed=SEED).select("id", "label", "fold")


def q_sample_n(spark, sf):
    return finish(RS.sample_n(V.scored(spark, sf), 5000, seed=SEED).select("id", "label", "score"))


def q_permutation_test(spark, sf):
    return finish(RS.permutation_test(V.scored(spark, sf), n_perm=1000, seed=SEED))


def q_bootstrap_ci(spark, sf):
    return finish(RS.bootstrap_ci(V.scored(spark, sf), n_boot=1000, seed=SEED))


def q_bootstrap_multinomial(spark, sf):
    """Bootstrap intervals whose every replicate is exactly n draws with replacement."""
    return finish(RC.bootstrap_counts(V.scored(spark, sf), n_boot=1000, seed=SEED))


def q_permutation_by_counts(spark, sf):
    """The permutation test drawn by distinct score."""
    return finish(RC.permutation_counts(V.scored(spark, sf), n_perm=1000, seed=SEED))


# ---------------------------------------------------------------- models: operators around a fit, with oracles
SIZE_FEATURES = ["month", "year", "agency_code", "cause_code"]


def q_standardize(spark, sf):
    """Feature rows of the earlier pipeline scaled by mean and population std."""
    return finish(ML.standardized_table(V.older_model_rows(spark, sf), V.OLDER_FEATURES))


def q_validation_slice(spark, sf):
    return ML.with_validation_slice(V.scored(spark, sf)).select("id", "is_validation")


def q_cv_fold_summary(spark, sf):
    """Fold metrics of a given score: the summary that cross-validation reports."""
    folds = RS.stratified_folds(V.scored(spark, sf), seed=SEED)
    return finish(ML.fold_summary(ML.fold_metrics(folds)))


def _score_columns(spark, sf):
    """Three scores of the same rows."""
    s = V.scored(spark, sf).select("id", "label", "score")
    other = ((F.col("id") * 7561) % 1000) / F.lit(1e3)
    named = F.array(F.struct(F.lit("fixed").alias("model"), F.col("score").alias("s")), F.struct(F.lit("noise").alias("model"), other.alias("s")),
                    F.struct(F.lit("mixed").alias("model"), ((F.col("score") + other) / 2).alias("s")))
    return s.select("id", "label", F.explode(named).alias("m")).select("id", "label", "m.model", F.col("m.s").alias("score")).withColumn(
        "pred", (F.col("score") >= 0.5).cast("int"))


def q_model_comparison(spark, sf):
    """Metrics of three scores side by side, the best by ROC-AUC marked."""
    per = ML.fold_metrics(_score_columns(spark, sf), "model")
    best = F.row_number().over(Window.orderBy(F.col("roc_auc").desc(), F.col("model"))) == 1  # one row a model
    return finish(per.withColumn("is_best", best))


def _correlation_importance(spark, sf):
    """Importances with a closed form: each feature's share of |correlation with the target|."""
    rows = V.model_dataset(spark, sf)
    one = rows.agg(*[F.coalesce(F.abs(F.corr(c, F.col("target").cast("double"))), F.lit(0.0)).alias(c) for c in V.FEATURE_COLS]).first()
    values = [0.0 if one[c] != one[c] else round(one[c], 9) for c in V.FEATURE_COLS]
    total = sum(values)
    return ML.importance_table(spark, V.FEATURE_COLS, [v / total for v in values], V.FEATURE_LABELS)


def q_correlation_importance(spark, sf):
    return finish(_correlation_importance(spark, sf))


def q_correlation_importance_groups(spark, sf):
    return finish(ML.grouped_importance(_correlation_importance(spark, sf), V.FEATURE_GROUPS))


#: A fixed logistic score over the main features, so that explanations have a closed form.
FIXED_WEIGHTS = {"doy": 0.004, "doy_sin": -0.8, "latitude": 0.03, "longitude": 0.02, "month": -0.05, "log_size": 0.3, "is_weekend": 0.25}
FIXED_BIAS = 0.7


def _fixed_scorer():
    return ML.logistic_scorer([FIXED_WEIGHTS.get(c, 0.0) for c in V.FEATURE_COLS], FIXED_BIAS)


def q_partial_dependence_fixed(spark, sf):
    sample = RS.sample_n(V.main_model_rows(spark, sf), 10000, seed=SEED).checkpoint(eager=True)
    return finish(ML.partial_dependence(_fixed_scorer(), sample, V.FEATURE_COLS, V.PDP_FEATURES, resolution=50))


def q_sampled_shapley_fixed(spark, sf):
    rows = V.main_model_rows(spark, sf).checkpoint(eager=True)
    explain, background = RS.sample_n(rows, 5000, seed=SEED), RS.sample_n(rows, 100, seed=SEED + 1)
    values = ML.sampled_shapley(_fixed_scorer(), explain, background, V.FEATURE_COLS, n_samples=10, seed=SEED)
    return finish(ML.shapley_summary(values))


def _fixed_paths(spark, rows):
    nodes = spark.createDataFrame([(*r, None) for r in V.FIXED_TREES],
                                  "tree int, node int, feature string, threshold double, left int, right int, value double, cover double")
    return TR.leaf_paths(TR.with_cover(nodes, rows, V.FEATURE_COLS))


def q_walked_dependence_fixed(spark, sf):
    """Partial dependence of a fixed ensemble by the weighted walk, its covers
    counted over all model rows; grids as partial dependence has them."""
    rows = V.main_model_rows(spark, sf).checkpoint(eager=True)
    grid = {f: ML.grid_values(rows, f, 50) for f in V.PDP_FEATURES}
    return finish(TR.walked_dependence(_fixed_paths(spark, rows), grid))


def q_tree_shapley_fixed(spark, sf):
    """Exact attributions of a fixed ensemble for all model rows, summed up by feature."""
    rows = V.main_model_rows(spark, sf).checkpoint(eager=True)
    return finish(ML.shapley_summary(TR.tree_shapley(rows, _fixed_paths(spark, rows), V.FEATURE_COLS)))


# ---------------------------------------------------------------- fitted models (rows-only checks)
def _older_split(spark, sf):
    rows = V.stored(spark, sf, "older_rows", lambda: V.older_model_rows(spark, sf))
    d = RS.stratified_split(rows, seed=SEED).checkpoint(eager=True)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _model_row(name, scored_test, n_train):
    ev = ML.evaluate(scored_test)
    return ev.select(F.lit(name).alias("model"), "accuracy", "roc_auc", "average_precision", "f1",
                     F.lit(int(n_train)).alias("n_train"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_test"))


def q_train_lr(spark, sf):
    tr, te = _older_split(spark, sf)
    tr, te = ML.standardize(tr, [te], V.OLDER_FEATURES)
    n = tr.count()
    model = ML.logistic_regression(n).fit(ML.assemble(tr, V.OLDER_FEATURES))
    return finish(_model_row("logistic_regression", ML.score(model, ML.assemble(te, V.OLDER_FEATURES)), n))


def _forest_scored(tr, te, cols):
    """The test rows scored by 100 trees without a depth limit."""
    scores = FO.forest_predictions(tr, te, cols, FO.Settings(trees=100, seed=SEED))
    return scores.join(te.select("id", "label"), "id").select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))


def q_train_rf(spark, sf):
    tr, te = _older_split(spark, sf)
    return finish(_model_row("random_forest", _forest_scored(tr, te, V.OLDER_FEATURES), tr.count()))


def q_best_model(spark, sf):
    """LR (standardized), RF (100 trees without a depth limit) and GBT (100 trees, library defaults)
    on the same split; best by ROC-AUC."""
    tr, te = _older_split(spark, sf)
    n = tr.count()
    trs, tes = ML.standardize(tr, [te], V.OLDER_FEATURES)
    f = V.OLDER_FEATURES
    lr = ML.logistic_regression(n).fit(ML.assemble(trs, f))
    gb = ML.gradient_boosting(max_iter=100, seed=SEED).fit(ML.assemble(tr, f))
    rows = [_model_row("logistic_regression", ML.score(lr, ML.assemble(tes, f)), n),
            _model_row("random_forest", _forest_scored(tr, te, f), n),
            _model_row("gradient_boosting", ML.score(gb, ML.assemble(te, f)), n)]
    allm = rows[0].unionByName(rows[1]).unionByName(rows[2]).checkpoint(eager=True)
    w = Window.orderBy(F.col("roc_auc").desc(), F.col("model"))
    return finish(allm.withColumn("is_best", F.row_number().over(w) == 1))


def _main_rows(spark, sf):
    """The main model's rows with their split, stored once."""
    return V.stored(spark, sf, "main_rows", lambda: RS.stratified_split(V.main_model_rows(spark, sf), seed=SEED))


def _main_fit(spark, sf):
    """The main model, fitted and stored (as its node table) once per state of the
    input, and its rows."""
    d = _main_rows(spark, sf)
    tr, te = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    nodes = V.stored(spark, sf, "main_gbt", lambda: ML.fit_main_gbt(tr, V.FEATURE_COLS, seed=SEED).node_table(spark), params=(BO.MAIN, SEED))
    return BO.Boosted.from_nodes(nodes, V.FEATURE_COLS), tr, te


def q_train_gbt(spark, sf):
    model, tr, te = _main_fit(spark, sf)
    ev = ML.evaluate(ML.score(model, ML.assemble(te, V.FEATURE_COLS)))
    return finish(ev.withColumn("n_trees", F.lit(int(model.getNumTrees))))


def q_rf_size_regression(spark, sf):
    d = V.size_model_rows(spark, sf)
    d = RS.stratified_split(d.withColumn("__one", F.lit(0)), label="__one", seed=SEED).drop("__one").checkpoint(eager=True)
    tr, te = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    scores = FO.forest_predictions(tr, te, SIZE_FEATURES, FO.Settings(trees=100, features="all", seed=SEED))
    pred = scores.join(te.select("id", F.col("label").alias("y")), "id").select("y", F.col("score").alias("yhat"))
    return finish(M.regression_metrics(pred))


def q_cross_validate(spark, sf):
    return finish(ML.cross_validate_boosted(_main_rows(spark, sf).drop("split"), V.FEATURE_COLS, k=5, seed=SEED))


def q_feature_importance(spark, sf):
    model, _, _ = _main_fit(spark, sf)
    return finish(ML.importance_table(spark, V.FEATURE_COLS, model.featureImportances.toArray(), V.FEATURE_LABELS))


def q_grouped_importance(spark, sf):
    model, _, _ = _main_fit(spark, sf)
    imp = ML.importance_table(spark, V.FEATURE_COLS, model.featureImportances.toArray())
    return finish(ML.grouped_importance(imp, V.FEATURE_GROUPS))


def q_partial_dependence(spark, sf):
    model, tr, _ = _main_fit(spark, sf)
    sample = RS.sample_n(tr, 10000, seed=SEED).checkpoint(eager=True)
    return finish(ML.partial_dependence(ML.model_scorer(model), sample, V.FEATURE_COLS, V.PDP_FEATURES, resolution=50))


def q_sampled_shapley(spark, sf):
    model, tr, te = _main_fit(spark, sf)
    explain = RS.sample_n(te, 5000, seed=SEED)
    background = RS.sample_n(tr, 100, seed=SEED + 1)
    values = ML.sampled_shapley(ML.model_scorer(model), explain, background, V.FEATURE_COLS, n_samples=10, seed=SEED)
    return finish(ML.shapley_summary(values))


def q_walked_dependence(spark, sf):
    """Partial dependence of the main model by the weighted walk (margin scale)."""
    model, tr, _ = _main_fit(spark, sf)
    sample = RS.sample_n(tr, 10000, seed=SEED).checkpoint(eager=True)
    grid = {f: ML.grid_values(sample, f, 50) for f in V.PDP_FEATURES}
    return finish(TR.walked_dependence(TR.leaf_paths(model.node_table(spark)), grid))


def q_tree_shapley(spark, sf):
    """Exact attributions of the main model for a sample of the test rows."""
    model, _, te = _main_fit(spark, sf)
    explain = RS.sample_n(te, 5000, seed=SEED)
    return finish(ML.shapley_summary(TR.tree_shapley(explain, TR.leaf_paths(model.node_table(spark)), V.FEATURE_COLS)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
