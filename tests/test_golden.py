"""Published arithmetic and the literal golden vectors."""

from pyspark.sql import functions as F

from ignis.functions.columns import clip_lower
from ignis.functions.dates import day_of_week, day_of_year
from ignis.operators import metrics as M
from ignis.operators.climate import weather_features
from ignis.operators.clean import climate_derived


def test_binary_metrics_from_published_counts(spark):
    counts = spark.createDataFrame([(30347, 3979, 7008, 33456)], "tn long, fp long, fn long, tp long")
    r = M.metrics_from_counts(counts).first()
    assert round(r.accuracy, 4) == 0.8531
    assert round(r.precision, 4) == 0.8937
    assert round(r.recall, 4) == 0.8268
    assert round(r.specificity, 4) == 0.8841
    assert round(r.f1, 4) == 0.8590
    assert round(r.mcc, 4) == 0.7085


def test_class_report_from_published_counts(spark):
    rows = [(0, 0)] * 30347 + [(0, 1)] * 3979 + [(1, 0)] * 7008 + [(1, 1)] * 33456
    df = spark.createDataFrame(rows, "label int, pred int")
    rep = {r.class_name: r for r in M.class_report(df).collect()}
    nat, hum = rep["Natural"], rep["Human"]
    assert (round(nat.precision, 3), round(nat.recall, 3), round(nat.f1, 3), nat.support) == (0.812, 0.884, 0.847, 34326)
    assert (round(hum.precision, 3), round(hum.recall, 3), round(hum.f1, 3), hum.support) == (0.894, 0.827, 0.859, 40464)


def test_published_lifts():
    roc, pr, prevalence = 0.9323, 0.9461, 0.541
    assert round(roc - 0.5, 3) == 0.432 and round((roc - 0.5) / 0.5 * 100, 1) == 86.5
    assert round(pr - prevalence, 3) == 0.405 and round((pr - prevalence) / prevalence * 100, 1) == 74.9


def test_station_counts_total():
    counts = {"QC": 79, "BC": 65, "ON": 28, "SK": 16, "AB": 14, "MB": 12, "NL": 7, "NS": 4, "NB": 2,
              "YT": 1, "NT": 1, "NU": 1, "PE": 1}
    assert sum(counts.values()) == 231


def test_day_of_year_and_weekday(spark):
    df = spark.createDataFrame([(2001, 7, 1), (2001, 2, 30), (2024, 6, 2), (2001, None, 3)], "y int, m int, d int")
    r = df.select(day_of_year("y", "m", "d").alias("doy"), day_of_week("y", "m", "d").alias("dow")).collect()
    assert r[0].doy == 183
    assert r[1].doy is None and r[1].dow is None
    assert r[2].dow == 6
    assert r[3].doy is None


def test_clip_and_log_and_bround(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (3.0,)], "s double")
    r = df.select(F.log1p(clip_lower("s")).alias("v")).collect()
    assert r[0].v is None and r[1].v == 0.0
    assert spark.range(1).select(F.bround(F.lit(2.25), 1).alias("b")).first().b == 2.2
    assert spark.range(1).select(F.greatest(F.lit(None).cast("double"), F.lit(0.0)).alias("g")).first().g == 0.0


def test_fire_weather_index_all_missing_is_zero(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, 10.0)],
                               "temp_max double, temp_min double, temp_mean double, precip double, "
                               "wind_gust double, temp_mean_30d double, station_dist_km double")
    assert climate_derived(df).first().fire_weather_index == 0.0


def test_auc_tie_is_half(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3)], "label int, score double")
    assert M.roc_auc(df).first().roc_auc == 0.5


def _obs(spark, rows):
    return spark.createDataFrame(
        rows, "site_id long, obs_date date, copy_no int, temp_max double, temp_min double, temp_mean double, "
              "precip double, rain double")


def test_window_guard_two_rows_is_null(spark):
    import datetime as dt
    d0 = dt.date(2000, 6, 10)
    obs = _obs(spark, [(1, d0 - dt.timedelta(days=k), 1, 20.0, 10.0, 15.0, 1.0, 1.0) for k in (1, 2)])
    probes = spark.createDataFrame([(1, d0)], "site_id long, fire_date date")
    r = weather_features(probes, obs).first()
    assert r.temp_mean_7d is None and r.precip_total_7d is None and r.dry_days_7d is None


def test_window_three_missing_rows(spark):
    import datetime as dt
    d0 = dt.date(2000, 6, 10)
    rows = [(1, d0 - dt.timedelta(days=k), 1, None, None, None, None, None) for k in (1, 3, 5)]
    rows.append((1, d0, 1, 30.0, 20.0, 25.0, 9.0, 9.0))  # on the incident day: not in the window
    obs = _obs(spark, rows)
    probes = spark.createDataFrame([(1, d0)], "site_id long, fire_date date")
    r = weather_features(probes, obs).first()
    assert r.precip_total_7d == 0.0 and r.rain_total_7d == 0.0
    assert r.dry_days_7d == 3.0
    assert r.temp_mean_7d is None and r.temp_range_7d is None and r.temp_max_7d is None
    assert r.temp_max == 30.0 and r.precip == 9.0   # day-of values


def test_day_of_takes_first_duplicate(spark):
    import datetime as dt
    d0 = dt.date(2000, 6, 10)
    obs = _obs(spark, [(1, d0, 2, 5.0, 1.0, 3.0, 2.0, 0.0), (1, d0, 1, None, 0.0, 2.0, 1.0, 0.0)])
    probes = spark.createDataFrame([(1, d0)], "site_id long, fire_date date")
    r = weather_features(probes, obs).first()
    assert r.temp_max is None and r.precip == 1.0


def test_standardize_landed_strings(spark):
    from ignis.operators.clean import clean_incidents, standardize_incidents
    raw = spark.createDataFrame(
        [("1", "2001", "7.0", "1", "N", "BC", "50.5", "-120", "nan", "3"),
         ("2", "abc", "5", "2", "H", None, "49", "-121", "-4", "1"),
         ("3", "1999", "13", "2", "H-PB", "AB", "", "-121", "12", "1"),
         ("4", "1999", "6", "2", "U", "AB", "48", "-121", "12", "1")],
        "FIRE_ID string, YEAR string, MONTH string, DAY string, CAUSE string, SRC_AGENCY string, "
        "LATITUDE string, LONGITUDE string, SIZE_HA string, CALC_HA string")
    s = standardize_incidents(raw)
    assert set(s.columns) == {"inc_id", "yr", "mo", "dy", "cause", "agency", "lat", "lon", "size_ha", "calc_ha"}
    rows = {r.inc_id: r for r in s.collect()}
    assert rows[1].mo == 7 and rows[1].size_ha is None          # 'nan' -> NULL, '7.0' -> 7
    assert rows[2].yr is None and rows[3].lat is None           # unparsable -> NULL
    c = {r.inc_id: r.target for r in clean_incidents(s).collect()}
    assert c == {1: 0}                                           # bad year, month 13, missing lat, cause U dropped
    partial = standardize_incidents(raw.drop("CALC_HA"))
    assert "calc_ha" not in partial.columns


def test_empty_inputs(spark):
    from ignis.operators.profiles import describe_positive
    from ignis.operators.stats import histogram
    e = spark.createDataFrame([], "v double, g int")
    assert histogram(e, "v").count() == 0
    assert histogram(e, "v", group="g").count() == 0
    assert describe_positive(e, []).count() == 0
    assert describe_positive(e, ["v"]).first().n == 0


def test_sentinel_and_column_guard(spark):
    from ignis.functions.columns import null_if_sentinel
    from ignis.operators.clean import has_columns
    df = spark.createDataFrame([(-999.0,), (3.0,), (None,)], "v double")
    assert [r.v for r in df.select(null_if_sentinel("v").alias("v")).collect()] == [None, 3.0, None]
    assert has_columns(df, ["v"]) and not has_columns(df, ["v", "w"])
