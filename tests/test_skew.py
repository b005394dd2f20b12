"""One key holding a large share of the rows must not change results and must
not be gathered into one window partition."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from ignis.operators.climate import weather_features
from ignis.operators.nearest import nearest_site
from ignis.operators.prefix import exact_quantiles


def test_hot_site_windows_split_by_block(spark):
    start = dt.date(1990, 1, 1)
    rnd = random.Random(2)
    obs = [(1, start + dt.timedelta(days=k), 1, float(k % 30), float(k % 7), float(k % 11),
            None if k % 5 == 0 else float(k % 3), 0.0) for k in range(0, 3650) if rnd.random() < 0.8]
    obs += [(2, start + dt.timedelta(days=k), 1, 1.0, 0.0, 0.5, 0.0, 0.0) for k in range(0, 3650, 10)]
    o = spark.createDataFrame(obs, "site_id long, obs_date date, copy_no int, temp_max double, temp_min double, "
                                   "temp_mean double, precip double, rain double")
    # a third of all probes on the hot site, every day of ten years
    probes = [(1, start + dt.timedelta(days=k)) for k in range(0, 3650)] + \
             [(2, start + dt.timedelta(days=k)) for k in range(0, 3650, 2)] * 4
    p = spark.createDataFrame(probes, "site_id long, fire_date date")
    got = {(r.site_id, r.fire_date): r for r in weather_features(p, o).collect()}
    assert len(got) == 3650 + 1825          # probes are deduplicated per (site, day)
    by_day = {(s, d): (tx, pr) for s, d, _, tx, _, _, pr, _ in obs}
    for k in range(40, 3650, 97):           # brute force on a spread of days
        d = start + dt.timedelta(days=k)
        win = [by_day[(1, d - dt.timedelta(days=j))] for j in range(1, 31) if (1, d - dt.timedelta(days=j)) in by_day]
        r = got[(1, d)]
        if len(win) >= 15:
            assert r.precip_total_30d == sum(x[1] or 0.0 for x in win)
            assert r.temp_max_30d == max(x[0] for x in win)
            assert r.dry_days_30d == sum(1 for x in win if not x[1])
        else:
            assert r.precip_total_30d is None
    # the window is partitioned by (site, year-block): the hot site spans 10+ partitions
    blocks = o.where("site_id = 1").select(F.floor(F.datediff("obs_date", F.lit("1970-01-01").cast("date")) / 365)
                                            .alias("b")).distinct().count()
    assert blocks >= 10


def test_hot_value_quantiles(spark):
    rnd = np.random.default_rng(4)
    vals = np.concatenate([np.full(1000, 7.0), rnd.normal(0, 3, 2000).round(3)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {r.p: r.q for r in exact_quantiles(df, "v", [0.1, 0.5, 0.66, 0.9]).collect()}
    for p, q in got.items():
        assert abs(q - np.percentile(vals, p * 100)) < 1e-9


def test_hot_coordinate_nearest(spark):
    pts = [(i, 50.0, -100.0) for i in range(3000)] + [(3000 + i, 40.0 + i * 0.01, -90.0) for i in range(100)]
    p = spark.createDataFrame(pts, "pid long, lat double, lon double")
    s = spark.createDataFrame([(1, "A", 50.1, -100.0), (2, "B", 41.0, -90.0)],
                              "site_id long, site_name string, site_lat double, site_lon double")
    out = nearest_site(p, s)
    counts = {r.nearest_site: r["count"] for r in out.groupBy("nearest_site").count().collect()}
    assert counts[1] == 3000 + 0 and counts[2] == 100


def test_dense_site_cluster_start_level(spark):
    from ignis.operators.nearest import _pick_start_level, _refine_for_density
    rnd = random.Random(8)
    sites = [(i, f"S{i}", rnd.uniform(42, 60), rnd.uniform(-140, -55)) for i in range(600)]
    sites += [(1000 + i, f"C{i}", 49.0 + rnd.uniform(0, 0.05), -123.0 + rnd.uniform(0, 0.05)) for i in range(300)]
    s = spark.createDataFrame(sites, "__skey long, __sname string, __slat double, __slon double")
    k0, _ = _pick_start_level(s, "__slat", "__slon")
    k = _refine_for_density(s, "__slat", "__slon", k0)
    assert k > k0
    pts = spark.createDataFrame([(j, 49.0 + rnd.uniform(-1, 1), -123.0 + rnd.uniform(-1, 1)) for j in range(200)],
                                "pid long, lat double, lon double")
    site_df = s.toDF("site_id", "site_name", "site_lat", "site_lon")
    got = {r.pid: r.nearest_site for r in nearest_site(pts, site_df).collect()}
    import math
    def hav(a, b, c, d):
        p1, p2 = math.radians(a), math.radians(c)
        x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))
    for r in pts.collect():
        assert got[r.pid] == min((hav(r.lat, r.lon, a, b), n, k_) for k_, n, a, b in sites)[2]
