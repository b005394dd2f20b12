"""The adaptive tree for points far from all sites: exact, and few candidates."""

import math
import random

from pyspark.sql import functions as F

from ignis.operators import nearest as N


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def sites_frame(spark, sites):
    return spark.createDataFrame([(i, f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(sites)], "__skey long, __sname string, __slat double, __slon double")


def test_box_distance_is_a_tight_lower_bound(spark):
    r = random.Random(1)
    rows = []
    for _ in range(300):
        s, w = r.uniform(-90, 85), r.uniform(-180, 170)
        rows.append((r.uniform(-90, 90), r.uniform(-180, 180), s, min(90.0, s + r.uniform(0, 40)), w, min(179.9, w + r.uniform(0, 60))))
    rows += [(90.0, 0.0, 10.0, 20.0, 30.0, 40.0), (-90.0, 0.0, 10.0, 20.0, 30.0, 40.0), (0.0, 179.9, -5.0, 5.0, -179.9, -170.0), (80.0, 10.0, 70.0, 85.0, 170.0, 179.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, s double, n double, w double, e double")
    got = df.withColumn("d", N._box_distance(*[F.col(c) for c in ("lat", "lon", "s", "n", "w", "e")])).collect()
    for x in got:
        grid = min(km((x.lat, x.lon), (x.s + (x.n - x.s) * i / 60, x.w + (x.e - x.w) * j / 60)) for i in range(61) for j in range(61))
        assert x.d <= grid + 1e-6 and grid - x.d < 130


def test_lone_points_are_exact(spark):
    r = random.Random(2)
    sites = [(r.uniform(40, 70), r.uniform(-140, -50)) for _ in range(400)] + [(51.0 + i * 1e-7, -100.0) for i in range(60)] + [(90.0, 0.0), (-89.0, 170.0)]
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(150)] + [(90.0, 12.0), (-90.0, 0.0), (0.0, -180.0), (51.0, -100.0)]
    got = N.tree_search(spark.createDataFrame(points, "plat double, plon double"), sites_frame(spark, sites)).collect()
    assert len(got) == len(points)
    for x in got:
        best = min(km((x.plat, x.plon), s) for s in sites)
        assert abs(x["__best"].km - best) < 1e-6


def test_points_in_an_empty_hemisphere_meet_few_candidates(spark):
    """100,000 sites, all in one quarter of the globe."""
    sites = spark.range(100_000).select(
        F.col("id").alias("__skey"), F.concat(F.lit("s"), "id").alias("__sname"),
        (20 + 50 * F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("__slat"),
        (-130 + 80 * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1_000_003).alias("__slon")).checkpoint(eager=True)
    r = random.Random(3)
    points = [(r.uniform(-85, -5), r.uniform(20, 170)) for _ in range(60)]
    got = N.tree_search(spark.createDataFrame(points, "plat double, plon double"), sites).collect()
    known = [(x["__slat"], x["__slon"]) for x in sites.collect()]
    seen = [x["__seen"] for x in got]
    for x in got[:8]:
        assert abs(x["__best"].km - min(km((x.plat, x.plon), s) for s in known)) < 1e-6
    assert len(got) == 60 and sum(seen) / len(seen) < 200


def test_join_sends_lone_points_down_the_tree(spark, monkeypatch):
    asked = []
    search = N.tree_search
    monkeypatch.setattr(N, "tree_search", lambda p, s: asked.append(p.count()) or search(p, s))
    r = random.Random(4)
    sites = spark.createDataFrame([(i, f"n{i}", r.uniform(45, 60), r.uniform(-120, -60)) for i in range(500)], "site_id long, site_name string, site_lat double, site_lon double")
    points = [(i, r.uniform(45, 60), r.uniform(-120, -60)) for i in range(200)] + [(900, -60.0, 100.0), (901, -89.0, 0.0)]
    got = {x.pid: x.station_dist_km for x in N.nearest_site(spark.createDataFrame(points, "pid int, lat double, lon double"), sites).collect()}
    known = [(x.site_lat, x.site_lon) for x in sites.collect()]
    assert all(abs(got[i] - min(km((a, b), s) for s in known)) < 1e-6 for i, a, b in points) and asked and asked[0] < 60
