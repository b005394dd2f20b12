"""Distributed operators against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from ignis.functions.geo import EARTH_RADIUS_KM
from ignis.operators import metrics as M
from ignis.operators import resample as RS
from ignis.operators.nearest import nearest_site
from ignis.operators.prefix import exact_quantiles, prefix_sums, rank_rows
from ignis.operators.tables import crosstab
from ignis.plans import views as V
from ignis.sources import fixtures as fx


def _hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(d) - math.radians(b)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(x))


@pytest.mark.parametrize("start_level", [None, 0, 3, 9])
def test_nearest_grid_equals_brute_force(spark, start_level):
    rnd = random.Random(5)
    sites = [(i, f"S{i:04d}", rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(60)]
    sites += [(100, "POLE", 89.9, 10.0), (101, "DATELINE", 0.5, 179.9)]
    pts = [(j, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for j in range(300)]
    pts += [(900, 0.4, -179.95), (901, 89.95, -170.0), (902, None, 3.0)]
    s = spark.createDataFrame(sites, "site_id long, site_name string, site_lat double, site_lon double")
    p = spark.createDataFrame(pts, "pid long, lat double, lon double")
    got = {r.pid: (r.nearest_site, r.station_dist_km) for r in nearest_site(p, s, start_level=start_level).collect()}
    for pid, la, lo in pts:
        if la is None:
            assert got[pid] == (None, None)
            continue
        best = min((_hav(la, lo, a, b), n, k) for k, n, a, b in sites)
        assert got[pid][0] == best[2]
        assert abs(got[pid][1] - best[0]) < 1e-6


def test_nearest_fixture_matches_brute_force(spark):
    inc = V.clean(spark, SF001)
    sites = fx.sites(spark, SF001)
    got = {r.inc_id: r.nearest_site for r in nearest_site(inc, sites).select("inc_id", "nearest_site").collect()}
    sl = [(r.site_id, r.site_name, r.site_lat, r.site_lon) for r in sites.collect()]
    for r in inc.select("inc_id", "lat", "lon").collect():
        best = min((_hav(r.lat, r.lon, a, b), n, k) for k, n, a, b in sl)
        assert got[r.inc_id] == best[2]


def test_probe_union_equals_range_join(spark):
    j = V.joined(spark, SF001).select("inc_id", "nearest_site", "fire_date", "temp_mean_30d", "precip_total_30d",
                                      "dry_days_30d", "temp_range_7d")
    obs = fx.daily_obs(spark, SF001)
    f = j.where(F.col("fire_date").isNotNull()).alias("f")
    o = obs.alias("o")
    cond = ((F.col("o.site_id") == F.col("f.nearest_site")) & (F.col("o.obs_date") < F.col("f.fire_date"))
            & (F.col("o.obs_date") >= F.date_sub(F.col("f.fire_date"), 30)))
    brute = (f.join(o, cond).groupBy("f.inc_id")
              .agg(F.count(F.lit(1)).alias("n"), F.avg("o.temp_mean").alias("m"),
                   F.coalesce(F.sum("o.precip"), F.lit(0.0)).alias("p"),
                   F.sum(F.when(F.coalesce(F.col("o.precip"), F.lit(0.0)) == 0, 1).otherwise(0)).alias("d")))
    want = {r.inc_id: r for r in brute.collect()}
    for r in j.collect():
        b = want.get(r.inc_id)
        if b is None or b.n < 15:
            assert r.precip_total_30d is None
        else:
            assert abs(r.precip_total_30d - b.p) < 1e-9 and r.dry_days_30d == b.d
            assert (r.temp_mean_30d is None and b.m is None) or abs(r.temp_mean_30d - b.m) < 1e-9


def test_two_level_prefix_equals_single_window(spark):
    rnd = random.Random(1)
    rows = [(g, float(rnd.randint(0, 500)), i, float(rnd.randint(0, 9))) for i, g in
            enumerate(rnd.choice("abc") for _ in range(3000))]
    df = spark.createDataFrame(rows, "g string, s double, i long, v double")
    got = prefix_sums(df, "s", ["v"], ["g"], tiebreak=["i"], n_blocks=16)
    w = Window.partitionBy("g").orderBy("s", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("want", F.sum("v").over(w))
    bad = got.join(want, ["g", "s", "i", "v"]).where(F.col("cum_v") != F.col("want")).count()
    assert bad == 0 and got.count() == 3000


def test_rank_rows_descending(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "i long, s double")
    r = rank_rows(df, "s", tiebreak=["i"], descending=True, n_blocks=4).orderBy("rank").collect()
    assert [x.rank for x in r] == list(range(1, 201))
    assert all(r[k].s >= r[k + 1].s for k in range(199))


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    vals = rnd.exponential(10, 997).round(2)
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "v double, g int")
    got = {r.p: r.q for r in exact_quantiles(df, "v", [0.025, 0.5, 0.9, 0.975]).collect()}
    for p, q in got.items():
        assert abs(q - np.percentile(vals, p * 100)) < 1e-9
    grouped = {(r.g, r.p): r.q for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    for g in range(3):
        assert abs(grouped[(g, 0.5)] - np.median(vals[np.arange(len(vals)) % 3 == g])) < 1e-9


def _auc_brute(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_ap_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    auc = M.roc_auc(df).first().roc_auc
    assert abs(auc - _auc_brute(*zip(*rows))) < 1e-12
    neg = M.roc_auc(df.withColumn("score", -F.col("score"))).first().roc_auc
    assert abs(auc + neg - 1) < 1e-12
    mono = M.roc_auc(df.withColumn("score", F.exp(F.col("score") * 3))).first().roc_auc
    assert abs(mono - auc) < 1e-12
    # step-sum average precision
    P = sum(l for l, _ in rows)
    ap = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for l, s in rows if s >= t and l == 1)
        fp = sum(1 for l, s in rows if s >= t and l == 0)
        ap += sum(1 for l, s in rows if s == t and l == 1) / P * tp / (tp + fp)
    assert abs(M.average_precision(df).first().average_precision - ap) < 1e-12


def test_crosstab_totals_equal_rows(spark):
    c = V.clean(spark, SF001)
    tab = crosstab(c, "mo").agg(F.sum("natural").alias("a"), F.sum("human").alias("b")).first()
    assert tab.a + tab.b == c.count()


def test_folds_partition_rows_and_split_sizes(spark):
    s = fx.scored(spark, SF001)
    n = s.count()
    folds = RS.stratified_folds(s)
    assert folds.select("id").distinct().count() == n
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2
    split = RS.stratified_split(s)
    assert split.where("split = 'test'").count() == math.ceil(0.2 * n)


def test_flag_smallest_is_exact(spark):
    df = spark.createDataFrame([(i % 3, i, (i * 7919) % 1000003) for i in range(3000)], "g int, id long, h long")
    df = df.withColumn("k", F.when(F.col("g") == 0, 10).when(F.col("g") == 1, 999).otherwise(0))
    out = RS.flag_smallest(df, ["g"], "h", "id", "k", n_buckets=64)
    got = {r.g: r.n for r in out.where("selected").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got.get(0) == 10 and got.get(1) == 999 and got.get(2) is None
    rows = sorted((r.h, r.id) for r in df.where("g = 0").collect())[:10]
    chosen = sorted((r.h, r.id) for r in out.where("selected and g = 0").collect())
    assert rows == chosen


def test_permutation_and_bootstrap_shapes(spark):
    s = fx.scored(spark, SF001)
    p = RS.permutation_test(s, n_perm=50).first()
    assert p.n_perm == 50 and 0.4 < p.perm_mean < 0.6 and p.observed_auc > 0.9 and p.p_value == 0.0
    b = {r.metric: r for r in RS.bootstrap_ci(s, n_boot=40).collect()}
    assert set(b) == {"roc_auc", "pr_auc", "f1", "accuracy"}
    assert b["roc_auc"].ci_low <= b["roc_auc"].mean <= b["roc_auc"].ci_high


def test_text_blocks_are_balanced(spark):
    from ignis.operators.prefix import _block_index, block_bounds
    df = spark.range(400_000).select(F.format_string("k%09d", F.col("id")).alias("k"))
    bounds = block_bounds(df, "k", 40)
    sizes = [r["count"] for r in df.groupBy(_block_index(F.col("k"), bounds).alias("b")).count().collect()]
    assert len(sizes) >= 36 and max(sizes) <= 2 * 400_000 / 40


def test_many_bounds_agree_with_few(spark):
    from ignis.operators import prefix as P
    df = spark.range(2000).select((F.col("id") * 7 % 1000).alias("x"))
    bounds = list(range(1, 999, 3))
    a = df.select("x", P._case_index(F.col("x"), bounds, 0, len(bounds)).alias("b"))
    b = df.select("x", P._block_index(F.col("x"), bounds).alias("b"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_null_groups_and_labels_are_kept(spark):
    rows = [(i, None if i % 4 == 0 else i % 4 % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int")
    from ignis.operators.resample import stratified_folds, stratified_split
    folds = stratified_folds(df, k=5)
    assert folds.count() == 40 and {r["fold"]: r["count"] for r in folds.where("label is null").groupBy("fold").count().collect()} == {
        k: 2 for k in range(5)}
    split = stratified_split(df, test_frac=0.2)
    assert split.count() == 40 and split.where("label is null and split = 'test'").count() == 2
    q = {r.label: r.q for r in exact_quantiles(df.withColumn("v", F.col("id").cast("double")), "v", [0.5], ["label"]).collect()}
    assert set(q) == {None, 0, 1}


def test_draws_of_ids_that_agree_modulo_a_prime_differ(spark):
    from ignis.functions.hashing import LANES, mix_col, with_mix, with_replicate_mix
    p = LANES[0][0]
    ids = spark.createDataFrame([(5 + k * p,) for k in range(4)] + [(5 + k * LANES[1][0],) for k in range(1, 4)], "id long")
    assert ids.select(mix_col("id", 1)).distinct().count() == 7
    x = with_mix(ids, "h", "id", 3).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(50))))
    per = with_replicate_mix(x, "d", "h", "rep").groupBy("rep").agg(F.countDistinct("d").alias("n")).collect()
    assert all(r.n == 7 for r in per)


def test_nearest_at_poles_and_antimeridian(spark):
    import math
    sites = [(i, f"S{i:02d}", la, lo) for i, (la, lo) in enumerate(
        [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -179.0), (89.0, 200.0), (10.0, 10.0), (10.0, 10.0), (45.0, 359.0), (-45.0, -90.0)])]
    points = [(i, la, lo) for i, (la, lo) in enumerate(
        [(89.5, 10.0), (90.0, 0.0), (90.0, 123.0), (-90.0, 5.0), (0.0, 179.5), (0.0, -180.0), (0.0, 200.0), (44.0, 0.0), (10.0, 370.0),
         (-89.9, -179.9), (60.0, 180.0)])]
    from ignis.operators.nearest import nearest_site
    got = {r.pid: r for r in nearest_site(spark.createDataFrame(points, "pid int, lat double, lon double"),
                                          spark.createDataFrame(sites, "site_id long, site_name string, site_lat double, site_lon double")).collect()}
    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))
    for pid, la, lo in points:
        assert abs(got[pid].station_dist_km - min(km(la, lo, s[2], s[3]) for s in sites)) < 1e-6, (pid, la, lo)
    assert got[1].nearest_name == got[2].nearest_name == "S00" and got[8].nearest_name == "S05"


def test_histogram_lists_empty_bins(spark):
    from ignis.operators.stats import histogram
    df = spark.createDataFrame([("a", 0.0), ("a", 100.0), ("b", 5.0), (None, 1.0), (None, 2.0)], "g string, x double")
    rows = histogram(df, "x", 50, "g").collect()
    assert len(rows) == 150 and sum(r.n for r in rows) == 5
    assert sum(r.n == 0 for r in rows if r.g == "a") == 48
    assert len(histogram(df.where("x < 0"), "x", 50).collect()) == 0


def test_bootstrap_with_a_hot_score(spark):
    from ignis.operators.resample import bootstrap_ci
    rows = [(i, i % 2, 0.5 if i % 3 == 0 else (i * 37 % 1000) / 1000.0, int(i % 5 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, label int, score double, pred int")
    a = {r.metric: (r.mean, r.ci_low, r.ci_high) for r in bootstrap_ci(df, n_boot=30, n_blocks=16).collect()}
    b = {r.metric: (r.mean, r.ci_low, r.ci_high) for r in bootstrap_ci(df, n_boot=30, n_blocks=1).collect()}
    assert a.keys() == b.keys()
    for m in a:
        assert all(abs(x - y) < 1e-9 for x, y in zip(a[m], b[m]))


def test_bootstrap_in_turns(spark, monkeypatch):
    from ignis.operators import resample as RS
    rows = [(i, i % 2, (i * 37 % 100) / 100.0, int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, score double, pred int")
    whole = sorted(RS.bootstrap_ci(df, n_boot=20, n_blocks=4).collect())
    monkeypatch.setattr(RS, "OFFSET_ROWS", 40)
    turns = sorted(RS.bootstrap_ci(df, n_boot=20, n_blocks=4).collect())
    assert [(r.metric, r.n_reps) for r in whole] == [(r.metric, r.n_reps) for r in turns]
    assert all(abs(a.mean - b.mean) < 1e-9 for a, b in zip(whole, turns))


def test_permutation_steps_agree(spark, monkeypatch):
    from ignis.operators import resample as RS
    rows = [(i, int(i % 3 == 0), (i * 37 % 500) / 500.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    one = RS.permutation_test(df, n_perm=20).first()
    monkeypatch.setattr(RS, "PERM_BUCKETS", 16)
    monkeypatch.setattr(RS, "PERM_RANKED", 10)
    many = RS.permutation_test(df, n_perm=20).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(one, many))


def test_large_sample_equals_top_k(spark, monkeypatch):
    from ignis.operators import resample as RS
    df = spark.range(5000)
    a = sorted(r.id for r in RS.sample_n(df, 1000).collect())
    monkeypatch.setattr(RS, "SAMPLE_TOP_K", 10)
    assert sorted(r.id for r in RS.sample_n(df, 1000).collect()) == a
