"""Draws and frames that tasks make as arrays agree with the column expressions."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from ignis.functions.hashing import ReplicateMix, mix_col, with_replicate_mix
from ignis.operators import resample as RS
from ignis.operators.climate import _antecedent, weather_features
from ignis.operators.tables import first_non_null
from ignis.sources import fixtures as fx


def test_array_draws_equal_the_column(spark):
    df = spark.range(300).select(mix_col("id", 49).alias("h")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(20))))
    rows = with_replicate_mix(df, "d", "h", "rep").collect()
    for rep in range(21):
        own = [r for r in rows if r.rep == rep]
        assert ReplicateMix(np.array([r.h for r in own])).draw(rep).tolist() == [r.d for r in own]


def test_permutation_shuffles_no_expanded_rows(spark):
    rows = [(i % 900 if i % 50 else None, int(i % 3 == 0), (i * 37 % 500) / 500.0) for i in range(1000)]
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "id long, label int, score double")
    got = RS.permutation_test(df, n_perm=12, seed=3)
    assert "explode" not in got._jdf.queryExecution().toString().lower()
    r = RS.with_mix(RS.average_ranks(df, "score"), "__id", "id", 10)
    x = with_replicate_mix(r.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(11)))), "h", "__id", "perm").collect()
    n_pos, n = df.where("label = 1").count(), df.count()
    sums = [sum(v.avg_rank for v in sorted((v for v in x if v.perm == p), key=lambda v: (v.h, v.id))[:n_pos]) for p in range(12)]
    aucs = [(s - n_pos * (n_pos + 1) / 2) / (n_pos * (n - n_pos)) for s in sums]
    assert abs(got.first().perm_mean - np.mean(aucs)) < 2e-3 and got.first().n_perm == 12  # rows of one id may swap


def test_bootstrap_cells_with_missing_labels(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2, (i * 37 % 100) / 100.0, int(i % 5 == 0)) for i in range(400)],
                               "id long, label int, score double, pred int")
    base = RS.with_mix(df, "__id", "id", 1).withColumn("__blk", (F.col("id") % 3).cast("int"))
    w = RS._weighted(base, ["__blk", "rep", "label", "pred"], 0, 9).collect()
    shape = base.select("__id", "__blk", F.col("label").cast("double").alias("y"), F.col("pred").cast("double").alias("p"))
    got = shape.mapInArrow(RS._cell_totals(0, 9), "rep int, __blk int, " + ", ".join(f"{c} double" for c in RS.CELLS)).groupBy("rep", "__blk").sum().collect()
    for r in got:
        own = [v for v in w if v.rep == r.rep and v["__blk"] == r["__blk"]]
        assert r["sum(tp)"] == sum(v.w for v in own if v.label == 1 and v.pred == 1)
        assert r["sum(__tn)"] == sum(v.w for v in own if v.label == 0)


def test_weather_of_many_groups_and_batches(spark):
    rnd, start = random.Random(5), dt.date(1969, 11, 1)
    obs = [(s, start + dt.timedelta(days=k), c, *(None if rnd.random() < 0.3 else float(rnd.randrange(9)) for _ in range(5)))
           for s in (1, 2) for k in range(120) for c in ((1, 2) if rnd.random() < 0.1 else (1,)) if rnd.random() < 0.6]
    o = spark.createDataFrame(obs, "site_id long, obs_date date, copy_no int, temp_max double, temp_min double, temp_mean double, precip double, rain double")
    p = spark.createDataFrame([(s, start + dt.timedelta(days=k)) for s in (1, 2, 3) for k in range(0, 130, 3)], "site_id long, fire_date date")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = weather_features(p, o).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * 44
    for r in got:
        for w in (7, 30):
            own = [x for x in obs if x[0] == r.site_id and 1 <= (r.fire_date - x[1]).days <= w]
            if len(own) < w // 2:
                assert r[f"dry_days_{w}d"] is None
                continue
            mean, high, low = ([x[i] for x in own if x[i] is not None] for i in (5, 3, 4))
            assert r[f"dry_days_{w}d"] == sum(not x[6] for x in own) and r[f"rain_total_{w}d"] == sum(x[7] or 0 for x in own)
            assert r[f"temp_mean_{w}d"] == (sum(mean) / len(mean) if mean else None)
            assert r[f"temp_range_{w}d"] == (max(high) - min(low) if high and low else None)
    assert callable(_antecedent((7,), ()))


def test_observation_days_are_made_after_the_join(spark):
    sf = "/root/testdata/sf0.001"
    plan = fx.daily_obs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and all("dn" not in j for j in joins)  # no day of the spine is shuffled


def test_first_value_with_a_missing_order(spark):
    df = spark.createDataFrame([("a", None, 1, 5), ("a", 0, 1, 7), ("b", 3, 1, None), ("b", 4, 1, 2)], "k string, dn int, c int, v int")
    assert {r.k: r.v for r in first_non_null(df, "k", ["v"], ["dn", "c"]).collect()} == {"a": 5, "b": 2}
