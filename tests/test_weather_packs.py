"""The weather step: one shuffle of packed rows, the same values wherever rows lie."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ignis.operators.climate import weather_features
from ignis.sources import fixtures as fx

OBS = ("site_id string, obs_date date, copy_no int, temp_max double, temp_min double, temp_mean double, "
       "precip double, rain double, snow_ground double, wind_gust double")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(seed: int = 5) -> list[tuple]:
    rng, start = random.Random(seed), date(1968, 6, 1)
    value = lambda: None if rng.random() < 0.3 else float(rng.randint(-20, 40))
    rows = []
    for site in ("a", "b", "c"):
        for d in range(800):
            if rng.random() < 0.7:
                copies = [None] if d % 50 == 7 else rng.sample([1, 2, 3], rng.choice([1, 1, 2]))
                rows += [(site, start + timedelta(days=d), c, *[value() for _ in range(7)]) for c in copies]
    rows.append((None, start, 1, *[1.0] * 7))
    rng.shuffle(rows)
    return rows


def _wanted(rows: list[tuple], site: str, day: date) -> tuple:
    own = sorted((r for r in rows if r[0] == site and r[1] == day and r[2] is not None), key=lambda r: r[2])
    out = list(own[0][3:]) if own else [None] * 7
    for w in (7, 30):
        near = [r for r in rows if r[0] == site and day - timedelta(days=w) <= r[1] < day]
        if len(near) < w // 2:
            out += [None] * 6
            continue
        known = lambda i: [r[i] for r in near if r[i] is not None]  # noqa: E731, B023
        high, low, mean = known(3), known(4), known(5)
        out += [sum(mean) / len(mean) if mean else None, max(high) if high else None, sum(known(6)), sum(known(7)),
                float(sum(r[6] is None or r[6] == 0 for r in near)), max(high) - min(low) if high and low else None]
    return tuple(out)


def test_scattered_rows_give_the_same_features(spark):
    rows = _rows()
    obs = spark.createDataFrame(rows, OBS).repartition(7)
    days = [date(1968, 6, 1) + timedelta(days=d) for d in range(0, 830, 3)]
    keys = [(s, d) for s in ("a", "b", "z") for d in days] + [("a", None), (None, days[0]), ("a", days[0])]
    got = {(r["site_id"], r["fire_date"]): tuple(r)[2:] for r in weather_features(
        spark.createDataFrame(keys, "site_id string, fire_date date"), obs).collect()}
    assert set(got) == {k for k in keys if None not in k}
    for (site, day), values in got.items():
        wanted = _wanted(rows, site, day)
        assert len(values) == len(wanted)
        for v, x in zip(values, wanted):
            assert (v is None) == (x is None) and (v is None or abs(v - x) < 1e-9), (site, day, values, wanted)


@pytest.fixture
def no_broadcast(spark):
    """Joins as where nothing is small enough to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_observation_rows_meet_no_window_frame_and_no_join_on_blocks(spark, no_broadcast):
    probes = spark.createDataFrame([("a", date(1969, 1, 1))], "site_id string, fire_date date")
    plan = _plan(weather_features(probes, spark.createDataFrame(_rows(), OBS)))
    assert "min_by" not in plan  # the window over packs only tells which groups are asked for
    assert not [line for line in plan.splitlines() if "Join" in line and "__blk" in line]


def test_lineitem_is_shuffled_once_and_days_alone_read_no_other_measure(spark, no_broadcast):
    obs = fx.daily_obs(spark, SF001)
    assert _plan(obs).count("Exchange hashpartitioning") == 2  # the sites' years, and lineitem
    assert "l_tax" not in _plan(obs.select("site_name", "site_lat", "dn", "copy_no"))


def test_days_with_and_without_lineitem_rows(spark, tmp_path):
    """Rows outside the calendar, without site or day or with missing quantities."""
    from datetime import datetime
    spark.createDataFrame([(1, "s1"), (2, "s2")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    li = [(1, datetime(1995, 1, 3), 7.0, 0.1, 0.02), (1, datetime(1995, 1, 3), 9.0, 0.05, 0.0), (1, datetime(1996, 6, 1), None, 0.1, 0.1),
          (1, datetime(1990, 1, 1), 1.0, 0.1, 0.1), (None, datetime(1995, 1, 3), 1.0, 0.1, 0.1), (2, None, 1.0, 0.1, 0.1), (9, datetime(1995, 1, 3), 1.0, 0.1, 0.1)]
    spark.createDataFrame(li, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_discount double, l_tax double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    obs = fx.daily_obs(spark, str(tmp_path))
    got = {(r["site_id"], r["dn"], r["copy_no"]): r for r in obs.collect()}
    assert obs.count() == len(got)
    masked = {(s, d) for s in (1, 2) for d in range(2557) if (s * 7 + d) % 40 < 22}
    assert {k[:2] for k in got} == masked | {(1, 2)}
    r = got[1, 2, 1]
    assert (r["temp_max"], r["temp_min"], r["temp_mean"], r["precip"], r["rain"]) == (-1.0, -13.0, -7.0, 15.0, 2.0)
    assert obs.where(F.col("temp_max").isNotNull()).select("site_id", "dn").distinct().count() == 1
    assert {(r["site_id"], r["dn"]) for r in obs.where(F.col("rain").isNotNull()).collect()} == {(1, 2)} | ({(1, 517)} & masked)
