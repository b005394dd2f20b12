"""Day-of and antecedent-window weather features for incident probes.

Observation rows are packed before they are shuffled: a task lays the rows of a
(site, year-block) that it meets side by side, one row of arrays each, so that the
one shuffle, sort and window move packs instead of rows.  The probe days of a (site,
block) come first among its packs, as an array; the window drops the groups without,
and the tasks work out the day-of values and the antecedent frames of the probe days
alone, some groups at a time (Spark's sliding frames would add up every window of
every observation row, of which there are many more).  Groups are (site, year-block): observation rows from
the last ``max(windows)`` days of a block are copied into the next block as
context, so no group ever holds more than one block of a site, however hot the
site is.  Probe keys are deduplicated first, so a day with many incidents costs
one probe day.  No observation row meets a join on (site, block): beyond the size
that is broadcast, such a join would shuffle and sort all rows once more.

Null rules (match the reference):
* window valid only if the number of observation rows (missing values and
  duplicates included) is >= w // 2, else all six features are NULL;
* totals over only-missing values are 0, means/max stay NULL;
* a dry day is an observation row whose precipitation is missing or 0;
* the day-of values come from the first duplicate (lowest ``order_col``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_OF_MEASURES = ("temp_max", "temp_min", "temp_mean", "precip", "rain", "snow_ground", "wind_gust")
EPOCH = "1970-01-01"


def day_number(date_col: str) -> F.Column:
    return F.datediff(F.col(date_col), F.lit(EPOCH).cast("date"))


#: Measures that the antecedent frames read, (site, block) groups that a partition should hold, and rows packed at a time.
FRAME_MEASURES = ("temp_max", "temp_min", "temp_mean", "precip", "rain")
GROUPS_PER_PARTITION = 2000
ROWS_PER_PACKING = 1 << 17


def _group_starts(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rows whose (site, block) differs from that of the row before."""
    n = batch.num_rows
    site, blk = batch.column("__site"), batch.column("__blk")
    differs = pc.or_(pc.not_equal(site.slice(1), site.slice(0, n - 1)), pc.not_equal(blk.slice(1), blk.slice(0, n - 1)))
    return np.flatnonzero(differs.to_numpy(zero_copy_only=False) if isinstance(differs, pa.Array) else differs.to_numpy()) + 1


def _packed(measures: Sequence[str], block_days: int, context: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Observation rows laid side by side by (site, block), as far as a task meets
    them together; the last ``context`` days of a block also lie in the next."""
    names = ["__site", "__blk", "__dn", "__days", "__ord", *measures]

    def pack(rows: pa.Table) -> list[pa.RecordBatch]:
        rows = rows.combine_chunks()
        dn = rows.column("__dn").to_numpy().astype(np.int64)
        late = np.flatnonzero(dn % block_days >= block_days - context)
        row = np.concatenate([np.arange(len(dn)), late])
        blk = np.concatenate([dn // block_days, dn[late] // block_days + 1])
        site = rows.column("__site").combine_chunks().dictionary_encode()
        site = (site.combine_chunks() if isinstance(site, pa.ChunkedArray) else site).indices.to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((blk, site))
        row, blk, site = row[order], blk[order], site[order]
        first = np.flatnonzero(np.concatenate([[True], (blk[1:] != blk[:-1]) | (site[1:] != site[:-1])]))
        ends = pa.array(np.append(first, len(row)).astype(np.int32))
        own = rows.take(pa.array(row))
        side = [pa.ListArray.from_arrays(ends, own.column(c).combine_chunks()) for c in ("__dn", "__ord", *measures)]
        return pa.table([own.column("__site").take(pa.array(first)), pa.array(blk[first]), own.column("__dn").take(pa.array(first)), *side], names=names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS_PER_PACKING:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from pack(pa.Table.from_batches(held))
    return run


def _frame_sums(values: dict[str, tuple[np.ndarray, np.ndarray]], lo: np.ndarray, hi: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The six features over rows lo ... hi - 1 of each probe, as (value, is there),
    added up in the order of the rows.  NaN counts as the largest value."""
    n = len(lo)
    mean, known, precip, rain, dry = (np.zeros(n) for _ in range(5))
    high, n_high = np.full(n, -np.inf), np.zeros(n, np.int64)
    low, n_low, n_least = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, k = np.flatnonzero(lo < hi), 0
    while len(at):
        row = lo[at] + k
        get = lambda c: (values[c][0][row], values[c][1][row])  # noqa: B023, E731
        v, has = get("temp_mean")
        mean[at] += np.where(has, v, 0.0)
        known[at] += has
        v, has = get("precip")
        precip[at] += np.where(has, v, 0.0)
        dry[at] += ~has | (v == 0)
        v, has = get("rain")
        rain[at] += np.where(has, v, 0.0)
        v, has = get("temp_max")
        high[at] = np.maximum(high[at], np.where(has, v, -np.inf))
        n_high[at] += has
        v, has = get("temp_min")
        number = has & ~np.isnan(v)
        low[at] = np.minimum(low[at], np.where(number, v, np.inf))
        n_low[at] += has
        n_least[at] += number
        k += 1
        at = at[lo[at] + k < hi[at]]
    low = np.where(n_least > 0, low, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"temp_mean": (mean / known, known > 0), "temp_max": (high, n_high > 0), "precip_total": (precip, np.ones(n, bool)),
                "rain_total": (rain, np.ones(n, bool)), "dry_days": (dry, np.ones(n, bool)), "temp_range": (high - low, (n_high > 0) & (n_low > 0))}


FRAME_FEATURES = ("temp_mean", "temp_max", "precip_total", "rain_total", "dry_days", "temp_range")


def _side_by_side(col: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """How many values each pack has, and the values."""
    lists = col.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten()


def _antecedent(windows: Sequence[int], day_of: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The probe days with their features, from packs in order of (site, block); a
    group that ends in a later batch waits for it."""
    measures = sorted(set(day_of) | set(FRAME_MEASURES))
    names = ["__site", "__dn", *day_of, *[f"{f}_{w}d" for w in windows for f in FRAME_FEATURES]]

    def features(packs: pa.Table) -> list[pa.RecordBatch]:
        group = np.zeros(packs.num_rows, dtype=np.int64)
        group[_group_starts(packs)] = 1
        group = np.cumsum(group) << 33
        n_asked, asked_day = _side_by_side(packs.column("__asked"))
        if not len(asked_day):
            return []
        asked = np.repeat(group, n_asked) + asked_day.to_numpy(zero_copy_only=False)
        n_obs, day = _side_by_side(packs.column("__days"))
        days = np.repeat(group, n_obs) + day.to_numpy(zero_copy_only=False)
        first = _side_by_side(packs.column("__ord"))[1]
        placed = pc.is_valid(first).to_numpy(zero_copy_only=False)
        order = np.lexsort((first.to_numpy(zero_copy_only=False), ~placed, days))
        days, placed, values = days[order], placed[order], {}
        for c in measures:
            v = _side_by_side(packs.column(c))[1]
            values[c] = v.to_numpy(zero_copy_only=False)[order], pc.is_valid(v).to_numpy(zero_copy_only=False)[order]
        out = [packs.column("__site").take(pa.array(np.repeat(np.arange(packs.num_rows), n_asked))), asked_day]
        hi = np.searchsorted(days, asked, "left")
        same = np.flatnonzero(hi < len(days))
        same = same[(days[hi[same]] == asked[same]) & placed[hi[same]]]
        for c in day_of:
            own, has = np.zeros(len(asked)), np.zeros(len(asked), bool)
            own[same], has[same] = values[c][0][hi[same]], values[c][1][hi[same]]
            out.append(pa.array(own, pa.float64(), mask=~has))
        for w in windows:
            lo = np.searchsorted(days, asked - w, "left")
            ok = hi - lo >= w // 2
            lo = np.where(ok, lo, hi)
            out += [pa.array(v, pa.float64(), mask=~(has & ok)) for v, has in _frame_sums(values, lo, hi).values()]
        return pa.table(out, names=names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ends = lambda b, i: (b.column("__site")[i].as_py(), b.column("__blk")[i].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _group_starts(batch)
            new = bool(held) and ends(held[-1], held[-1].num_rows - 1) != ends(batch, 0)
            if not len(starts) and not new:
                held.append(batch)
                continue
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                held.append(batch.slice(0, cut))
            yield from features(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
        if held:
            yield from features(pa.Table.from_batches(held))
    return run


def weather_features(probes: DataFrame, obs: DataFrame, site_col: str = "site_id", date_col: str = "obs_date",
                     probe_site: str = "site_id", probe_date: str = "fire_date", order_col: str = "copy_no",
                     windows: Sequence[int] = (7, 30), block_days: int = 365,
                     day_of: Sequence[str] = DAY_OF_MEASURES) -> DataFrame:
    """Features per distinct probe key.  Output: ``probe_site``, ``probe_date``,
    day-of measures, and for each w: temp_mean_{w}d, temp_max_{w}d,
    precip_total_{w}d, rain_total_{w}d, dry_days_{w}d, temp_range_{w}d."""
    wmax = max(windows)
    if block_days < wmax:
        raise ValueError("block_days must cover the longest window")
    present = [m for m in day_of if m in obs.columns]
    measures = sorted(set(present) | set(FRAME_MEASURES))
    blk_of = F.floor(F.col("__dn") / block_days).cast("long")
    keys = (probes.select(F.col(probe_site).alias("__site"), day_number(probe_date).alias("__dn"))
                  .where(F.col("__site").isNotNull() & F.col("__dn").isNotNull()).distinct())
    asked = keys.groupBy("__site", blk_of.alias("__blk")).agg(F.collect_list("__dn").alias("__asked")).checkpoint(eager=True)
    o = obs.select(F.col(site_col).alias("__site"), day_number(date_col).alias("__dn"),
                   F.col(order_col).cast("double").alias("__ord"), *[F.col(m).cast("double").alias(m) for m in measures])
    o = o.where(F.col("__site").isNotNull() & F.col("__dn").isNotNull())
    # a site that no probe asks for is left out before its observations are made, where they are derived
    o = o.join(asked.select("__site").distinct(), "__site", "left_semi")
    site_type = o.schema["__site"].dataType.simpleString()
    lists = {"__days": "array<int>", "__ord": "array<double>", **{m: "array<double>" for m in measures}}
    o = o.mapInArrow(_packed(tuple(measures), block_days, wmax), f"__site {site_type}, __blk long, __dn int, " + ", ".join(f"{c} {t}" for c, t in lists.items()))
    p = asked.select("__site", "__blk", F.lit(None).cast("int").alias("__dn"), *[F.lit(None).cast(t).alias(c) for c, t in lists.items()], "__asked")
    shuffles = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = o.withColumn("__asked", F.lit(None).cast("array<int>")).unionByName(p)
    u = u.repartition(max(shuffles, -(-asked.count() // GROUPS_PER_PARTITION)), "__site", "__blk")
    # the probe days, which have no first day, come first: a group without them is dropped
    upto = Window.partitionBy("__site", "__blk").orderBy("__dn")
    rows = u.withColumn("__probed", F.count("__asked").over(upto)).where("__probed > 0").drop("__probed")
    rows = rows.sortWithinPartitions("__site", "__blk", "__dn")  # as the window has them
    doubles = [*present, *[f"{f}_{w}d" for w in windows for f in FRAME_FEATURES]]
    out = rows.mapInArrow(_antecedent(tuple(windows), tuple(present)), f"__site {site_type}, __dn int, " + ", ".join(f"{c} double" for c in doubles))
    return out.select(F.col("__site").alias(probe_site),
                      F.date_add(F.lit(EPOCH).cast("date"), F.col("__dn").cast("int")).alias(probe_date), *doubles)


def attach_weather(incidents: DataFrame, obs: DataFrame, site_col: str = "nearest_site",
                   date_col: str = "fire_date", **kw) -> DataFrame:
    """Left-join the per-key features back onto every incident (J2-J4)."""
    feats = weather_features(incidents, obs, probe_site=site_col, probe_date=date_col, **kw)
    return incidents.join(feats, [site_col, date_col], "left")
