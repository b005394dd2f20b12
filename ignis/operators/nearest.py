"""Exact nearest-site join (haversine) without pairing every point with every site.

Multi-level grid search.  At level k the sphere is cut into cells of
``360 / 2**k`` degrees; each distinct point looks at its own and the 8
neighbouring cells (an equi-join on the cell key, longitude wrapping at the
antimeridian).  The best candidate is accepted only if it is no farther than
the nearest point outside the searched 3x3 block -- a lower bound that uses the
point's own latitude, because longitude degrees shrink with cos(lat).  Points
that are not yet resolved move to the next, twice coarser level.  Candidate pairs
are reduced by a partial aggregate inside the join task, so no pair row is shuffled;
a cell that holds a large share of the sites is split by AQE's skew-join handling.
Points that GRID_LEVELS levels have not resolved lie far from all sites; they go
down an adaptive tree of cells instead, best bounds first (``tree_search``).

Ties are broken by site name, then key (first in sorted station name).
Sites with missing coordinates are dropped (they would otherwise win every
argmin through NaN comparisons).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.functions.geo import EARTH_RADIUS_KM, haversine_km


def _pick_start_level(sites: DataFrame, lat: str, lon: str, sites_per_cell: float = 2.0) -> tuple[int, int]:
    """Finest level to start at, from the site count and bounding box (one tiny aggregate)."""
    row = sites.agg(F.count(F.lit(1)).alias("n"), F.min(lat).alias("a"), F.max(lat).alias("b"),
                    F.min(lon).alias("c"), F.max(lon).alias("d")).first()
    n = row["n"] or 0
    if n == 0:
        return 0, 0
    area = max((row["b"] - row["a"]) * (row["d"] - row["c"]), 1e-6)
    cell = math.sqrt(area * sites_per_cell / n)
    k = int(math.ceil(math.log2(360.0 / max(cell, 1e-6))))
    return max(0, min(k, 22)), n


def _refine_for_density(sites: DataFrame, lat: str, lon: str, k0: int, max_per_cell: int = 64,
                        extra_levels: int = 8) -> int:
    """Finest useful start level: walk from ``k0`` to finer levels until no
    cell holds more than ``max_per_cell`` sites (one aggregate over the sites,
    exploded once per candidate level).  A dense cluster -- say a third of all
    sites -- is then searched with small cells, so nearby points meet a few
    candidates instead of the whole cluster; sparse points fall through to
    coarser levels."""
    levels = list(range(k0, min(k0 + extra_levels, 22) + 1))
    lv = F.explode(F.array(*[F.lit(k) for k in levels])).alias("__k")
    cs = F.lit(360.0) / F.pow(F.lit(2.0), F.col("__k"))
    cells = (sites.select(lat, lon, lv)
                  .groupBy("__k", F.floor((F.col(lat) + 90.0) / cs).alias("__ci"),
                           F.floor((F.col(lon) + 180.0) / cs).alias("__cj"))
                  .agg(F.count(F.lit(1)).alias("__n")))
    worst = {r["__k"]: r["m"] for r in cells.groupBy("__k").agg(F.max("__n").alias("m")).collect()}
    for k in levels:
        if worst.get(k, 0) <= max_per_cell:
            return k
    return levels[-1]


def _level_search(points: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """One grid level for (plat, plon) points -> best candidate and resolution flag."""
    cs = 360.0 / (2 ** k)
    n_lon = 2 ** k
    n_lat = max(int(math.ceil(180.0 / cs)), 1)
    # latitude 90 belongs to the last row of cells; longitudes are in [-180, 180)
    row = lambda lat: F.least(F.floor((F.col(lat) + 90.0) / cs).cast("long"), F.lit(n_lat - 1))
    column = lambda lon: F.pmod(F.floor((F.col(lon) + 180.0) / cs).cast("long"), F.lit(n_lon))
    s = sites.select("__skey", "__sname", "__slat", "__slon", row("__slat").alias("__ci"), column("__slon").alias("__cj"))
    pi, pj = row("plat"), column("plon")
    offs = F.array(F.lit(-1), F.lit(0), F.lit(1))
    nb_i = F.filter(F.transform(offs, lambda o: pi + o), lambda v: (v >= 0) & (v < n_lat))
    nb_j = F.array_distinct(F.transform(offs, lambda o: F.pmod(pj + o, F.lit(n_lon))))
    p = (points.select("plat", "plon", pi.alias("__pi"), pj.alias("__pj"))
               .withColumn("__ci", F.explode(nb_i))
               .withColumn("__cj", F.explode(nb_j)))
    cand = p.join(s, ["__ci", "__cj"], "left")
    dist = haversine_km("plat", "plon", "__slat", "__slon")
    cand = cand.withColumn("__best", F.when(F.col("__skey").isNotNull(),
                                            F.struct(dist.alias("km"), F.col("__sname").alias("name"),
                                                     F.col("__skey").alias("key"))))
    best = cand.groupBy("plat", "plon").agg(F.min("__best").alias("__best"), F.first("__pi").alias("__pi"),
                                            F.first("__pj").alias("__pj"))
    # Lower bound on the distance to anything outside the searched 3x3 block.
    lat_lo = (F.col("__pi") - 1) * cs - 90.0
    lat_hi = (F.col("__pi") + 2) * cs - 90.0
    inf = F.lit(float("inf"))
    b_s = F.when(lat_lo > -90.0, F.radians(F.col("plat") - lat_lo)).otherwise(inf)
    b_n = F.when(lat_hi < 90.0, F.radians(lat_hi - F.col("plat"))).otherwise(inf)
    if 3 * cs >= 360.0:
        b_lon = inf
    else:
        west = F.col("plon") - ((F.col("__pj") - 1) * cs - 180.0)
        east = ((F.col("__pj") + 2) * cs - 180.0) - F.col("plon")
        dl = F.least(west, east, F.lit(90.0))
        b_lon = F.asin(F.cos(F.radians("plat")) * F.sin(F.radians(dl)))
    bound = F.lit(EARTH_RADIUS_KM) * F.least(b_s, b_n, b_lon)
    resolved = F.col("__best").isNotNull() & (F.col("__best.km") <= bound)
    if k == 0:
        resolved = F.col("__best").isNotNull()
    return best.select("plat", "plon", "__best", resolved.alias("__resolved"))


#: Grid levels that points are searched on before the tree, sites of a leaf cell, and levels of the tree.
GRID_LEVELS, LEAF_SITES, TREE_LEVELS = 3, 16, 22


def _box_distance(lat, lon, south, north, west, east) -> F.Column:
    """Least great-circle distance in km from a point to a box of latitudes and
    longitudes: along its own meridian where that passes the box, else to the
    nearest point of the box's two side meridians."""
    inside = F.lit(EARTH_RADIUS_KM) * F.radians(F.greatest(F.lit(0.0), south - lat, lat - north))

    def side(edge):
        turn = F.radians(lon - edge)
        foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(turn)))  # the meridian's nearest latitude
        ends = F.least(haversine_km(lat, lon, south, edge), haversine_km(lat, lon, north, edge))
        return F.when((foot >= south) & (foot <= north), haversine_km(lat, lon, foot, edge)).otherwise(ends)
    return F.when((lon >= west) & (lon <= east), inside).otherwise(F.least(side(west), side(east)))


def tree_search(points: DataFrame, sites: DataFrame) -> DataFrame:
    """plat, plon, __best (km, name, key of the nearest site) and __seen (cells and
    sites looked at) of each point, by a quadtree over the sites.

    A cell with more than LEAF_SITES sites is divided; every cell has the box of its
    sites and one of them.  Level by level, a point keeps the cells whose box is no
    farther than the nearest of the sites that cells have shown it; of the leaves
    that remain the sites are looked at.  So a point far from all sites meets a few
    cells of each level along the sites' edge, and few sites."""
    size = lambda k: F.lit(360.0) / F.pow(F.lit(2.0), k)
    k = F.col("__k")
    # latitude 90 belongs to the last row of cells; longitudes are in [-180, 180)
    top = F.greatest(F.pow(F.lit(2.0), k - 1).cast("long") - 1, F.lit(0))
    ci = F.least(F.floor((F.col("__slat") + 90.0) / size(k)).cast("long"), top)
    cj = F.floor((F.col("__slon") + 180.0) / size(k)).cast("long")
    every = sites.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(TREE_LEVELS)))).withColumn("__ci", ci).withColumn("__cj", cj)
    cell = ["__k", "__ci", "__cj"]
    cells = every.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.min("__slat").alias("__s"), F.max("__slat").alias("__nn"), F.min("__slon").alias("__w"),
                                     F.max("__slon").alias("__e"), F.min(F.struct("__slat", "__slon")).alias("__one")).checkpoint(eager=True)
    inner = (F.col("__n") > LEAF_SITES) & (k < TREE_LEVELS)
    parents = cells.where(inner).select((k + 1).alias("__k"), F.col("__ci").alias("__pi"), F.col("__cj").alias("__pj"))
    below = cells.withColumn("__pi", F.shiftright("__ci", 1)).withColumn("__pj", F.shiftright("__cj", 1))
    nodes = cells.where("__k = 1").unionByName(below.join(parents, ["__k", "__pi", "__pj"], "left_semi").select(*cells.columns))
    nodes = nodes.withColumn("__inner", inner).checkpoint(eager=True)
    roots = F.explode(F.array(*[F.struct(F.lit(0).cast("long").alias("__ci"), F.lit(j).cast("long").alias("__cj")) for j in range(2)]))
    front = points.select("plat", "plon", F.lit(float("inf")).alias("__near"), F.lit(0).cast("long").alias("__seen"), roots.alias("c")).select(
        "plat", "plon", "__near", "__seen", "c.*")
    own = Window.partitionBy("plat", "plon")
    ends = None
    for level in range(1, TREE_LEVELS + 1):
        here = front.join(nodes.where(k == level), ["__ci", "__cj"])
        here = here.withColumn("__lo", _box_distance(F.col("plat"), F.col("plon"), F.col("__s"), F.col("__nn"), F.col("__w"), F.col("__e")))
        here = here.withColumn("__hi", haversine_km("plat", "plon", "__one.__slat", "__one.__slon"))
        here = here.withColumn("__near", F.least("__near", F.min("__hi").over(own))).withColumn("__seen", F.col("__seen") + F.count(F.lit(1)).over(own))
        here = here.where(F.col("__lo") <= F.col("__near") * (1 + 1e-9) + 1e-6).select(
            "plat", "plon", "__near", "__seen", "__k", "__ci", "__cj", "__lo", "__inner").checkpoint(eager=True)
        leaves = here.where("NOT __inner").drop("__inner")
        ends = leaves if ends is None else ends.unionByName(leaves)
        open_ = here.where("__inner")
        if open_.isEmpty():
            break
        four = F.explode(F.array(*[F.struct((2 * F.col("__ci") + a).alias("i"), (2 * F.col("__cj") + b).alias("j")) for a in range(2) for b in range(2)]))
        front = open_.select("plat", "plon", "__near", "__seen", four.alias("c")).select(
            "plat", "plon", "__near", "__seen", F.col("c.i").alias("__ci"), F.col("c.j").alias("__cj"))
    least = F.min("__near").over(own)
    ends = ends.withColumn("__near", least).withColumn("__seen", F.max("__seen").over(own)).where(F.col("__lo") <= F.col("__near") * (1 + 1e-9) + 1e-6)
    held = every.join(nodes.where("NOT __inner").select(*cell), cell, "left_semi").select(*cell, "__skey", "__sname", "__slat", "__slon")
    met = ends.join(held, cell)
    found = F.struct(haversine_km("plat", "plon", "__slat", "__slon").alias("km"), F.col("__sname").alias("name"), F.col("__skey").alias("key"))
    return met.groupBy("plat", "plon").agg(F.min(found).alias("__best"), (F.max("__seen") + F.count(F.lit(1))).alias("__seen"))


def wrap_longitude(lon) -> F.Column:
    """The same meridian in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def nearest_site(points: DataFrame, sites: DataFrame, lat: str = "lat", lon: str = "lon",
                 site_key: str = "site_id", site_name: str = "site_name", site_lat: str = "site_lat",
                 site_lon: str = "site_lon", out_key: str = "nearest_site", out_name: str = "nearest_name",
                 out_km: str = "station_dist_km", start_level: int | None = None) -> DataFrame:
    """Add the nearest site (key, name) and its great-circle distance in km to
    every row of ``points``; rows with missing coordinates get NULLs.  Longitudes
    may run over any range (-180..180, 0..360).  Sites at one coordinate are one
    candidate, the one with the least (name, key); the site table is stored once,
    since every level reads it."""
    s = (sites.where(F.col(site_lat).isNotNull() & F.col(site_lon).isNotNull()
                     & ~F.isnan(site_lat) & ~F.isnan(site_lon))
              .groupBy(F.col(site_lat).cast("double").alias("__slat"),
                       wrap_longitude(F.col(site_lon).cast("double")).alias("__slon"))
              .agg(F.min(F.struct(F.col(site_name).alias("n"), F.col(site_key).alias("k"))).alias("__s"))
              .select(F.col("__s.k").alias("__skey"), F.col("__s.n").alias("__sname"), "__slat", "__slon")
              .checkpoint(eager=True))
    k0, n_sites = _pick_start_level(s, "__slat", "__slon")
    if start_level is not None:
        k0 = start_level
    elif n_sites > 0:
        k0 = _refine_for_density(s, "__slat", "__slon", k0)
    placed = (F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double"))
              & ~F.isnan(F.col(lon).cast("double")))
    wrapped = wrap_longitude(F.col(lon).cast("double"))
    coords = points.where(placed).select(F.col(lat).cast("double").alias("plat"), wrapped.alias("plon")).distinct()
    found = []
    pending = coords
    if n_sites > 0:
        for k in range(k0, max(k0 - GRID_LEVELS, -1), -1):
            level = _level_search(pending, s, k).checkpoint(eager=True)
            found.append(level.where("__resolved").select("plat", "plon", "__best"))
            pending = level.where(~F.col("__resolved")).select("plat", "plon")
            if k == 0 or pending.isEmpty():
                break
        else:  # lone points, far from all sites
            found.append(tree_search(pending, s).select("plat", "plon", "__best").checkpoint(eager=True))
    if found:
        best = found[0]
        for f in found[1:]:
            best = best.unionByName(f)
    else:
        best = coords.withColumn("__best", F.lit(None).cast("struct<km:double,name:string,key:long>"))
    best = best.select(F.col("plat").alias("__plat"), F.col("plon").alias("__plon"),
                       F.col("__best.key").alias(out_key), F.col("__best.name").alias(out_name),
                       F.col("__best.km").alias(out_km))
    # rows without coordinates take no part in the join, where they would all meet in one task
    near = points.where(placed).join(best, (F.col(lat).cast("double") == F.col("__plat")) & (wrapped == F.col("__plon")), "left")
    types = {f.name: f.dataType for f in best.schema.fields}
    nowhere = points.where(~F.coalesce(placed, F.lit(False))).select(
        "*", *[F.lit(None).cast(types[c]).alias(c) for c in (out_key, out_name, out_km)])
    return near.drop("__plat", "__plon").unionByName(nowhere)
