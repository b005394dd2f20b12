"""DuckDB oracle SQL for the registered queries.

The fixture views are rebuilt in SQL with the same arithmetic as
``ignis.sources.fixtures``; each query is then written the plain, brute-force
way (all incident x site pairs for the nearest site, a range join for the
antecedent windows, unpartitioned window functions for rankings), which is
what makes it an independent check of the Spark plans.
"""

from __future__ import annotations

from ignis.plans.views import CORE_FEATURES, FEATURE_COLS, FEATURE_GROUPS, FEATURE_LABELS, FIXED_TREES, PDP_FEATURES

SEED = 42

# Fixed values, written out here so that a slip in the library shows.
STATION_PERIOD = (1996, 2000)
WINDOW_COLS = {
    7: ["temp_mean_7d", "temp_max_7d", "precip_total_7d", "rain_total_7d", "dry_days_7d", "temp_range_7d"],
    30: ["temp_mean_30d", "temp_max_30d", "precip_total_30d", "rain_total_30d", "dry_days_30d", "temp_range_30d"],
}
CLIMATE_CORR_COLS = [
    "temp_max", "temp_min", "temp_mean", "precip", "rain", "diurnal_range", "temp_mean_7d", "precip_total_7d",
    "dry_days_7d", "temp_mean_30d", "precip_total_30d", "dry_days_30d", "temp_anomaly", "fire_weather_index",
]
CALIBRATION_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
POISSON1_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.999916758850712, 0.9999897508033254, 0.9999988747974021, 0.9999998885745217,
    0.9999999899522337, 0.9999999991683893,
]


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2*6371e0*asin(sqrt(least(1e0, pow(sin((radians({lat2})-radians({lat1}))/2),2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2))))")


def _frac_sqrt_sql(h: str) -> str:
    return (f"cast(floor((sqrt(cast({h} AS double) + 0.5e0) - floor(sqrt(cast({h} AS double) + 0.5e0)))"
            " * 2147483648e0) AS bigint)")


def _lane_sql(x: str, seed: str | int, p: int, a1: int, b1: int, s1: int, a3: int, b3: int) -> str:
    h = (f"(((cast({x} AS bigint) % {p} + {p}) % {p}) * {a1} "
         f"+ ((cast({seed} AS bigint) % {p} + {p}) % {p}) * {s1} + {b1}) % {p}")
    return _frac_sqrt_sql(f"(({_frac_sqrt_sql(h)}) * {a3} + {b3}) % {p}")


def mix_sql(x: str, seed: str | int = 0) -> str:
    """The 62-bit hash."""
    hi = _lane_sql(x, seed, 2147483647, 1103515245, 12345, 40503, 48271, 2654435)
    lo = _lane_sql(x, seed, 2147483629, 1140671485, 12820163, 69069, 69621, 1013904)
    return f"({hi} * 2147483648 + {lo})"


def replicate_sql(h: str, rep: str) -> str:
    """The 31-bit draw of a replicate from a row's hash."""
    p = 2147483647
    rep_mix = f"((cast({rep} AS bigint) * 1597334677 + 1099087573) % {p})"
    mixed = f"((({h} // 2147483648) % {p}) * {rep_mix} + (({h} % 2147483648) % {p}) * 747796405 + 12345) % {p}"
    return _frac_sqrt_sql(f"(({_frac_sqrt_sql(mixed)}) * 48271 + 2654435) % {p}")


def R(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0e0)"


def dbl(v: float) -> str:
    s = repr(float(v))
    return s if ("e" in s or "inf" in s or "nan" in s) else s + "e0"


_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    _CTE[name] = (deps, sql)


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _CTE[n][0]:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order) + "\n"


cte("incidents", (), """
SELECT o.o_orderkey AS inc_id,
       cast(year(o.o_orderdate) AS int) AS yr,
       CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE cast(month(o.o_orderdate) AS int) END AS mo,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 31 ELSE cast(day(o.o_orderdate) AS int) END AS dy,
       CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'U'
            WHEN (month(o.o_orderdate) BETWEEN 5 AND 10 AND (o.o_custkey * 91) % 8500 < 5500) <> (o.o_orderkey % 13 = 0) THEN 'N'
            WHEN o.o_orderpriority = '2-HIGH' THEN 'H-PB' ELSE 'H' END AS cause,
       CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE n.n_name END AS agency,
       CASE WHEN o.o_orderkey % 59 = 0 THEN NULL ELSE 42e0 + ((o.o_custkey * 37) % 1800) / 100e0 END AS lat,
       -140e0 + ((o.o_custkey * 91) % 8500) / 100e0 AS lon,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_totalprice / 1e3 END AS size_ha,
       o.o_totalprice / 1.1e3 AS calc_ha
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")

cte("clean", ("incidents",), """
SELECT *, CASE WHEN cause = 'N' THEN 0 ELSE 1 END AS target FROM incidents
WHERE cause IN ('N', 'H', 'H-PB') AND yr BETWEEN 1972 AND 2024 AND lat IS NOT NULL AND lon IS NOT NULL
  AND mo BETWEEN 1 AND 12""")

cte("sized", ("incidents",), """
SELECT *, coalesce(size_ha, calc_ha) AS fire_size,
       CASE WHEN size_ha < 0 THEN ln(1e0) WHEN size_ha > -1 THEN ln(1 + size_ha) END AS log_size,
       CASE WHEN coalesce(size_ha, calc_ha) > -1 THEN ln(1 + coalesce(size_ha, calc_ha)) END AS log_size_fallback,
       CASE WHEN coalesce(size_ha, calc_ha) > 0 THEN log10(coalesce(size_ha, calc_ha)) END AS log10_size
FROM incidents""")

cte("sites", (), """
SELECT s_suppkey AS site_id, s_name AS site_name,
       42e0 + ((s_suppkey * 53) % 1800) / 100e0 AS site_lat,
       -140e0 + ((s_suppkey * 577) % 8500) / 100e0 AS site_lon
FROM supplier""")

cte("li_day", (), """
SELECT l_suppkey AS site_id, datediff('day', DATE '1995-01-01', cast(l_shipdate AS date)) AS dn,
       max(l_quantity) - 10e0 AS temp_max, min(l_quantity) - 20e0 AS temp_min, avg(l_quantity) - 15e0 AS temp_mean,
       round(sum(l_discount) * 1e2, 2) AS precip, round(sum(l_tax) * 1e2, 2) AS rain
FROM lineitem GROUP BY 1, 2""")

cte("obs_base", ("sites", "li_day"), """
SELECT sp.site_id, sp.site_name, 'C' || cast(sp.site_id AS varchar) AS climate_id,
       CASE WHEN (sp.site_id + sp.dn) % 13 = 0 THEN NULL ELSE sp.site_lat END AS site_lat, sp.site_lon,
       DATE '1995-01-01' + cast(sp.dn AS int) AS obs_date, cast(sp.dn AS int) AS dn, 1 AS copy_no,
       l.temp_max, l.temp_min, l.temp_mean, l.precip, l.rain,
       CASE WHEN (sp.site_id + sp.dn) % 8 = 0 THEN (sp.dn % 30) * 1e0 END AS snow_ground,
       CASE WHEN (sp.site_id + sp.dn) % 9 = 0 THEN 30e0 + (sp.dn % 50) END AS wind_gust
FROM (SELECT s.*, r.dn FROM sites s CROSS JOIN
        (SELECT range AS dn FROM range(0, datediff('day', DATE '1995-01-01', DATE '2001-12-31') + 1)) r) sp
LEFT JOIN li_day l ON l.site_id = sp.site_id AND l.dn = sp.dn
WHERE (sp.site_id * 7 + sp.dn) % 40 < 22 OR l.site_id IS NOT NULL""")

cte("daily_obs", ("obs_base",), """
SELECT * FROM obs_base
UNION ALL
SELECT site_id, site_name, climate_id, site_lat, site_lon, obs_date, dn, 2 AS copy_no, temp_max, temp_min,
       temp_mean, precip + 1e0 AS precip, rain, snow_ground, wind_gust
FROM obs_base WHERE (site_id + dn) % 97 = 0""")

_HAV = haversine_sql("c.lat", "c.lon", "s.site_lat", "s.site_lon")
cte("nearest", ("clean", "sites"), f"""
SELECT inc_id, site_id AS nearest_site, site_name AS nearest_name, km AS station_dist_km FROM (
  SELECT c.inc_id, s.site_id, s.site_name, {_HAV} AS km
  FROM clean c CROSS JOIN sites s WHERE s.site_lat IS NOT NULL AND s.site_lon IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY inc_id ORDER BY km, site_name, site_id) = 1""")

cte("fire", ("clean", "nearest"), """
SELECT c.*, n.nearest_site, n.nearest_name, n.station_dist_km,
       try_cast(c.yr || '-' || c.mo || '-' || c.dy AS date) AS fire_date
FROM clean c JOIN nearest n ON c.inc_id = n.inc_id""")

cte("day_of", ("fire", "daily_obs"), """
SELECT f.inc_id, o.temp_max, o.temp_min, o.temp_mean, o.precip, o.rain, o.snow_ground, o.wind_gust
FROM fire f JOIN daily_obs o ON o.site_id = f.nearest_site AND o.obs_date = f.fire_date
QUALIFY row_number() OVER (PARTITION BY f.inc_id ORDER BY o.copy_no) = 1""")

for _w in (7, 30):
    cte(f"win{_w}", ("fire", "daily_obs"), f"""
SELECT f.inc_id, count(*) AS n, avg(o.temp_mean) AS tm, max(o.temp_max) AS tx,
       coalesce(sum(o.precip), 0e0) AS pt, coalesce(sum(o.rain), 0e0) AS rt,
       sum(CASE WHEN coalesce(o.precip, 0e0) = 0 THEN 1 ELSE 0 END) AS dd,
       max(o.temp_max) - min(o.temp_min) AS tr
FROM fire f JOIN daily_obs o ON o.site_id = f.nearest_site
  AND o.obs_date BETWEEN f.fire_date - {_w} AND f.fire_date - 1
GROUP BY f.inc_id""")


def _wcols(w: int, alias: str) -> str:
    g = f"{alias}.n >= {w // 2}"
    return ", ".join([
        f"CASE WHEN {g} THEN {alias}.tm END AS temp_mean_{w}d",
        f"CASE WHEN {g} THEN {alias}.tx END AS temp_max_{w}d",
        f"CASE WHEN {g} THEN {alias}.pt END AS precip_total_{w}d",
        f"CASE WHEN {g} THEN {alias}.rt END AS rain_total_{w}d",
        f"CASE WHEN {g} THEN cast({alias}.dd AS double) END AS dry_days_{w}d",
        f"CASE WHEN {g} THEN {alias}.tr END AS temp_range_{w}d"])


cte("joined", ("fire", "day_of", "win7", "win30"), f"""
SELECT f.*, d.temp_max, d.temp_min, d.temp_mean, d.precip, d.rain, d.snow_ground, d.wind_gust,
       {_wcols(7, 'w7')}, {_wcols(30, 'w30')}
FROM fire f LEFT JOIN day_of d ON d.inc_id = f.inc_id LEFT JOIN win7 w7 ON w7.inc_id = f.inc_id
LEFT JOIN win30 w30 ON w30.inc_id = f.inc_id""")

_DATE = "try_cast(yr || '-' || mo || '-' || dy AS date)"
_DOY2000 = "cast(dayofyear(try_cast('2000-' || mo || '-' || dy AS date)) AS int)"

cte("prov_dict", ("clean",), """
SELECT agency, cast(row_number() OVER (ORDER BY agency) - 1 AS int) AS province_code
FROM (SELECT DISTINCT agency FROM clean WHERE agency IS NOT NULL)""")

cte("features", ("joined", "prov_dict"), f"""
SELECT j.*, j.temp_max - j.temp_min AS diurnal_range, j.temp_mean - j.temp_mean_30d AS temp_anomaly,
       coalesce(j.temp_max, 0e0) - coalesce(j.precip, 0e0) * 2 + coalesce(j.wind_gust, 0e0) * 0.5 AS fire_weather_index,
       j.station_dist_km AS station_dist,
       {_DOY2000} AS doy,
       sin(2 * pi() * {_DOY2000} / 365e0) AS doy_sin, cos(2 * pi() * {_DOY2000} / 365e0) AS doy_cos,
       cast(isodow({_DATE}) - 1 AS int) AS dow,
       CASE WHEN isodow({_DATE}) - 1 >= 5 THEN 1e0 ELSE 0e0 END AS is_weekend,
       j.mo AS month, j.yr AS year, p.province_code,
       CASE WHEN j.size_ha < 0 THEN ln(1e0) WHEN j.size_ha > -1 THEN ln(1 + j.size_ha) END AS log_size,
       j.lat AS latitude, j.lon AS longitude
FROM joined j LEFT JOIN prov_dict p ON j.agency = p.agency""")

_core = " AND ".join(f"{c} IS NOT NULL" for c in CORE_FEATURES + ["target"])
cte("model", ("features",), "SELECT inc_id, target, " + ", ".join(
    f"coalesce(cast({c} AS double), -999e0) AS {c}" for c in FEATURE_COLS) + f" FROM features WHERE {_core}")
cte("model_raw", ("features",), "SELECT inc_id, target, " + ", ".join(
    f"cast({c} AS double) AS {c}" for c in FEATURE_COLS) + f" FROM features WHERE {_core}")

cte("scored", ("incidents",), """
SELECT id, label, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
  SELECT inc_id AS id, CASE WHEN cause = 'N' THEN 0 ELSE 1 END AS label,
         (100 + 350 * (CASE WHEN cause = 'N' THEN 0 ELSE 1 END) + (inc_id * 7919) % 500) / 1e3 AS score
  FROM incidents WHERE cause <> 'U')""")

cte("score_cum", ("scored",), """
SELECT score, pos, neg,
       sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
       sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg,
       sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg
FROM (SELECT score, sum(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END) AS pos,
             sum(CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END) AS neg FROM scored GROUP BY score)""")

cte("cm", ("scored",), """
SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
FROM scored""")


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN cast({a} AS double) / ({b}) ELSE 0e0 END)"


def _metric_exprs(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, str]:
    tn, fp, fn, tp = (f"cast({x} AS double)" for x in (tn, fp, fn, tp))
    prec = _ratio(tp, f"{tp} + {fp}")
    rec = _ratio(tp, f"{tp} + {fn}")
    den = f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    return {"accuracy": _ratio(f"{tp} + {tn}", f"{tp} + {tn} + {fp} + {fn}"), "precision": prec, "recall": rec,
            "f1": _ratio(f"2 * {prec} * {rec}", f"{prec} + {rec}"), "specificity": _ratio(tn, f"{tn} + {fp}"),
            "mcc": _ratio(f"{tp} * {tn} - {fp} * {fn}", den)}


_AUC = "1 - sum(pos * cneg - 0.5 * pos * neg) / (sum(pos) * sum(neg))"
_AP = "sum(CASE WHEN cpos + cneg > 0 THEN pos * cpos / (cpos + cneg) ELSE 0e0 END) / sum(pos)"

_INC_COLS = "inc_id, yr, mo, dy, cause, agency, " + ", ".join(f"{R(c)} AS {c}" for c in ("lat", "lon", "size_ha", "calc_ha"))


def _sel(cols, src: str, keep=()) -> str:
    parts = [c for c in keep] + [f"{R(c)} AS {c}" for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"


def _crosstab(key: str, src: str, where: str = "") -> str:
    w = f"WHERE {key} IS NOT NULL" + (f" AND {where}" if where else "")
    return (f"SELECT {key}, count(*) FILTER (WHERE target = 0) AS \"natural\", count(*) FILTER (WHERE target = 1) AS human "
            f"FROM {src} {w} GROUP BY {key}")


_CLEAN_T = (f"(SELECT *, cast(isodow({_DATE}) - 1 AS int) AS dow, cast(floor(yr / 10) * 10 AS int) AS decade "
            f"FROM clean)")


def _pct(key: str, tab: str, order: bool) -> str:
    s = (f"SELECT {key}, {R('"natural" * 100e0 / ("natural" + human)')} AS natural_pct, "
         f"{R('human * 100e0 / ("natural" + human)')} AS human_pct FROM ({tab})")
    return s


def _yearly(rounded: bool = True) -> str:
    def b(x):
        return f"round_even({x}, 1)"
    return (f"SELECT yr, count(fire_size) AS num_fires, {b('coalesce(sum(fire_size), 0e0)')} AS total_area, "
            f"{b('avg(fire_size)')} AS mean_size, {b('quantile_cont(fire_size, 0.5)')} AS median_size, "
            f"{b('max(fire_size)')} AS max_size FROM sized WHERE yr IS NOT NULL GROUP BY yr "
            f"HAVING yr BETWEEN 1980 AND 2024")


def _trend() -> str:
    parts = []
    for y in ("num_fires", "total_area"):
        yy, xx = f"cast({y} AS double)", "cast(yr AS double)"
        r = f"corr({xx}, {yy})"
        se = f"CASE WHEN count(*) > 2 THEN sqrt((1e0 - {r} * {r}) * var_pop({yy}) / var_pop({xx}) / (count(*) - 2)) END"
        parts.append(f"SELECT '{y}' AS target, count(*) AS n, {R(f'regr_slope({yy}, {xx})')} AS slope, "
                     f"{R(f'regr_intercept({yy}, {xx})')} AS intercept, {R(r)} AS r_value, {R(f'{r} * {r}')} AS r2, "
                     f"{R(se)} AS stderr FROM ys")
    return with_("sized") + f", ys AS (SELECT * FROM ({_yearly()}) WHERE num_fires > 10)\n" + " UNION ALL ".join(parts)


def _trend_p() -> str:
    """The t test's p-value as a finite sum (whole degrees of freedom)."""
    return f"""
WITH RECURSIVE tr AS ({_trend_raw()}),
a AS (SELECT *, n - 2 AS v, atan(abs(r_value) * sqrt((n - 2) / greatest((1e0 - r_value) * (1e0 + r_value), 1e-300)) / sqrt(cast(n - 2 AS double))) AS th FROM tr),
terms(target, k, term) AS (
  SELECT target, 0, 1e0 FROM a WHERE (v - v % 2) / 2 >= 1
  UNION ALL
  SELECT t.target, t.k + 1, t.term * pow(cos(a.th), 2) * (2 * (t.k + 1) - 1 + a.v % 2) / (2 * (t.k + 1) + a.v % 2)
  FROM terms t JOIN a USING (target) WHERE t.k + 1 <= (a.v - a.v % 2) // 2 - 1),
s AS (SELECT target, sum(term) AS total FROM terms GROUP BY target),
p AS (SELECT a.*, CASE WHEN v >= 1 THEN greatest(0e0, 1e0 - CASE WHEN v % 2 = 1
        THEN 2e0 / pi() * (th + sin(th) * cos(th) * coalesce(s.total, 0e0)) ELSE sin(th) * coalesce(s.total, 0e0) END) END AS p_value
      FROM a LEFT JOIN s USING (target))
SELECT target, n, {R('slope')} AS slope, {R('intercept')} AS intercept, {R('r_value')} AS r_value, {R('r2')} AS r2,
       {R('stderr')} AS stderr, {R('p_value')} AS p_value, p_value < 0.05 AS significant FROM p"""


def _trend_raw() -> str:
    parts = []
    for y in ("num_fires", "total_area"):
        yy, xx = f"cast({y} AS double)", "cast(yr AS double)"
        r = f"corr({xx}, {yy})"
        parts.append(f"SELECT '{y}' AS target, count(*) AS n, regr_slope({yy}, {xx}) AS slope, regr_intercept({yy}, {xx}) AS intercept, "
                     f"{r} AS r_value, {r} * {r} AS r2, CASE WHEN count(*) > 2 THEN sqrt((1e0 - {r} * {r}) * var_pop({yy}) / var_pop({xx}) / (count(*) - 2)) END AS stderr FROM ys")
    return with_("sized") + f", ys AS (SELECT * FROM ({_yearly()}) WHERE num_fires > 10)\n" + " UNION ALL ".join(parts)


def _older_rows() -> str:
    doy = f"CASE WHEN yr IS NOT NULL AND mo BETWEEN 1 AND 12 AND dy BETWEEN 1 AND 31 THEN {_DOY2000} END"
    return with_("sized") + f"""
, o AS (SELECT *, coalesce(agency, 'Unknown') AS ag, {doy} AS doy FROM sized WHERE cause IN ('N', 'H', 'H-PB'))
, d AS (SELECT ag, row_number() OVER (ORDER BY ag) - 1 AS region_code FROM (SELECT DISTINCT ag FROM o))
, m AS (SELECT inc_id AS id, cast(mo AS double) AS month, cast(doy AS double) AS doy, sin(2 * pi() * doy / 365e0) AS doy_sin,
               cos(2 * pi() * doy / 365e0) AS doy_cos, cast(region_code AS double) AS region_code, log_size_fallback AS log_size,
               cast(yr AS double) AS year FROM o JOIN d USING (ag))
, k AS (SELECT * FROM m WHERE month IS NOT NULL AND doy IS NOT NULL AND log_size IS NOT NULL AND year IS NOT NULL)
"""


_GROUP_METRICS = ("roc_auc", "average_precision", "f1", "accuracy")


def _by_group(key: str, rows: str) -> str:
    """CTEs ending in ``gm``: the four metrics of the scored rows per key."""
    m = _metric_exprs()
    return f"""
, rows_ AS ({rows})
, gs AS (SELECT {key}, score, sum(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END) AS pos, sum(CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END) AS neg
         FROM rows_ GROUP BY 1, 2)
, gc AS (SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg FROM gs
         WINDOW w AS (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, gr AS (SELECT {key}, {_AUC} AS roc_auc, {_AP} AS average_precision FROM gc GROUP BY 1)
, gx AS (SELECT {key}, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
                count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM rows_ GROUP BY 1)
, gm AS (SELECT gr.*, {m['f1']} AS f1, {m['accuracy']} AS accuracy FROM gr JOIN gx USING ({key}))
"""


def _fold_summary() -> str:
    fold = f"cast((row_number() OVER (PARTITION BY label ORDER BY {mix_sql('id', SEED)}, id) - 1) % 5 AS int)"
    long = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM gm" for m in _GROUP_METRICS)
    return (with_("scored") + _by_group("fold", f"SELECT label, score, pred, {fold} AS fold FROM scored")
            + f"SELECT metric, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max "
              f"FROM ({long}) GROUP BY metric")


def _comparison() -> str:
    other = "((id * 7561) % 1000) / 1e3"
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS model, label, s AS score, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS pred FROM (SELECT label, {e} AS s FROM scored)"
        for n, e in (("fixed", "score"), ("noise", other), ("mixed", f"(score + {other}) / 2")))
    sel = ", ".join(f"{R(m)} AS {m}" for m in _GROUP_METRICS)
    return with_("scored") + _by_group("model", rows) + f"SELECT model, {sel}, row_number() OVER (ORDER BY roc_auc DESC, model) = 1 AS is_best FROM gm"


def _importance_ctes() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, '{FEATURE_LABELS.get(c, c)}' AS display_name, "
        f"CASE WHEN isnan(coalesce(corr({c}, cast(target AS double)), 0e0)) THEN 0e0 ELSE round(abs(coalesce(corr({c}, cast(target AS double)), 0e0)), 9) END AS v FROM model"
        for i, c in enumerate(FEATURE_COLS))
    return with_("model") + f", iv AS ({parts}), im AS (SELECT *, v / sum(v) OVER () AS importance FROM iv)\n"


FIXED_WEIGHTS = {"doy": 0.004, "doy_sin": -0.8, "latitude": 0.03, "longitude": 0.02, "month": -0.05, "log_size": 0.3, "is_weekend": 0.25}
FIXED_BIAS = 0.7
_LOGIT = f"{FIXED_BIAS}e0" + "".join(f" + {w}e0 * {c}" for c, w in FIXED_WEIGHTS.items())


def _sample(n: int, seed: int) -> str:
    return f"SELECT * FROM model ORDER BY {mix_sql('inc_id', seed)}, inc_id LIMIT {n}"


def _pdp_fixed() -> str:
    grids = []
    for f in PDP_FEATURES:
        w = FIXED_WEIGHTS.get(f, 0.0)
        q = lambda p: (f"(SELECT (1 - g) * any_value(lo) + g * any_value(hi) FROM (SELECT least(greatest(n * {p} + 0.4 + 0.2 * {p} - k, 0), 1) AS g, "  # noqa: E731
                       f"list_extract(xs, cast(k AS bigint)) AS lo, list_extract(xs, cast(k AS bigint) + 1) AS hi FROM "
                       f"(SELECT xs, n, floor(least(greatest(n * {p} + 0.4 + 0.2 * {p}, 1), n - 1)) AS k FROM "
                       f"(SELECT list(cast({f} AS double) ORDER BY {f}) AS xs, count(*) AS n FROM sm))) GROUP BY g)")
        grids.append(f"SELECT '{f}' AS feature, {w}e0 AS w, v AS grid_value FROM (SELECT DISTINCT cast({f} AS double) AS v FROM sm) "
                     f"WHERE (SELECT count(DISTINCT {f}) FROM sm) < 50 UNION ALL "
                     f"SELECT '{f}', {w}e0, lo + (hi - lo) * i / 49e0 FROM (SELECT {q('0.05e0')} AS lo, {q('0.95e0')} AS hi) "
                     f"CROSS JOIN (SELECT range AS i FROM range(0, 50)) WHERE (SELECT count(DISTINCT {f}) FROM sm) >= 50")
    own = "CASE feature " + " ".join(f"WHEN '{f}' THEN cast({f} AS double)" for f in PDP_FEATURES) + " END"
    return with_("model") + f"""
, sm AS ({_sample(10000, SEED)})
, grid AS ({' UNION ALL '.join(grids)})
, z AS (SELECT feature, grid_value, ({_LOGIT}) + w * (grid_value - {own}) AS z FROM sm CROSS JOIN grid)
, p AS (SELECT feature, grid_value, 1 / (1 + exp(-z)) AS p, least(greatest(1 / (1 + exp(-z)), 1e-15), 1 - 1e-15) AS c FROM z)
SELECT feature, {R('grid_value')} AS grid_value, {R('avg(p)')} AS average_probability, {R('avg(ln(c / (1 - c)))')} AS average_log_odds
FROM p GROUP BY feature, p.grid_value"""


def _grid_sql(rows: str) -> str:
    """(feature, grid_value) of the partial-dependence features over the rows."""
    grids = []
    for f in PDP_FEATURES:
        q = lambda p: (f"(SELECT (1 - g) * any_value(lo) + g * any_value(hi) FROM (SELECT least(greatest(n * {p} + 0.4 + 0.2 * {p} - k, 0), 1) AS g, "  # noqa: E731
                       f"list_extract(xs, cast(k AS bigint)) AS lo, list_extract(xs, cast(k AS bigint) + 1) AS hi FROM "
                       f"(SELECT xs, n, floor(least(greatest(n * {p} + 0.4 + 0.2 * {p}, 1), n - 1)) AS k FROM "
                       f"(SELECT list(cast({f} AS double) ORDER BY {f}) AS xs, count(*) AS n FROM {rows}))) GROUP BY g)")
        grids.append(f"SELECT '{f}' AS feature, v AS grid_value FROM (SELECT DISTINCT cast({f} AS double) AS v FROM {rows}) "
                     f"WHERE (SELECT count(DISTINCT {f}) FROM {rows}) < 50 UNION ALL "
                     f"SELECT '{f}', lo + (hi - lo) * i / 49e0 FROM (SELECT {q('0.05e0')} AS lo, {q('0.95e0')} AS hi) "
                     f"CROSS JOIN (SELECT range AS i FROM range(0, 50)) WHERE (SELECT count(DISTINCT {f}) FROM {rows}) >= 50")
    return " UNION ALL ".join(grids)


def _fixed_trees() -> str:
    """Nodes of the fixed ensemble, paths to every node, rows that reach each, and
    each leaf's features with interval and share."""
    names = ", ".join(f"'{c}'" for c in FEATURE_COLS)
    cols = ", ".join(f"cast({c} AS double)" for c in FEATURE_COLS)
    rows = ", ".join(f"({t}, {n}, {'NULL' if f is None else repr(f)}, {x}e0, {a}, {b}, {v}e0)" for t, n, f, x, a, b, v in FIXED_TREES)
    return with_("model").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, nodes(tree, node, feature, threshold, l, r, value) AS (VALUES {rows})
, path AS (
  SELECT DISTINCT tree, 0 AS node, []::STRUCT(f VARCHAR, t DOUBLE, l BOOLEAN, p INTEGER, c INTEGER)[] AS steps FROM nodes
  UNION ALL
  SELECT p.tree, CASE WHEN s.range = 0 THEN n.l ELSE n.r END,
         list_append(p.steps, {{f: n.feature, t: n.threshold, l: s.range = 0, p: n.node, c: CASE WHEN s.range = 0 THEN n.l ELSE n.r END}})
  FROM path p JOIN nodes n ON n.tree = p.tree AND n.node = p.node AND n.feature IS NOT NULL CROSS JOIN range(0, 2) s)
, xs AS (SELECT inc_id AS id, map([{names}], [{cols}]) AS x FROM model)
, cover AS (SELECT p.tree, p.node, count(xs.id) AS n FROM path p LEFT JOIN xs ON len(list_filter(p.steps, lambda c: (x[c.f] <= c.t) <> c.l)) = 0 GROUP BY 1, 2)
, part AS (
  SELECT k.tree, k.node, k.s.f AS f, product(CASE WHEN u.n > 0 THEN cast(v.n AS double) / u.n ELSE 0.5e0 END) AS share,
         max(CASE WHEN k.s.l THEN cast('-inf' AS double) ELSE k.s.t END) AS lo, min(CASE WHEN k.s.l THEN k.s.t ELSE cast('inf' AS double) END) AS hi
  FROM (SELECT p.tree, p.node, unnest(p.steps) AS s FROM path p JOIN nodes n USING (tree, node) WHERE n.feature IS NULL) k
  JOIN cover u ON u.tree = k.tree AND u.node = k.s.p JOIN cover v ON v.tree = k.tree AND v.node = k.s.c GROUP BY 1, 2, 3)
, leaf AS (
  SELECT tree, node, n.value AS v, list(f ORDER BY f) AS fs, list(share ORDER BY f) AS ss, list(lo ORDER BY f) AS los, list(hi ORDER BY f) AS his
  FROM part JOIN nodes n USING (tree, node) GROUP BY 1, 2, 3)"""


def _walked_fixed() -> str:
    return _fixed_trees() + f"""
, grid AS ({_grid_sql('model')})
, reach AS (
  SELECT g.feature, g.grid_value, v * list_product(list_transform(range(1, len(fs) + 1), lambda i: CASE WHEN fs[i] = g.feature THEN 1e0 ELSE ss[i] END)) AS m
  FROM (SELECT DISTINCT * FROM grid) g CROSS JOIN leaf
  WHERE len(list_filter(range(1, len(fs) + 1), lambda i: fs[i] = g.feature AND NOT (g.grid_value > los[i] AND g.grid_value <= his[i]))) = 0)
SELECT feature, {R('grid_value')} AS grid_value, {R('sum(m)')} AS average_margin FROM reach GROUP BY feature, reach.grid_value"""


def _tree_shapley_fixed() -> str:
    factorial = "[1e0, 1e0, 2e0, 6e0, 24e0, 120e0]"
    return _fixed_trees() + f"""
, met AS (SELECT xs.id, tree, node, v, fs, ss, len(fs) AS d,
                 list_transform(range(1, len(fs) + 1), lambda i: CASE WHEN x[fs[i]] > los[i] AND x[fs[i]] <= his[i] THEN 1e0 ELSE 0e0 END) AS os FROM xs CROSS JOIN leaf)
, pattern AS (SELECT tree, node, v, fs, ss, d, os, count(*) AS n, list(id) AS ids FROM met GROUP BY ALL)
, phi AS (
  SELECT ids, fs[i] AS f, sum(v * (os[i] - ss[i]) * {factorial}[1 + bit_count(m)] * {factorial}[d - bit_count(m)] / {factorial}[1 + d]
         * list_product(list_transform(range(1, d + 1), lambda j: CASE WHEN j = i THEN 1e0 WHEN (m >> (j - 1)) & 1 = 1 THEN os[j] ELSE ss[j] END))) AS p
  FROM (SELECT pattern.*, a.range AS i, b.range AS m FROM pattern CROSS JOIN range(1, 7) a CROSS JOIN range(0, 32) b
        WHERE a.range <= d AND b.range < (1 << d) AND (b.range >> (a.range - 1)) & 1 = 0) GROUP BY tree, node, ids, f)
, own AS (SELECT id, f, sum(p) AS p FROM (SELECT unnest(ids) AS id, f, p FROM phi) GROUP BY 1, 2)
, every AS (SELECT xs.id, f.f, coalesce(own.p, 0e0) AS p FROM xs CROSS JOIN (SELECT DISTINCT f FROM part) f LEFT JOIN own ON own.id = xs.id AND own.f = f.f)
, su AS (SELECT f AS feature, avg(abs(p)) AS a, avg(p) AS m FROM every GROUP BY 1)
SELECT feature, {R('a')} AS mean_abs_shapley, {R('m')} AS mean_shapley, cast(row_number() OVER (ORDER BY round(a, 12) DESC, feature) AS int) AS rank FROM su"""


def _shapley_fixed() -> str:
    cols = ", ".join(f"cast({c} AS double)" for c in FEATURE_COLS)
    weights = ", ".join(f"{FIXED_WEIGHTS.get(c, 0.0)}e0" for c in FEATURE_COLS)
    names = ", ".join(f"'{c}'" for c in FEATURE_COLS)
    order = ", ".join(FEATURE_COLS)
    n = len(FEATURE_COLS)
    return with_("model") + f"""
, ex AS (SELECT inc_id AS id, [{cols}] AS xs, {_LOGIT} AS zx FROM ({_sample(5000, SEED)}))
, bg AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS b, [{cols}] AS zs, {_LOGIT} AS zb FROM ({_sample(100, SEED + 1)}))
, nb AS (SELECT count(*) AS n FROM bg)
, d AS (SELECT e.id, s.range AS s, e.xs, {mix_sql('e.id', f's.range + {SEED}')} AS h FROM ex e CROSS JOIN range(0, 10) s)
, j AS (SELECT d.id, d.s, d.h, d.xs, bg.zs, bg.zb FROM d CROSS JOIN nb JOIN bg ON bg.b = d.h % nb.n)
, f AS (SELECT id, s, h, zb, r.range AS j, list_extract([{weights}], r.range + 1) * (list_extract(xs, r.range + 1) - list_extract(zs, r.range + 1)) AS dz
        FROM j CROSS JOIN range(0, {n}) r)
, o AS (SELECT id, s, j, zb, dz, {replicate_sql('h', 'j')} AS o FROM f)
, c AS (SELECT *, zb + sum(dz) OVER (PARTITION BY id, s ORDER BY o, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z1 FROM o)
, phi AS (SELECT id, j, sum(1 / (1 + exp(-z1)) - 1 / (1 + exp(-(z1 - dz)))) / 10 AS v FROM c GROUP BY id, j)
, su AS (SELECT list_extract([{names}], j + 1) AS feature, avg(abs(v)) AS a, avg(v) AS m FROM phi GROUP BY j)
SELECT feature, {R('a')} AS mean_abs_shapley, {R('m')} AS mean_shapley, cast(row_number() OVER (ORDER BY round(a, 12) DESC, feature) AS int) AS rank FROM su"""


def _poles() -> str:
    return f"""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 90e0 WHEN s_suppkey % 9 = 1 THEN -90e0
                  ELSE (42e0 + ((s_suppkey * 53) % 1800) / 100e0 - 51e0) * 10e0 END AS la, ((s_suppkey * 577) % 3600) / 10e0 AS lo FROM supplier),
c AS (SELECT c_custkey AS point_id, CASE WHEN c_custkey % 11 = 0 THEN 90e0 WHEN c_custkey % 11 = 1 THEN -90e0 WHEN c_custkey % 11 = 2 THEN 89.5e0
             ELSE ((c_custkey * 37) % 1800) / 10e0 - 90e0 END AS lat, ((c_custkey * 91) % 3600) / 10e0 - 180e0 AS lon FROM customer)
SELECT point_id, {R(f"min({haversine_sql('c.lat', 'c.lon', 's.la', 's.lo')})", 5)} AS station_dist_km FROM c CROSS JOIN s GROUP BY point_id"""


def _corr() -> str:
    cols = CLIMATE_CORR_COLS
    drop = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    parts = []
    for i, a in enumerate(cols):
        for b in cols[: i + 1]:
            if a == b:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, 1e0 AS corr")
            else:
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R(f'corr({a}, {b})')} AS corr FROM cc")
    return with_("model_raw") + f", cc AS (SELECT * FROM model_raw WHERE {drop})\n" + " UNION ALL ".join(parts)


def _hist(col: str, src: str, bins: int = 50, group: str | None = None) -> str:
    """Every bin of every group is listed first; a bin's rows are counted by its bounds' index."""
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    same = f"c.{group} IS NOT DISTINCT FROM r.{group} AND " if group else ""
    ok = f"{col} IS NOT NULL AND NOT isnan({col})"
    rng = (f"SELECT {g}CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5e0 ELSE min({col}) END AS mn, "
           f"CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5e0 ELSE max({col}) END AS mx, count(*) AS tot "
           f"FROM {src} WHERE {ok} {by} HAVING count(*) > 0")
    on = f"d.{group} IS NOT DISTINCT FROM r.{group}" if group else "TRUE"
    cnt = (f"SELECT {'r.' + g if group else ''}cast(least(floor((d.{col} - mn) / (mx - mn) * {bins}), {bins - 1}) AS int) + 1 AS bin, count(*) AS n "
           f"FROM (SELECT * FROM {src} WHERE {ok}) d JOIN ({rng}) r ON {on} GROUP BY ALL")
    return (f"SELECT {'r.' + g if group else ''}cast(s.b AS int) AS bin, {R(f'mn + (s.b - 1) * ((mx - mn) / {bins})')} AS lo, "
            f"{R(f'mn + s.b * ((mx - mn) / {bins})')} AS hi, coalesce(c.n, 0) AS n, "
            f"{R(f'coalesce(c.n, 0) / (tot * ((mx - mn) / {bins}))')} AS density "
            f"FROM ({rng}) r CROSS JOIN (SELECT range AS b FROM range(1, {bins + 1})) s LEFT JOIN ({cnt}) c ON {same}c.bin = s.b")


def _calibration_bin() -> str:
    return "cast(" + " + ".join(f"CASE WHEN score > {dbl(e)} THEN 1 ELSE 0 END" for e in CALIBRATION_EDGES) + " AS int)"


def _split_sql() -> str:
    h = mix_sql("id", SEED)
    return with_("scored") + f"""
, cnt AS (SELECT label, count(*) AS n FROM scored GROUP BY label)
, al AS (SELECT label, n, sum(n) OVER () AS tot, cast(ceil(0.2e0 * sum(n) OVER ()) AS bigint) AS nt FROM cnt)
, al2 AS (SELECT label, (nt * n) // tot AS base, (nt * n) % tot AS rem, nt FROM al)
, al3 AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= nt - sum(base) OVER ()
                                    THEN 1 ELSE 0 END AS k FROM al2)
, ranked AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {h}, id) AS rn FROM scored)
, split AS (SELECT r.id, r.label, CASE WHEN r.rn <= a.k THEN 'test' ELSE 'train' END AS split
            FROM ranked r JOIN al3 a ON r.label = a.label)
"""


def _perm_sql(n_perm: int = 1000) -> str:
    h = replicate_sql("r.hid", "p.perm")
    return with_("scored") + f"""
, sc AS (SELECT score, count(*) AS cnt FROM scored GROUP BY score)
, rk AS (SELECT score, (sum(cnt) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt)
                        + (cnt + 1) / 2e0 AS ar FROM sc)
, r AS (SELECT s.id, s.label, rk.ar, {mix_sql("s.id", SEED + 7)} AS hid FROM scored s JOIN rk ON s.score = rk.score)
, tot AS (SELECT sum(label) AS np, count(*) - sum(label) AS nn,
                 sum(CASE WHEN label = 1 THEN ar ELSE 0e0 END) AS rs FROM r)
, x AS (SELECT p.perm, r.id, r.ar, {h} AS h FROM r CROSS JOIN (SELECT range AS perm FROM range(0, {n_perm})) p)
, ranked AS (SELECT perm, ar, row_number() OVER (PARTITION BY perm ORDER BY h, id) AS rn FROM x)
, pa AS (SELECT k.perm, (sum(CASE WHEN k.rn <= t.np THEN k.ar ELSE 0e0 END) - any_value(t.np * (t.np + 1) / 2e0))
                        / any_value(cast(t.np * t.nn AS double)) AS auc
         FROM ranked k CROSS JOIN tot t GROUP BY k.perm)
, obs AS (SELECT (rs - np * (np + 1) / 2e0) / cast(np * nn AS double) AS o FROM tot)
SELECT {R('any_value(o)')} AS observed_auc, {R('avg(auc)')} AS perm_mean, {R('stddev_pop(auc)')} AS perm_std,
       {R('avg(CASE WHEN auc >= o THEN 1e0 ELSE 0e0 END)')} AS p_value,
       {R('(sum(CASE WHEN auc >= o THEN 1e0 ELSE 0e0 END) + 1) / (count(*) + 1)')} AS p_value_corrected,
       count(*) AS n_perm
FROM pa CROSS JOIN obs"""


def _boot_sql(n_boot: int = 1000) -> str:
    u = f"({replicate_sql('s.hid', 't.rep')}) / 2147483648e0"
    w = " + ".join(f"CASE WHEN u >= {dbl(c)} THEN 1 ELSE 0 END" for c in POISSON1_CDF)
    m = _metric_exprs()
    return with_("scored") + f"""
, hs AS (SELECT *, {mix_sql("id", SEED)} AS hid FROM scored)
, ex AS (SELECT t.rep, s.id, s.label, s.score, s.pred, {u} AS u FROM hs s
         CROSS JOIN (SELECT range AS rep FROM range(0, {n_boot})) t)
, wx AS (SELECT rep, label, score, pred, ({w}) AS w FROM ex)
, ag AS (SELECT rep, score, label, pred, cast(sum(w) AS double) AS w FROM wx WHERE w > 0 GROUP BY 1, 2, 3, 4)
, sc AS (SELECT rep, score, sum(CASE WHEN label = 1 THEN w ELSE 0e0 END) AS pos,
                sum(CASE WHEN label = 0 THEN w ELSE 0e0 END) AS neg FROM ag GROUP BY rep, score)
, cum AS (SELECT rep, score, pos, neg,
                 sum(pos) OVER (PARTITION BY rep ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
                 sum(neg) OVER (PARTITION BY rep ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg
          FROM sc)
, rkm AS (SELECT rep, sum(pos) AS np, sum(neg) AS nn, {_AUC} AS roc_auc, {_AP} AS average_precision FROM cum GROUP BY rep)
, cmr AS (SELECT rep, sum(CASE WHEN label = 0 AND pred = 0 THEN w ELSE 0e0 END) AS tn,
                 sum(CASE WHEN label = 0 AND pred = 1 THEN w ELSE 0e0 END) AS fp,
                 sum(CASE WHEN label = 1 AND pred = 0 THEN w ELSE 0e0 END) AS fn,
                 sum(CASE WHEN label = 1 AND pred = 1 THEN w ELSE 0e0 END) AS tp FROM ag GROUP BY rep)
, reps AS (SELECT k.rep, k.roc_auc, k.average_precision, {m['f1']} AS f1, {m['accuracy']} AS accuracy
           FROM rkm k JOIN cmr c ON k.rep = c.rep WHERE k.np > 0 AND k.nn > 0)
, long AS (SELECT 'roc_auc' AS metric, roc_auc AS value FROM reps UNION ALL
           SELECT 'pr_auc', average_precision FROM reps UNION ALL
           SELECT 'f1', f1 FROM reps UNION ALL SELECT 'accuracy', accuracy FROM reps)
SELECT metric, {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.025)')} AS ci_low,
       {R('quantile_cont(value, 0.975)')} AS ci_high, count(*) AS n_reps FROM long GROUP BY metric"""


_CAT = """
SELECT s.site_id AS STN_ID, s.site_name AS STATION_NAME, n.n_name AS PROV, li.first_date, li.last_date,
       CASE WHEN s.site_id % 17 = 0 THEN NULL ELSE s.site_lon END AS x, s.site_lat AS y
FROM sites s JOIN supplier sp ON s.site_id = sp.s_suppkey JOIN nation n ON sp.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_suppkey, min(cast(l_shipdate AS date)) AS first_date, max(cast(l_shipdate AS date)) AS last_date
           FROM lineitem GROUP BY l_suppkey) li ON li.l_suppkey = s.site_id"""
cte("catalogue", ("sites",), _CAT)
_SY, _EY = STATION_PERIOD
cte("station_list", ("catalogue",), f"""
SELECT STN_ID AS station_id, {_SY} AS start_year, {_EY} AS end_year,
       trim(regexp_replace(STATION_NAME, '[^A-Za-z]', '', 'g')) || '_' || PROV AS name
FROM catalogue WHERE first_date <= DATE '{_SY}-01-01' AND last_date >= DATE '{_EY}-12-31'""")

_METRICS_SELECT = ", ".join(f"{R(v)} AS {k}" for k, v in _metric_exprs().items())


def _class_report() -> str:
    tn, fp, fn, tp = (f"cast({x} AS double)" for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = _ratio(tp, f"{tp} + {fp}"), _ratio(tp, f"{tp} + {fn}")
    p0, r0 = _ratio(tn, f"{tn} + {fn}"), _ratio(tn, f"{tn} + {fp}")
    f1, f0 = _ratio(f"2 * {p1} * {r1}", f"{p1} + {r1}"), _ratio(f"2 * {p0} * {r0}", f"{p0} + {r0}")
    s0, s1 = f"({tn} + {fp})", f"({tp} + {fn})"
    tot = f"({s0} + {s1})"
    rows = [("Natural", p0, r0, f0, s0), ("Human", p1, r1, f1, s1),
            ("accuracy", "NULL", "NULL", _ratio(f"{tp} + {tn}", tot), tot),
            ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", tot),
            ("weighted avg", _ratio(f"{p0} * {s0} + {p1} * {s1}", tot), _ratio(f"{r0} * {s0} + {r1} * {s1}", tot),
             _ratio(f"{f0} * {s0} + {f1} * {s1}", tot), tot)]
    sel = [f"SELECT '{n}' AS class_name, {R(f'cast({p} AS double)')} AS precision, {R(f'cast({r} AS double)')} AS recall, "
           f"{R(f)} AS f1, cast({s} AS bigint) AS support FROM cm" for n, p, r, f, s in rows]
    return with_("cm") + " UNION ALL ".join(sel)


def _profile_sqls() -> dict[str, str]:
    inc_cols = ["inc_id", "yr", "mo", "dy", "cause", "agency", "lat", "lon", "size_ha", "calc_ha"]
    dbl_cols = {"lat", "lon", "size_ha", "calc_ha"}
    parts = []
    for c in inc_cols:
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if c in dbl_cols else "")
        parts.append(f"SELECT '{c}' AS column_name, cast(sum(CASE WHEN {miss} THEN 1 ELSE 0 END) AS bigint) AS missing, "
                     f"count(*) AS rows_ FROM incidents")
    null_profile = (with_("incidents") + "SELECT column_name, missing, " + R("round_even(missing * 100e0 / rows_, 1)")
                    + " AS percent FROM (" + " UNION ALL ".join(parts) + ") WHERE missing > 0 "
                    "ORDER BY percent DESC, column_name LIMIT 15")
    num = ["site_id", "site_lat", "site_lon", "dn", "copy_no", "temp_max", "temp_min", "temp_mean", "precip", "rain"]
    parts = [f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS non_null, "
             f"{R(f'avg(cast({c} AS double))')} AS mean FROM daily_obs" for i, c in enumerate(num)]
    numeric_profile = with_("daily_obs") + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE non_null > 0"
    parts = [f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS non_null, "
             f"{R(f'CASE WHEN count(*) > 0 THEN count({c}) * 100e0 / count(*) END')} AS pct FROM features"
             for i, c in enumerate(FEATURE_COLS)]
    coverage = with_("features") + " UNION ALL ".join(parts)
    parts = []
    for c in ("size_ha", "calc_ha"):
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS n, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max, "
                     f"{R(f'avg({c})')} AS mean, {R(f'quantile_cont({c}, 0.5)')} AS median, "
                     f"{R(f'stddev_samp({c})')} AS std FROM incidents WHERE {c} > 0")
    describe = with_("incidents") + " UNION ALL ".join(parts)
    return {"null_profile": null_profile, "numeric_profile": numeric_profile, "feature_coverage": coverage,
            "size_describe": describe}


def _temporal() -> str:
    d = _DATE
    doy_older = (f"CASE WHEN yr IS NOT NULL AND mo BETWEEN 1 AND 12 AND dy BETWEEN 1 AND 31 THEN {_DOY2000} END")
    wk_older = (f"CASE WHEN yr BETWEEN 1900 AND 2030 THEN (CASE WHEN isodow({d}) - 1 >= 5 THEN 1e0 "
                f"WHEN {d} IS NOT NULL THEN 0e0 END) END")
    actual = ("CASE WHEN mo IS NOT NULL THEN cast(dayofyear(try_cast(coalesce(yr, 2000) || '-' || "
              "(CASE WHEN mo BETWEEN 1 AND 12 THEN mo ELSE 1 END) || '-' || "
              "(CASE WHEN dy BETWEEN 1 AND 31 THEN dy ELSE 1 END) AS date)) AS int) END")
    return (with_("clean") + f"SELECT inc_id, {_DOY2000} AS doy, {R(f'sin(2 * pi() * {_DOY2000} / 365e0)')} AS doy_sin, "
            f"{R(f'cos(2 * pi() * {_DOY2000} / 365e0)')} AS doy_cos, cast(isodow({d}) - 1 AS int) AS dow, "
            f"CASE WHEN isodow({d}) - 1 >= 5 THEN 1e0 ELSE 0e0 END AS is_weekend, mo AS month, yr AS year, "
            f"{doy_older} AS doy_older, {wk_older} AS is_weekend_older, cast(floor(yr / 10) * 10 AS int) AS decade, "
            f"{actual} AS doy_actual FROM clean")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["incident_scan"] = with_("incidents") + f"SELECT {_INC_COLS} FROM incidents"
    q["incident_landed_scan"] = q["incident_scan"]
    q["table_shape"] = with_("incidents") + "SELECT count(*) AS n_rows, 10 AS n_cols FROM incidents"
    q["table_preview"] = with_("incidents") + f"SELECT {_INC_COLS} FROM incidents ORDER BY inc_id LIMIT 10"
    q["clean_incidents"] = with_("clean") + f"SELECT {_INC_COLS}, target FROM clean"
    q["size_features"] = with_("sized") + _sel(["fire_size", "log_size", "log_size_fallback", "log10_size"],
                                               "sized", ["inc_id"])
    q["temporal_features"] = _temporal()
    q["label_encode"] = with_("clean", "prov_dict") + """
, d2 AS (SELECT a2, cast(row_number() OVER (ORDER BY a2) - 1 AS int) AS agency_code_filled
         FROM (SELECT DISTINCT coalesce(agency, 'Unknown') AS a2 FROM clean))
SELECT c.inc_id, c.agency, p.province_code, d2.agency_code_filled
FROM clean c LEFT JOIN prov_dict p ON c.agency = p.agency LEFT JOIN d2 ON coalesce(c.agency, 'Unknown') = d2.a2"""
    q["obs_union_by_name"] = with_("daily_obs") + (
        "SELECT site_id, obs_date, copy_no, " + ", ".join(f"{R(c)} AS {c}" for c in
                                                         ("temp_max", "temp_min", "temp_mean", "precip", "rain"))
        + ", CASE WHEN obs_date >= DATE '1998-01-01' THEN " + R("snow_ground") + " END AS snow_ground"
        + ", CASE WHEN obs_date >= DATE '1998-01-01' THEN " + R("wind_gust") + " END AS wind_gust FROM daily_obs")
    q["station_filter"] = with_("station_list") + "SELECT station_id, start_year, end_year, name FROM station_list"
    q["station_geo"] = with_("station_list") + (
        f"SELECT l.station_id, l.start_year, l.end_year, l.name, {R('c.x')} AS x, {R('c.y')} AS y "
        "FROM station_list l LEFT JOIN catalogue c ON l.station_id = c.STN_ID WHERE c.x IS NOT NULL AND c.y IS NOT NULL")
    q["fetch_manifest"] = with_("station_list") + """
, yrs AS (SELECT station_id, name, cast(unnest(range(start_year, end_year + 1)) AS int) AS year FROM station_list)
, man AS (SELECT station_id, name, year, 'climate_daily_' || name || '_' || year || '.csv' AS file_name,
                 'bulk://climate/daily?format=csv&stationID=' || station_id || '&Year=' || year
                 || '&Month=1&Day=1&timeframe=2' AS url FROM yrs)
, ex AS (SELECT 'climate_daily_' || l.name || '_' || e.yr || '.csv' AS file_name, e.size
         FROM (SELECT l_suppkey, cast(year(l_shipdate) AS int) AS yr, count(*) FILTER (WHERE l_quantity >= 50) AS size
               FROM lineitem GROUP BY 1, 2) e JOIN station_list l ON l.station_id = e.l_suppkey)
SELECT station_id, name, year, file_name, url FROM man
WHERE file_name NOT IN (SELECT file_name FROM ex WHERE size > 0)"""
    q["site_dimension"] = with_("daily_obs") + (
        "SELECT site_name AS station_name, "
        + R("arg_min(site_lon, dn * 10 + copy_no) FILTER (WHERE site_lon IS NOT NULL)") + " AS stn_lon, "
        + R("arg_min(site_lat, dn * 10 + copy_no) FILTER (WHERE site_lat IS NOT NULL)") + " AS stn_lat, "
        "arg_min(climate_id, dn * 10 + copy_no) FILTER (WHERE climate_id IS NOT NULL) AS climate_id "
        "FROM daily_obs GROUP BY site_name")
    q["nearest_site"] = with_("nearest") + _sel(["station_dist_km"], "nearest", ["inc_id", "nearest_site", "nearest_name"])
    q["site_distance_quantiles"] = with_("nearest") + (
        f"SELECT {R('quantile_cont(station_dist_km, 0.5)')} AS p50_km, {R('quantile_cont(station_dist_km, 0.9)')} AS p90_km "
        "FROM nearest")
    day_cols = ["temp_max", "temp_min", "temp_mean", "precip", "rain", "snow_ground", "wind_gust"]
    q["climate_day_of"] = with_("joined") + _sel(day_cols, "joined", ["inc_id"])
    q["climate_7d"] = with_("joined") + _sel(WINDOW_COLS[7], "joined", ["inc_id"])
    q["climate_30d"] = with_("joined") + _sel(WINDOW_COLS[30], "joined", ["inc_id"])
    q["climate_derived"] = with_("features") + _sel(["diurnal_range", "temp_anomaly", "fire_weather_index", "station_dist"],
                                                    "features", ["inc_id"])
    q["joined_features"] = with_("joined") + _sel(["station_dist_km"] + day_cols + WINDOW_COLS[7] + WINDOW_COLS[30],
                                                  "joined", ["inc_id", "target", "nearest_site", "fire_date"])
    q["model_dataset"] = with_("model") + _sel(FEATURE_COLS, "model", ["inc_id", "target"])
    q.update(_profile_sqls())
    q["cause_counts"] = with_("incidents") + "SELECT cause, count(*) AS n FROM incidents WHERE cause IS NOT NULL GROUP BY cause"
    q["top_years"] = with_("incidents") + ("SELECT yr, count(*) AS n FROM incidents WHERE yr IS NOT NULL GROUP BY yr "
                                           "ORDER BY n DESC, yr LIMIT 10")
    q["class_distribution"] = with_("clean") + (f"SELECT target, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()')} "
                                                "AS share FROM clean GROUP BY target")
    q["class_means"] = with_("sized") + (
        f"SELECT target, {R('avg(doy)')} AS mean_doy, {R('exp(avg(log_size_fallback))')} AS typical_size FROM ("
        f"SELECT CASE WHEN cause = 'N' THEN 0 ELSE 1 END AS target, "
        f"CASE WHEN yr IS NOT NULL AND mo BETWEEN 1 AND 12 AND dy BETWEEN 1 AND 31 THEN {_DOY2000} END AS doy, "
        f"log_size_fallback FROM sized WHERE cause IN ('N', 'H', 'H-PB')) GROUP BY target")
    q["cause_by_month"] = with_("clean") + _crosstab("mo", "clean")
    q["cause_by_agency"] = with_("clean") + _crosstab("agency", "clean")
    q["cause_by_year"] = with_("clean") + _crosstab("yr", "clean", "yr >= 1980")
    q["cause_by_decade"] = with_("clean") + _crosstab("decade", _CLEAN_T)
    q["cause_by_weekday"] = with_("clean") + _crosstab("dow", _CLEAN_T)
    q["agency_cause_pct"] = with_("clean") + _pct("agency", _crosstab("agency", "clean"), True)
    q["weekday_cause_pct"] = with_("clean") + _pct("dow", _crosstab("dow", _CLEAN_T), False)
    q["human_rate_top"] = with_("clean") + (
        f"SELECT agency, {R('avg(cast(target AS double))')} AS human_rate FROM clean WHERE agency IS NOT NULL "
        "GROUP BY agency ORDER BY avg(cast(target AS double)) DESC, agency LIMIT 3")
    q["yearly_stats"] = with_("sized") + (
        "SELECT yr, num_fires, " + ", ".join(f"{R(c)} AS {c}" for c in ("total_area", "mean_size", "median_size", "max_size"))
        + f" FROM ({_yearly()})")
    q["monthly_counts"] = with_("incidents") + "SELECT mo, count(*) AS n FROM incidents WHERE mo IS NOT NULL GROUP BY mo"
    q["agency_stats"] = with_("sized") + (
        f"SELECT agency, count(fire_size) AS n, {R('coalesce(sum(fire_size), 0e0)')} AS total_area FROM sized "
        "WHERE agency IS NOT NULL GROUP BY agency")
    q["yearly_trend"] = _trend()
    q["climate_correlation"] = _corr()
    q["size_histogram"] = with_("sized") + _hist("log10_size", "sized")
    q["score_histogram"] = with_("scored") + _hist("score", "scored", group="label")
    q["confusion_matrix"] = with_("cm") + "SELECT tn, fp, fn, tp FROM cm"
    q["binary_metrics"] = with_("cm") + f"SELECT tn, fp, fn, tp, {_METRICS_SELECT} FROM cm"
    q["class_report"] = _class_report()
    q["prob_losses"] = with_("scored") + (
        f"SELECT {R('avg((score - label) * (score - label))')} AS brier, "
        f"{R('-avg(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))')} AS log_loss "
        "FROM scored")
    m = _metric_exprs()
    q["baseline_lift"] = with_("cm", "score_cum") + f"""
, a AS (SELECT {m['accuracy']} AS accuracy, cast(tp + fn AS double) / (tp + fn + tn + fp) AS prevalence FROM cm)
, k AS (SELECT {_AUC} AS roc_auc, {_AP} AS average_precision FROM score_cum)
, j AS (SELECT *, greatest(prevalence, 1 - prevalence) AS maj FROM a CROSS JOIN k)
SELECT {R('maj')} AS majority_accuracy, {R('prevalence')} AS prevalence, {R('accuracy')} AS accuracy,
       {R('roc_auc')} AS roc_auc, {R('average_precision')} AS average_precision,
       {R('accuracy - maj')} AS accuracy_lift, {R('(accuracy - maj) / maj')} AS accuracy_lift_rel,
       {R('average_precision - prevalence')} AS pr_auc_lift,
       {R('(average_precision - prevalence) / prevalence')} AS pr_auc_lift_rel,
       {R('roc_auc - 0.5')} AS roc_auc_lift, {R('(roc_auc - 0.5) / 0.5')} AS roc_auc_lift_rel FROM j"""
    q["roc_auc"] = with_("score_cum") + f"SELECT {R(_AUC)} AS roc_auc FROM score_cum"
    q["average_precision"] = with_("score_cum") + f"SELECT {R(_AP)} AS average_precision FROM score_cum"
    q["roc_curve"] = with_("score_cum") + f"""
, step AS (SELECT *, cpos - lag(cpos, 1, 0) OVER o AS p, cneg - lag(cneg, 1, 0) OVER o AS n, row_number() OVER o AS i FROM score_cum WINDOW o AS (ORDER BY score DESC)),
corner AS (SELECT *, i = 1 OR lead(p) OVER o IS NULL OR lead(p) OVER o <> p OR lead(n) OVER o <> n AS kept FROM step WINDOW o AS (ORDER BY i))
SELECT {R('score')} AS threshold, {R('cneg / tneg')} AS fpr, {R('cpos / tpos')} AS tpr FROM corner WHERE kept
UNION ALL SELECT cast('inf' AS double), 0e0, 0e0"""
    q["pr_curve"] = with_("score_cum") + (f"SELECT {R('score')} AS threshold, {R('cpos / (cpos + cneg)')} AS precision, "
                                          f"{R('cpos / tpos')} AS recall FROM score_cum UNION ALL SELECT NULL, 1e0, 0e0")
    q["calibration"] = with_("scored") + (
        f"SELECT {_calibration_bin()} AS bin, {R('avg(score)')} AS mean_predicted, "
        f"{R('avg(cast(label AS double))')} AS fraction_positive, count(*) AS n FROM scored GROUP BY 1")
    q["regression_metrics"] = with_("sized") + f"""
, r AS (SELECT ln(1 + fire_size) AS y, ln(1 + calc_ha) AS yhat FROM sized WHERE fire_size > 0)
SELECT count(*) AS n, {R('avg((y - yhat) * (y - yhat))')} AS mse, {R('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse,
       {R('CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) END')} AS r2,
       {R('sqrt(avg(((exp(y) - 1) - (exp(yhat) - 1)) * ((exp(y) - 1) - (exp(yhat) - 1))))')} AS rmse_original_units
FROM r"""
    q["stratified_split"] = _split_sql() + "SELECT id, label, split FROM split"
    q["class_weights"] = _split_sql() + """
, tr AS (SELECT * FROM split WHERE split = 'train')
, c AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM tr)
SELECT tr.id, tr.label, """ + R("CASE WHEN tr.label = 1 THEN (CASE WHEN c.n1 > 0 THEN cast(c.n0 AS double) / c.n1 ELSE 1e0 END) ELSE 1e0 END") + """ AS weight
FROM tr CROSS JOIN c"""
    q["stratified_folds"] = with_("scored") + (
        f"SELECT id, label, cast((row_number() OVER (PARTITION BY label ORDER BY {mix_sql('id', SEED)}, id) - 1) % 5 AS int) "
        "AS fold FROM scored")
    q["sample_n"] = with_("scored") + f"SELECT id, label, {R('score')} AS score FROM scored ORDER BY {mix_sql('id', SEED)}, id LIMIT 5000"
    q["histogram_sparse"] = with_("sized") + ", leap AS (SELECT * FROM sized WHERE mo = 2 AND dy = 29)\n" + _hist("fire_size", "leap", group="agency")
    q["yearly_trend_pvalue"] = _trend_p()
    q["nearest_poles"] = _poles()
    q["csv_rejects"] = "SELECT 'malformed lines' AS reason, count(*) AS rejected FROM orders WHERE o_orderkey % 200 = 0"
    older = ["month", "doy", "doy_sin", "doy_cos", "region_code", "log_size", "year"]
    q["standardize"] = _older_rows() + "SELECT id, " + ", ".join(
        R(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1e0 END") + f" AS {c}" for c in older) + " FROM k"
    q["validation_slice"] = with_("scored") + f"SELECT id, {mix_sql('id', 7)} < {int(0.1 * 2 ** 62)} AS is_validation FROM scored"
    q["cv_fold_summary"] = _fold_summary()
    q["model_comparison"] = _comparison()
    q["correlation_importance"] = _importance_ctes() + (
        f"SELECT feature, display_name, {R('importance')} AS importance, {R('sum(importance) OVER (ORDER BY importance DESC, position)')} AS cumulative, "
        "cast(row_number() OVER (ORDER BY importance DESC, position) AS int) AS rank FROM im")
    groups = " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in FEATURE_GROUPS.items())
    q["correlation_importance_groups"] = _importance_ctes() + (
        f"SELECT CASE {groups} END AS feature_group, {R('sum(importance)')} AS importance, {R('sum(importance) * 100e0')} AS share_pct FROM im GROUP BY 1")
    q["partial_dependence_fixed"] = _pdp_fixed()
    q["sampled_shapley_fixed"] = _shapley_fixed()
    q["geojson_features"] = f"""
SELECT 'CA' AS code, cast(c_custkey AS BIGINT) AS id, c_name || ' {{"' || c_custkey || chr(92) || '"}}], [{{' AS name,
       {R('cast(c_acctbal AS double)')} AS x, {R('cast(c_custkey % 90 AS double)')} AS y FROM customer WHERE c_nationkey = 3"""
    q["walked_dependence_fixed"] = _walked_fixed()
    q["tree_shapley_fixed"] = _tree_shapley_fixed()
    q["permutation_test"] = _perm_sql()
    q["bootstrap_ci"] = _boot_sql()
    return q
