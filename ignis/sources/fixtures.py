"""Stand-in views over the driver's TPC-H-like tables.

The reference works on fire incidents and daily station observations; the test
data only has the TPC-H-like star schema.  These views derive incident-,
site- and observation-shaped tables from it with fixed arithmetic (dirty
values are planted by key arithmetic so every null rule is exercised).  The
DuckDB oracle (``ignis.plans.oracle``) builds the very same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values shared with the SQL oracle: calendar of the observation spine.
OBS_START = "1995-01-01"
OBS_END = "2001-12-31"
YEAR_DAYS = 365


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident-shaped rows: orders joined to customer and nation.

    Columns: inc_id, yr, mo, dy, cause, agency, lat, lon, size_ha, calc_ha.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation has 25 rows at every scale factor: a size-bounded broadcast.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    # Natural causes: the warm half of the year in the western part, with one key in thirteen turned round, so that a
    # model can learn the cause from the features.
    warm_west = F.month("o_orderdate").between(5, 10) & ((F.col("o_custkey") * 91) % 8500 < 5500)
    natural = (warm_west & (k % 13 != 0)) | (~warm_west & (k % 13 == 0))
    cause = (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "U").when(natural, "N")
             .when(F.col("o_orderpriority") == "2-HIGH", "H-PB").otherwise("H"))
    return j.select(
        k.alias("inc_id"),
        F.year("o_orderdate").cast("int").alias("yr"),
        F.when(k % 101 == 0, F.lit(None)).otherwise(F.month("o_orderdate")).cast("int").alias("mo"),
        F.when(k % 97 == 0, F.lit(31)).otherwise(F.dayofmonth("o_orderdate")).cast("int").alias("dy"),
        cause.alias("cause"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("agency"),
        F.when(k % 59 == 0, F.lit(None))
         .otherwise(F.lit(42.0) + ((F.col("o_custkey") * 37) % 1800) / F.lit(100.0)).alias("lat"),
        (F.lit(-140.0) + ((F.col("o_custkey") * 91) % 8500) / F.lit(100.0)).alias("lon"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / F.lit(1e3)).alias("size_ha"),
        (F.col("o_totalprice") / F.lit(1.1e3)).alias("calc_ha"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-shaped rows from supplier: site_id, site_name, site_lat, site_lon."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("site_id"),
        F.col("s_name").alias("site_name"),
        (F.lit(42.0) + ((k * 53) % 1800) / F.lit(100.0)).alias("site_lat"),
        (F.lit(-140.0) + ((k * 577) % 8500) / F.lit(100.0)).alias("site_lon"),
    )


def _kept(sid, dn):
    """Site-days that the mask keeps."""
    return (sid * 7 + dn) % 40 < 22


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations: site x calendar spine left-joined to lineitem
    aggregated by (supplier, ship day), with planted gaps and duplicates.

    Columns: site_id, site_name, climate_id, site_lat, site_lon, obs_date, dn,
    copy_no, temp_max, temp_min, temp_mean, precip, rain, snow_ground, wind_gust.
    """
    n_days = F.datediff(F.lit(OBS_END).cast("date"), F.lit(OBS_START).cast("date"))
    # The spine is joined by (site, year) and its days are made after the join: only a site's years are shuffled.
    n_blocks = F.floor(n_days / YEAR_DAYS).cast("int")
    spine = sites(spark, sf_dir).withColumn("blk", F.explode(F.sequence(F.lit(0), n_blocks)))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site_id"), F.datediff(F.col("l_shipdate").cast("date"), F.lit(OBS_START).cast("date")).alias("dn"),
        "l_quantity", "l_discount", "l_tax").where(F.col("site_id").isNotNull() & F.col("dn").between(0, n_days))
    # dealt once, by (site, year): the days and the years' lists of them are made where the rows then lie
    li = li.withColumn("blk", F.floor(F.col("dn") / YEAR_DAYS).cast("int")).repartition("site_id", "blk")
    day = (li.groupBy("site_id", "blk", "dn")
           .agg((F.max("l_quantity") - F.lit(10.0)).alias("temp_max"),
                (F.min("l_quantity") - F.lit(20.0)).alias("temp_min"),
                (F.avg("l_quantity") - F.lit(15.0)).alias("temp_mean"),
                F.round(F.sum("l_discount") * F.lit(1e2), 2).alias("precip"),
                F.round(F.sum("l_tax") * F.lit(1e2), 2).alias("rain")))
    # what tells which days there are lies apart from the other measures, so that who asks for days alone reads no more
    others = ("temp_min", "temp_mean", "precip", "rain")
    held = day.groupBy("site_id", "blk").agg(F.collect_list(F.struct("dn", "temp_max")).alias("held"), F.collect_list(F.struct(*others)).alias("rest"))
    days = F.sequence(F.col("blk") * YEAR_DAYS, F.least(n_days, (F.col("blk") + 1) * YEAR_DAYS - 1))
    spine = spine.join(held, ["site_id", "blk"], "left").withColumn("held", F.coalesce("held", F.array().cast(held.schema["held"].dataType)))
    # a year's days with rows first, in the order of their list, so that a day's place finds its values; then the others
    place = F.posexplode(F.concat("held.dn", F.array_except(days, F.col("held.dn")))).alias("pos", "dn")
    spine = spine.select("site_id", "site_name", "site_lat", "site_lon", "held", "rest", place)
    spine = spine.select("site_id", "site_name", "site_lat", "site_lon", "dn", F.get("held", F.col("pos"))["temp_max"].alias("temp_max"),
                         *[F.get("rest", F.col("pos"))[m].alias(m) for m in others])
    sid, dn = F.col("site_id"), F.col("dn")
    # Every kept row appears once; where (site_id + dn) % 97 = 0 a second copy
    # (copy_no 2, precipitation + 1) follows -- generated in the same pass.
    copies = F.when((sid + dn) % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    # A site-day is kept where the mask holds or lineitem has rows for it, so the
    # gaps are days without data and every lineitem row counts.
    base = (spine.where(_kept(sid, dn) | F.col("temp_max").isNotNull())
            .withColumn("copy_no", F.explode(copies)))
    return base.select(
        sid, "site_name",
        F.concat(F.lit("C"), sid.cast("string")).alias("climate_id"),
        F.when((sid + dn) % 13 == 0, F.lit(None)).otherwise(F.col("site_lat")).alias("site_lat"),
        F.col("site_lon"),
        F.date_add(F.lit(OBS_START).cast("date"), dn).alias("obs_date"),
        dn, "copy_no",
        "temp_max", "temp_min", "temp_mean",
        F.when(F.col("copy_no") == 2, F.col("precip") + F.lit(1.0)).otherwise(F.col("precip")).alias("precip"),
        "rain",
        F.when((sid + dn) % 8 == 0, (dn % 30) * F.lit(1.0)).alias("snow_ground"),
        F.when((sid + dn) % 9 == 0, F.lit(30.0) + (dn % 50)).alias("wind_gust"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score-shaped rows: id, label, score, pred (ties on purpose)."""
    inc = incidents(spark, sf_dir).where(F.col("cause") != "U")
    label = F.when(F.col("cause") == "N", 0).otherwise(1)
    score = (F.lit(100) + F.lit(350) * label + (F.col("inc_id") * 7919) % 500) / F.lit(1e3)
    return inc.select(F.col("inc_id").alias("id"), label.alias("label"), score.alias("score")) \
              .withColumn("pred", (F.col("score") >= 0.5).cast("int"))
