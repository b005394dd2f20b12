"""Station catalogue: coverage filter, clean station list, geo join and the
station x year fetch manifest (the network download itself is not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ignis.sources.fixtures import sites, table

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("STN_ID", T.LongType()), T.StructField("STATION_NAME", T.StringType()),
    T.StructField("PROV_STATE_TERR_CODE", T.StringType()), T.StructField("FIRST_DATE", T.DateType()),
    T.StructField("LAST_DATE", T.DateType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
])


def catalogue_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue-shaped rows from supplier/nation/lineitem: first and last ship
    day per supplier as the station's record period; x is missing for every
    17th station."""
    li = (table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
          .agg(F.min(F.col("l_shipdate").cast("date")).alias("FIRST_DATE"),
               F.max(F.col("l_shipdate").cast("date")).alias("LAST_DATE")))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    s = sites(spark, sf_dir)
    j = (s.join(sup, s.site_id == sup.s_suppkey).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
          .join(li, F.col("site_id") == F.col("l_suppkey"), "left"))
    return j.select(F.col("site_id").alias("STN_ID"), F.col("site_name").alias("STATION_NAME"),
                    F.col("n_name").alias("PROV_STATE_TERR_CODE"), "FIRST_DATE", "LAST_DATE",
                    F.when(F.col("site_id") % 17 == 0, F.lit(None)).otherwise(F.col("site_lon")).alias("x"),
                    F.col("site_lat").alias("y"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV scan of a station catalogue (dates parsed, no inference)."""
    return (spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd")
            .schema(CATALOGUE_SCHEMA).csv(path))


def filter_stations(catalogue: DataFrame, start_year: int = 1972, end_year: int = 2024) -> DataFrame:
    """Stations whose record covers the whole period; NAME = letters of the
    station name + '_' + province code.  Output: STATION_ID, START_YEAR,
    END_YEAR, NAME."""
    start = F.lit(f"{start_year}-01-01").cast("date")
    end = F.lit(f"{end_year}-12-31").cast("date")
    f = catalogue.where((F.col("FIRST_DATE") <= start) & (F.col("LAST_DATE") >= end))
    name = F.concat_ws("_", F.trim(F.regexp_replace("STATION_NAME", "[^A-Za-z]", "")), F.col("PROV_STATE_TERR_CODE"))
    return f.select(F.col("STN_ID").alias("STATION_ID"), F.lit(start_year).alias("START_YEAR"),
                    F.lit(end_year).alias("END_YEAR"), name.alias("NAME"))


def station_geo(station_list: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Station list + catalogue coordinates; stations without x/y are dropped."""
    cat = catalogue.select("STN_ID", "x", "y")
    return (station_list.join(cat, station_list.STATION_ID == cat.STN_ID, "left")
            .drop("STN_ID").na.drop(subset=["x", "y"]))


def fetch_manifest(station_list: DataFrame, existing: DataFrame, base_url: str) -> DataFrame:
    """One row per station x year in the station's range: target file name and
    request URL; files that already exist with a non-empty size are skipped.
    ``existing`` has (file_name, size)."""
    years = station_list.select("STATION_ID", "NAME",
                                F.explode(F.sequence(F.col("START_YEAR"), F.col("END_YEAR"))).alias("year"))
    m = years.select("STATION_ID", "NAME", "year",
                     F.format_string("climate_daily_%s_%d.csv", F.col("NAME"), F.col("year")).alias("file_name"),
                     F.format_string(base_url + "?format=csv&stationID=%d&Year=%d&Month=1&Day=1&timeframe=2",
                                     F.col("STATION_ID"), F.col("year")).alias("url"))
    done = existing.where(F.col("size") > 0).select("file_name")
    return m.join(done, "file_name", "left_anti")
