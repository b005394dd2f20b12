"""File sources and sinks."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from ignis.sources import files as FS
from ignis.sources.stations import fetch_manifest, filter_stations, read_catalogue


def _write(path, text, encoding):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_csv_union_by_name_with_encodings(spark):
    d = tempfile.mkdtemp(prefix="ignis-csv-")
    _write(f"{d}/climate_daily_A_2000.csv", "Station Name,Year,Max Temp (°C)\nA,2000,12.5\nA,2000,\n", "utf-8-sig")
    _write(f"{d}/climate_daily_B_2000.csv", "Year,Station Name,Total Precip (mm),Max Temp (°C)\n2000,B,3.0,7\n", "utf-8")
    df = FS.read_csv_union(spark, f"{d}/*.csv")
    assert set(df.columns) == {"station_name", "year", "max_temp_c", "total_precip_mm", "source_file", "source_pos"}
    from ignis.operators.tables import first_non_null
    first = first_non_null(df, "station_name", ["max_temp_c"], ["source_file", "source_pos"]).collect()
    assert {r.station_name: r.max_temp_c for r in first} == {"A": "12.5", "B": "7"}
    df = df.drop("source_pos")
    rows = sorted(((r.station_name, r.max_temp_c, r.total_precip_mm, r.source_file) for r in df.collect()),
                  key=lambda t: tuple("" if v is None else v for v in t))
    assert rows == [("A", None, None, "climate_daily_A_2000.csv"), ("A", "12.5", None, "climate_daily_A_2000.csv"),
                    ("B", "7", "3.0", "climate_daily_B_2000.csv")]


def test_latin1_csv(spark):
    d = tempfile.mkdtemp(prefix="ignis-csv-")
    _write(f"{d}/x.csv", "Station Name,Max Temp (°C)\nMontréal,3\n", "latin-1")
    df = FS.read_csv_union(spark, f"{d}/*.csv", encoding="ISO-8859-1")
    assert df.first().station_name == "Montréal"


def test_rejects_are_counted(spark):
    d = tempfile.mkdtemp(prefix="ignis-csv-")
    _write(f"{d}/bad.csv", 'a,b\n1,2\n3,4,5\n6\n', "utf-8")
    _write(f"{d}/good.csv", 'a,b\n1,2\n', "utf-8")
    df = FS.read_csv_union(spark, f"{d}/*.csv", keep_corrupt=True)
    assert {r.source_file: r.rejected for r in FS.rejects(df).collect()} == {"bad.csv": 2}


def test_truncated_gzip_is_an_error_or_left_out_and_reported(spark):
    d = tempfile.mkdtemp(prefix="ignis-csv-")
    body = gzip.compress(("a,b\n" + "".join(f"{i},{i * i % 9973}\n" for i in range(20_000))).encode())
    with open(f"{d}/cut.csv.gz", "wb") as f:
        f.write(body[: len(body) // 2])
    with open(f"{d}/whole.csv.gz", "wb") as f:
        f.write(gzip.compress(b"a,b\n1,2\n3\n"))
    with pytest.raises(Exception):
        FS.read_csv_union(spark, f"{d}/*.csv.gz").count()
    assert FS.read_csv_union(spark, f"{d}/*.csv.gz", skip_unreadable=True).count() == 2
    got = {(r.source_file, r.reason, r.rejected) for r in FS.rejected_files(spark, f"{d}/*.csv.gz").collect()}
    assert got == {("cut.csv.gz", "EOFError", None), ("whole.csv.gz", "malformed lines", 1)}


def test_unreadable_files_are_streamed_in_pieces(spark):
    d = tempfile.mkdtemp(prefix="ignis csv-")
    lines = "a,b\n" + "".join(f"{i},é{i * i % 9973}\n" for i in range(20_000))
    body = gzip.compress(lines.encode(), compresslevel=1)
    odd = lines.encode()[:150_000] + b"\xff" + lines.encode()[150_000:]
    for name, data in {"ok.csv": lines.encode(), "odd.csv": odd, "cut.csv": lines.encode() + "é".encode()[:1], "none.csv": b"",
                       "ok.csv.gz": body, "two.csv.gz": body + body, "cut.csv.gz": body[:-1], "odd.csv.gz": gzip.compress(odd),
                       "not.csv.gz": b"\n", "empty.csv.gz": b"", "line.csv.gz": gzip.compress(b"\n" * 10)}.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)  # several splits of a file
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1_000)  # no file may be held whole as one row
        got = {r.source_file: (r.file_path, r.reason) for r in FS.unreadable_files(spark, d).collect()}
        assert {k: v[1] for k, v in got.items()} == {
            "odd.csv": "UnicodeDecodeError", "cut.csv": "UnicodeDecodeError", "cut.csv.gz": "EOFError",
            "odd.csv.gz": "UnicodeDecodeError", "not.csv.gz": "BadGzipFile"}
        assert all(path == f"file:{d}/{name}" for name, (path, _) in got.items())
        e = tempfile.mkdtemp(prefix="ignis-csv-")
        _write(f"{e}/ok.csv", lines + "ਊ\n", "utf-16")  # U+0A0A has newline bytes within
        with open(f"{e}/odd.csv", "wb") as f:
            f.write(lines.encode("utf-16") + b"\n")
        assert [r.source_file for r in FS.unreadable_files(spark, e, "UTF-16").collect()] == ["odd.csv"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_csv_rejects_has_a_file_for_each_partition(spark):
    from conftest import SF01

    from ignis.plans import queries
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    d, wrote = tempfile.mkdtemp(prefix="ignis-orders-"), []
    spark.read.parquet(f"{SF01}/orders.parquet").repartition(6).write.parquet(f"{d}/orders.parquet")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
        old = FS.rejected_files
        FS.rejected_files = lambda s, path, *a: (wrote.append(path), old(s, path, *a))[1]
        got = [tuple(r) for r in queries.q_csv_rejects(spark, d).collect()]
    finally:
        FS.rejected_files = old
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    want = spark.read.parquet(f"{SF01}/orders.parquet").where("o_orderkey % 200 = 0").count()
    assert got == [("malformed lines", want)]
    assert spark.read.format("binaryFile").load(wrote[0]).select("path").count() > 4


def test_optional_source(spark):
    schema = T.StructType([T.StructField("YEAR", T.StringType())])
    assert FS.read_optional(spark, "/nonexistent/ignis/path", schema).count() == 0
    d = tempfile.mkdtemp(prefix="ignis-opt-")
    spark.range(5).write.parquet(f"{d}/t")
    odd = T.StructType([T.StructField("id", T.CalendarIntervalType())])
    with pytest.raises(Exception):  # there, but unreadable: not an empty table
        FS.read_optional(spark, f"{d}/t", odd).count()


def test_materialize_builds_only_when_absent(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="ignis-mat-"), "t")
    built = []
    def build(n):
        built.append(n)
        return spark.range(n)
    a = FS.materialize(spark, lambda: build(5), p)
    b = FS.materialize(spark, lambda: build(50), p)
    assert a.count() == 5 and b.count() == 5 and built == [5]
    os.remove(f"{p}/_SUCCESS")  # a write that didn't end is done again
    assert FS.materialize(spark, lambda: build(7), p).count() == 7


def _bytes_read(spark):
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(stats[i].getBytesRead() for i in range(len(stats)))


def test_headers_read_the_same_of_larger_files(spark):
    d = tempfile.mkdtemp(prefix="ignis-head-")
    read = {}
    for size in (100_000, 3_000_000):
        os.makedirs(f"{d}/{size}")
        for k in range(3):
            _write(f"{d}/{size}/f{k}.csv", f"a,b,{k}\n" + f"1,2,{k}\n" * size, "utf-8")
        before = _bytes_read(spark)
        got = {r.file_path.rsplit("/", 1)[1]: r.header for r in FS.file_headers(spark, f"{d}/{size}").collect()}
        read[size] = _bytes_read(spark) - before
        assert got == {f"f{k}.csv": f"a,b,{k}" for k in range(3)}
    assert read[3_000_000] < 2 * read[100_000] + 1_000_000 and read[3_000_000] < 0.2 * 3 * 6 * 3_000_000


def test_two_builders_at_once_and_a_dead_one(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="ignis-mat-"), "t")
    inner = []
    def slow():  # while this build runs, another one begins and ends
        inner.append(FS.materialize(spark, lambda: spark.range(3), p))
        return spark.range(8)
    outer = FS.materialize(spark, slow, p)
    assert outer.count() == inner[0].count() == 3  # both read what was published first
    assert len([n for n in os.listdir(p) if n.startswith("attempt-")]) == 1
    dead = os.path.join(os.path.dirname(p), "u")
    def dies():
        spark.range(4).write.parquet(f"{dead}/attempt-of-one-that-died")
        raise RuntimeError("lost")
    try:
        FS.materialize(spark, dies, dead)
    except RuntimeError:
        pass
    assert FS.published(spark, dead) is None
    assert FS.materialize(spark, lambda: spark.range(6), dead).count() == 6
    assert os.path.isdir(f"{dead}/attempt-of-one-that-died")  # not old enough to be swept
    os.utime(f"{dead}/attempt-of-one-that-died", (0, 0))
    os.remove(f"{dead}/_SUCCESS")
    assert FS.materialize(spark, lambda: spark.range(7), dead).count() == 7
    assert not os.path.isdir(f"{dead}/attempt-of-one-that-died")


def test_builders_in_threads_agree(spark):
    from concurrent.futures import ThreadPoolExecutor
    p = os.path.join(tempfile.mkdtemp(prefix="ignis-mat-"), "t")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: FS.materialize(spark, lambda: spark.range(n), p).count(), range(10, 16)))
    assert len(set(got)) == 1 and len([n for n in os.listdir(p) if n.startswith("attempt-")]) == 1


def test_put_if_absent(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="ignis-put-"), "x")
    assert FS.read_small(spark, p) is None
    assert FS.put_if_absent(spark, p, "one é") and not FS.put_if_absent(spark, p, "two")
    assert FS.read_small(spark, p) == "one é" and [n for n in os.listdir(os.path.dirname(p)) if not n.startswith(".")] == ["x"]


def test_stored_tables_depend_on_parameters(spark):
    from conftest import SF001

    from ignis.plans import views as V
    one, same, other = (V.stored(spark, SF001, "params_test", lambda n=n: spark.range(n), params={"n": k}) for n, k in ((3, 1), (4, 1), (5, 2)))
    assert (one.count(), same.count(), other.count()) == (3, 3, 5)


def test_geojson_country_filter(spark):
    d = tempfile.mkdtemp(prefix="ignis-geo-")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"iso_a2": "CA", "name": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"iso_a2": "US", "name": "y"}, "geometry": {"type": "Point", "coordinates": [3, 4]}}]}
    with open(f"{d}/b.geojson", "w") as f:
        json.dump(fc, f, indent=2)
    assert FS.read_geojson_features(spark, f"{d}/b.geojson", keep="CA").count() == 1


def test_station_filter_manifest_and_csv_sink(spark):
    d = tempfile.mkdtemp(prefix="ignis-st-")
    _write(f"{d}/cat.csv", "STN_ID,STATION_NAME,PROV_STATE_TERR_CODE,FIRST_DATE,LAST_DATE,x,y\n"
                           "1,FORT ST. JOHN A,BC,1942-01-01,2025-01-01,-120.7,56.2\n"
                           "2,SHORT,AB,1990-01-01,2025-01-01,-110,50\n", "utf-8")
    st = filter_stations(read_catalogue(spark, f"{d}/cat.csv"), 1972, 2024).collect()
    assert [(r.STATION_ID, r.NAME) for r in st] == [(1, "FORTSTJOHNA_BC")]
    sl = spark.createDataFrame([(1, 2000, 2002, "X_BC")], "STATION_ID long, START_YEAR int, END_YEAR int, NAME string")
    ex = spark.createDataFrame([("climate_daily_X_BC_2000.csv", 10), ("climate_daily_X_BC_2001.csv", 0)],
                               "file_name string, size long")
    got = sorted(r.year for r in fetch_manifest(sl, ex, "bulk://x").collect())
    assert got == [2001, 2002]
    FS.write_csv(sl, f"{d}/out")
    assert spark.read.option("header", True).csv(f"{d}/out").count() == 1


def test_first_non_null_in_file_order(spark):
    from ignis.operators.tables import first_non_null
    d = tempfile.mkdtemp(prefix="ignis-csv-")
    _write(f"{d}/a_1.csv", "Station Name,Max Temp (°C)\nA,\nA,9\nA,12.5\nB,4\n", "utf-8")
    _write(f"{d}/a_2.csv", "Station Name,Max Temp (°C)\nA,1\nB,0\n", "utf-8")
    df = FS.read_csv_union(spark, f"{d}/*.csv")
    first = first_non_null(df, "station_name", ["max_temp_c"], ["source_file", "source_pos"]).collect()
    assert {r.station_name: r.max_temp_c for r in first} == {"A": "9", "B": "4"}


def _collection(seed, n):
    import random
    r = random.Random(seed)
    words = ['plain', 'br{ace', '}close{', 'quo"te', 'back\\\\slash', '"}]},{"type":"Feature"', 'tab\t', 'é[x]', '\\"', '']
    features = [{"type": "Feature", "properties": {"iso_a2": r.choice(["CA", "US", None]), "id": i, "name": "".join(r.choice(words) for _ in range(r.randrange(6))),
                                                   "more": {"list": [{"a": "}"}, {"a": "{"}]}},
                 "geometry": {"type": "Polygon", "coordinates": [[[r.random(), i], [1.5, 2.5]]]}} for i in range(n)]
    return {"type": "FeatureCollection", "name": "odd } name", "crs": {"properties": {"name": "x"}}, "bbox": [1, 2, 3, 4], "features": features}


def test_one_large_collection_is_read_by_many_tasks(spark):
    from pyspark.sql import functions as F
    for seed, n, indent, most in ((1, 300, None, 700), (2, 60, 2, 97), (3, 1, None, 40), (4, 200, 1, 1 << 20)):
        d = tempfile.mkdtemp(prefix="ignis-geo-")
        whole = _collection(seed, n)
        with open(f"{d}/one.geojson", "w") as f:
            json.dump(whole, f, indent=indent, ensure_ascii=seed % 2 == 0)
        with open(f"{d}/two.geojson", "w") as f:
            json.dump(_collection(seed + 10, 7), f)
        old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            lines = FS.geojson_feature_lines(spark, d)
            got = [json.loads(r.feature) for r in lines.where("source_file = 'one.geojson'").collect()]
            key = lambda f: f["properties"]["id"]
            assert sorted(got, key=key) == whole["features"] and lines.count() == n + 7
            if most < 1000:
                assert spark.read.option("lineSep", "}").text(f"{d}/one.geojson").rdd.getNumPartitions() > 5
            feats = FS.read_geojson_features(spark, d)
            raw = spark.read.option("multiLine", True).json(d).select(F.explode("features").alias("f"))
            want = raw.select(F.col("f.properties.iso_a2").alias("code"), F.to_json("f.properties").alias("p"), F.to_json("f.geometry").alias("g"))
            mine = feats.select("code", F.to_json("properties").alias("p"), F.to_json("geometry").alias("g"))
            assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect()))
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
