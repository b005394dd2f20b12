"""File scans and sinks: multi-file CSV unioned by column name, encodings,
lineage column, rejected-row counts, write-if-absent caching, GeoJSON."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import chain, groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ignis.session import scratch_path


def snake(name: str) -> str:
    """'Max Temp (°C)' -> 'max_temp_c'; 'Longitude (x)' -> 'longitude_x'."""
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip().lstrip("﻿")).strip("_").lower()
    return s or "col"


class _Pieces(io.RawIOBase):
    """The bytes of an iterator of pieces, as a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(piece)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _raw_pieces(rows: Iterator[tuple], size: int) -> Iterator[bytes]:
    """A file's bytes from its rows, which were cut at each newline; whether it
    ends with one is told by its size."""
    done = 0
    for i, (*_, value) in enumerate(rows):
        piece = b"\n" + value if i else value
        done += len(piece)
        yield piece
    if done < size:
        yield b"\n"


def unreadable_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(source_file, file_path, reason) of the files under ``path`` that can't be
    decompressed or decoded to their end.

    Spark's text reader gives the files' bytes, cut at newlines, from any store
    and whatever the size: no file is ever held whole.  A .gz file comes as it
    is stored (a codec that passes bytes through) and is streamed by one task;
    other files are decoded split by split, as a newline is a byte of its own
    in the encoding, or else (UTF-16, UTF-32) from splits put in order again."""
    wide = len("\n".encode(encoding)) > 1
    raw = (spark.read.option("lineSep", "\n").option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
           .option("io.compress.passthrough.extension", ".gz")
           .option("org.apache.hadoop.shaded.io.compress.passthrough.extension", ".gz").text(path)  # its name in Spark's own Hadoop jar
           .select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"),
                   F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("pos"),
                   F.col("value").cast("binary").alias("value")))
    if wide:
        raw = raw.repartition("uri").sortWithinPartitions("uri", "start", "pos")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns[:3]), (v.as_py() for v in batch.column("value")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = []
        for (name, _), own in groupby(rows(batches), key=lambda r: (r[0], 0 if wide else r[1])):
            try:
                first = next(own)
                data = io.BufferedReader(_Pieces(_raw_pieces(chain([first], own), first[2] if wide or name.endswith(".gz") else 0)))
                text = io.TextIOWrapper(gzip.GzipFile(fileobj=data, mode="rb") if name.endswith(".gz") else data, encoding=encoding)
                while text.read(1 << 20):
                    pass
            except (EOFError, OSError, UnicodeError, zlib.error) as e:
                bad.append((name, type(e).__name__))
        yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in bad], pa.string()) for i in range(2)], ["uri", "reason"])
    found = raw.select("uri", "start", "size", "value").mapInArrow(check, "uri string, reason string")
    return found.groupBy("uri").agg(F.min("reason").alias("reason")).join(_listed(spark, path), "uri").select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("path").alias("file_path"), "reason")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, uri) of the files under ``path``; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("uri"))


#: Files opened at a time to read their headers.
HEADER_THREADS = 16


def file_headers(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file_path, header) for every file under ``path``: the first line of each;
    files without a line have no row.

    Each file is opened through Hadoop and read to the end of its first line, so
    the bytes read don't grow with the files: no scan of Spark's ends so early.  One
    line a file passes through the driver, as the file index does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(name: str) -> str | None:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
            source = codec.createInputStream(stream) if codec is not None else stream
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, encoding)).readLine()
        finally:
            stream.close()
    files = [(r["path"], r["uri"]) for r in _listed(spark, path).collect()]
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        lines = list(pool.map(lambda f: head(f[0]), files))
    found = [(uri, re.sub("^\ufeff", "", line)) for (_, uri), line in zip(files, lines) if line is not None]
    return spark.createDataFrame(found, "file_path string, header string")


def read_csv_union(spark: SparkSession, path: str, encoding: str = "UTF-8", rename=snake,
                   lineage: bool = True, keep_corrupt: bool = False, skip_unreadable: bool = False) -> DataFrame:
    """Scan every CSV under ``path`` and union them **by column name**.

    Files are grouped by header line; each group is read with its own header
    (all columns as strings, no inference), columns are renamed with
    ``rename`` and the groups are combined with
    ``unionByName(allowMissingColumns=True)``.  ``source_file`` carries the
    file name.  A file that can't be read to its end is an error, or, with
    ``skip_unreadable``, is left out whole (``unreadable_files`` names it);
    ``keep_corrupt`` keeps malformed lines in ``_corrupt_record`` so
    ``rejects`` can count them per file.  Only the distinct headers and the file
    list -- which Spark's file index holds on the driver anyway -- are brought to
    the driver.
    """
    files: str | list[str] = path
    if skip_unreadable:
        bad = {r["file_path"] for r in unreadable_files(spark, path, encoding).collect()}
        listed = [r["path"] for r in _listed(spark, path).collect()]
        files = sorted(f for f in listed if f not in bad)
        if not files:
            raise FileNotFoundError(f"no readable file: {path}")
    heads = file_headers(spark, files, encoding)
    groups: dict[str, list[str]] = {}
    for r in heads.collect():
        groups.setdefault(r["header"], []).append(r["file_path"])
    parts = []
    for header, members in sorted(groups.items()):
        names = next(iter(_csv_rows([header])))
        fields = [T.StructField(n, T.StringType()) for n in names]
        if keep_corrupt:
            fields.append(T.StructField("_corrupt_record", T.StringType()))
        reader = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
                  .option("enforceSchema", True)
                  .schema(T.StructType(fields)))
        df = reader.csv(sorted(members))
        cols = [F.col(f"`{n}`").alias(rename(n)) for n in names]
        if keep_corrupt:
            cols.append(F.col("_corrupt_record"))
        if lineage:
            # file name plus a position that increases with the line order of
            # each file (splits of one file are read in offset order), so
            # "first row in sorted file order" is (source_file, source_pos)
            cols.append(F.col("_metadata.file_name").alias("source_file"))
            cols.append(F.col("_metadata.file_block_start").alias("__blk_start"))
            cols.append(F.monotonically_increasing_id().alias("__mono"))
        part = df.select(*cols)
        if lineage:
            part = (part.withColumn("source_pos", F.struct("__blk_start", "__mono"))
                        .drop("__blk_start", "__mono"))
        parts.append(part)
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _csv_rows(lines):
    import csv
    return csv.reader(lines)


def rejected_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(source_file, reason, rejected): files that were left out whole, and the
    malformed lines of the others."""
    whole = unreadable_files(spark, path, encoding).select("source_file", "reason", F.lit(None).cast("long").alias("rejected"))
    lines = rejects(read_csv_union(spark, path, encoding, keep_corrupt=True, skip_unreadable=True))
    return whole.unionByName(lines.select("source_file", F.lit("malformed lines").alias("reason"), "rejected"))


def rejects(df: DataFrame) -> DataFrame:
    """Lines the CSV parser could not read (PERMISSIVE mode), counted per file."""
    # the parser only judges lines whose fields are asked for: the hash asks for all and is always in its range
    fields = F.hash(*[F.col(f"`{c}`") for c in df.columns if c not in ("_corrupt_record", "source_file", "source_pos")])
    return (df.where(F.col("_corrupt_record").isNotNull() & (fields >= F.lit(-(2 ** 31))))
              .groupBy("source_file").agg(F.count(F.lit(1)).alias("rejected")))


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **opts) -> DataFrame:
    """Scan ``path`` with a declared schema; an absent source gives an empty
    table, and any other failure is raised."""
    try:
        return spark.read.schema(schema).options(**opts).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Spreadsheet-style preview: (shape, head).  ``shape`` is one row
    (n_rows, n_cols); ``head`` the first ``n`` rows in ``order_by`` order (a
    top-k, not a sort of the whole table)."""
    shape = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
    head = (df.orderBy(*order_by) if order_by else df).limit(n)
    return shape, head


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header line and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them; a local one without its checksum files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    checked = is_instance_of(spark.sparkContext._gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem")
    return (fs.getRawFileSystem() if checked else fs), at


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that is there whole or not at all, and never in another's
    place; whether it was this call that did."""
    jvm = spark.sparkContext._jvm
    folder, name = path.rstrip("/").rsplit("/", 1)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"  # hidden from readers of the folder
    fs, at = _fs(spark, own)
    stream = fs.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(at), fs.makeQualified(_fs(spark, path)[1]), none)  # fails where the name is taken
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(at, False)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible files and folders in a folder; none where there is no folder."""
    fs, at = _fs(spark, path)
    found = [status.getPath().getName() for status in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that this job has written."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Changes when a file at or directly under one of the paths does (name, length, time)."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        for status in path.getFileSystem(conf).listStatus(path):
            found.append((str(status.getPath()), status.getLen(), status.getModificationTime()))
    return hashlib.sha1(repr(sorted(found)).encode()).hexdigest()[:16]


@lru_cache(maxsize=None)
def code_version() -> str:
    """Changes when the code that derives tables does."""
    root = Path(__file__).parent.parent
    parts = sorted(p for d in ("functions", "operators", "plans", "sources") for p in (root / d).glob("*.py"))
    return hashlib.sha1(b"".join(p.name.encode() + p.read_bytes() for p in parts)).hexdigest()[:16]


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the attempt that counts at ``path``; None where no build has ended."""
    name = read_small(spark, f"{path.rstrip('/')}/_SUCCESS")
    return f"{path.rstrip('/')}/{name}" if name else None


#: Hours after which an attempt that was not published is one of a builder that died.
STALE_HOURS = 48


def _sweep(spark: SparkSession, path: str, keep: str) -> None:
    """Deletes unpublished attempts of builders that died long ago."""
    fs, at = _fs(spark, path)
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("attempt-") and name != keep and now - status.getModificationTime() > STALE_HOURS * 3_600_000:
            fs.delete(status.getPath(), True)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write-if-absent Parquet cache: read the table at ``path``; only where no build
    of it has ended, call ``build`` and write it first.  Operators may run jobs
    while a frame is being built, so the frame itself is built only then.  The
    stored table also cuts the lineage of everything downstream.

    Every builder writes an attempt folder of its own, and a pointer that can be
    put only once names the one that counts.  So builders at once don't touch each
    other's files, all read the same table, and a builder that dies leaves nothing
    that is read; an attempt that came second is deleted again."""
    at = published(spark, path)
    if at is None:
        path = path.rstrip("/")
        attempt = f"attempt-{uuid.uuid4().hex}"
        w = build().write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/{attempt}")
        if put_if_absent(spark, f"{path}/_SUCCESS", attempt):
            _sweep(spark, path, attempt)
        else:
            remove(spark, f"{path}/{attempt}")
        at = published(spark, path)
    return spark.read.parquet(at)


def _json_levels(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of the braces and brackets of a stretch of JSON that stand outside
    strings, the depth after each, which open, and whether the stretch ends inside a
    string; ``inside`` and ``depth`` tell how it begins."""
    raw = np.frombuffer(re.sub(rb"\\.", b"  ", data, flags=re.DOTALL), dtype=np.uint8)
    quotes = np.cumsum(raw == ord('"'))
    spots = np.flatnonzero(np.isin(raw, np.frombuffer(b"{}[]", dtype=np.uint8)))
    spots = spots[(quotes[spots] + inside) % 2 == 0]
    opens = (raw[spots] == ord("{")) | (raw[spots] == ord("["))
    ends_inside = bool((int(quotes[-1]) if len(quotes) else 0) + inside & 1)
    return spots, depth + np.cumsum(np.where(opens, 1, -1)), opens, ends_inside


def _split_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, start of the split, its bytes piece by piece), split by split."""
    def rows():
        for batch in batches:
            yield from zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), (v.as_py() for v in batch.column("value")))
    for (uri, start), own in groupby(rows(), key=lambda r: r[:2]):
        def pieces(own=own):
            held, size = [], 0
            for *_, value in own:
                held.append(value + b"}")  # the reader cuts at braces
                size += len(value) + 1
                if size > 1 << 20:
                    yield b"".join(held)
                    held, size = [], 0
            if held:
                yield b"".join(held)
        yield uri, start, pieces()


#: Depth inside a feature: the collection, its array, the feature.
_FEATURE_DEPTH = 3


def geojson_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, feature) of every feature of the FeatureCollections under
    ``path``, one line of JSON each: the objects two levels below a file's top
    object whose type is Feature.  Files may be of any size.

    A file is read in splits.  A first pass over them counts, for each, what it does
    to the depth whether it begins inside a string or outside; from that the driver
    knows how each begins (a row a split).  So in the second pass every task finds the
    features of its own splits, strings and escapes told apart from structure; pieces
    of a feature that lies across splits are put together after it."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for uri, start, pieces in _split_bytes(batches):
            inside, depth = [False, True], [0, 0]  # begun outside a string, and inside one
            for data in pieces:
                for h in range(2):
                    _, levels, _, inside[h] = _json_levels(data, inside[h], depth[h])
                    depth[h] = int(levels[-1]) if len(levels) else depth[h]
            out.append((uri, start, inside[0], depth[0], depth[1]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))],
                                         ["uri", "start", "flips", "outside", "inside"])
    begins, known = {}, {}
    measured = raw.mapInArrow(measure, "uri string, start long, flips boolean, outside long, inside long").collect()
    for r in sorted(measured, key=lambda r: (r["uri"], r["start"])):
        inside, depth = known.get(r["uri"], (False, 0))
        begins[r["uri"], r["start"]] = (inside, depth)
        known[r["uri"]] = (inside ^ r["flips"], depth + (r["inside"] if inside else r["outside"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, start, pieces in _split_bytes(batches):
            inside, depth = begins[uri, start]
            held, fragments, whole, place = [], [], [], 0
            begun_here = False
            for data in pieces:
                spots, levels, opens, ends_inside = _json_levels(data, inside, depth)
                edge = 0
                for i in np.flatnonzero((opens & (levels == _FEATURE_DEPTH)) | (~opens & (levels == _FEATURE_DEPTH - 1))).tolist():
                    at = int(spots[i])
                    if data[at] not in b"{}":
                        continue
                    if opens[i]:
                        held, edge, begun_here = [], at, True
                    elif data[at:at + 1] == b"}":
                        text = b"".join([*held, data[edge:at + 1]])
                        (whole if begun_here else fragments).append((place, text, True, begun_here))
                        held, edge, begun_here, place = [], at + 1, False, place + 1
                inside, depth = ends_inside, int(levels[-1]) if len(levels) else depth
                if depth >= _FEATURE_DEPTH:
                    held.append(data[edge:])
                else:
                    held = []
            if held and depth >= _FEATURE_DEPTH:
                fragments.append((place, b"".join(held), False, begun_here))
            rows = [(uri, start, p, t.decode(), e, b) for p, t, e, b in (*whole, *fragments)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], ["uri", "start", "place", "text", "ends", "begins"])
    parts = raw.mapInArrow(cut, "uri string, start long, place int, text string, ends boolean, begins boolean").checkpoint(eager=True)
    done = parts.where("begins AND ends").select("uri", F.col("text").alias("feature"))
    # pieces: two a split at most; a feature's follow the one that begins it
    order = Window.partitionBy("uri").orderBy("start", "place")
    loose = parts.where("NOT (begins AND ends)").withColumn("nth", F.sum(F.col("begins").cast("int")).over(order))
    joined = loose.groupBy("uri", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"]), "")
                                             .alias("feature")).select("uri", "feature")
    one_line = F.regexp_replace("feature", r"[\r\n]+", " ")  # a line break in JSON stands between tokens only
    found = done.unionByName(joined).where(F.get_json_object("feature", "$.type") == "Feature")
    return found.select(F.element_at(F.split("uri", "/"), -1).alias("source_file"), one_line.alias("feature"))


def read_geojson_features(spark: SparkSession, path: str, prop_names: Sequence[str] = ("iso_a2", "ISO_A2"),
                          keep: str | None = None) -> DataFrame:
    """One row per feature of the GeoJSON FeatureCollections under ``path``; ``code`` =
    the first present property among ``prop_names``; optionally keep only features
    whose code equals ``keep``.  The features are landed as lines of JSON in the
    shared folder and read from there, so a large file is read by many tasks."""
    lines = scratch_path(spark, f"geojson_{uuid.uuid4().hex}")
    geojson_feature_lines(spark, path).select("feature").write.text(lines)
    feats = spark.read.json(lines)
    props = feats.schema["properties"].dataType.fieldNames() if "properties" in feats.columns else []
    present = [p for p in prop_names if p in props]
    code = F.coalesce(*[F.col(f"properties.{p}").cast("string") for p in present]) if present else F.lit(None).cast("string")
    out = feats.where("type = 'Feature'") if "type" in feats.columns else feats
    out = out.select(code.alias("code"), *[F.col(c) if c in feats.columns else F.lit(None).cast("string").alias(c) for c in ("properties", "geometry")])
    return out.where(F.col("code") == keep) if keep is not None else out
