"""Sampled splitters: size-weighted key samples, quantile boundaries, range
partitioning, subdivision of overfull ranges.

Records are ordered by a binary key (hash of the text, id, row number), so
equal texts lie side by side and a group of copies, whatever its size, can be
divided at any row.  A bounded sample, drawn with probability proportional to
size, gives the boundaries of fine ranges; ranges that turn out overfull are
sampled again on their own and divided.  Each range is then small enough for one
task, which numbers its rows; running totals over the ranges turn that into
exact positions, and a shard is an equal part of all bytes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ignis.llm.common import cut

#: Ranges asked of the first sample, sampled keys per range, and how often overfull ranges are divided.
RANGES, KEYS_PER_RANGE, ROUNDS = 256, 32, 4
#: A range is overfull beyond this multiple of its fair share of bytes or rows.
OVERFULL = 3.0
#: Copies stay in one shard while their group has at most this share of a shard's bytes.
WHOLE_GROUP = 0.005


def _sortable(value: Column) -> Column:
    """8 bytes whose unsigned order is the order of a long; null sorts first with the smallest."""
    low = F.lit(-(2 ** 63))
    return F.unhex(F.lpad(F.hex(F.coalesce(value.cast("long"), low).bitwiseXOR(low)), 16, "0"))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = F.xxhash64(text, F.octet_length(text))
    return cut(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(_sortable(group), _sortable(F.col(id_col)),
                 _sortable(F.monotonically_increasing_id())).alias("key"),
    ))


def _draw(rows: DataFrame, total: int, wanted: int) -> list[bytes]:
    """About ``wanted`` keys, each drawn with probability size * wanted / total
    (a key that would be due more than once is certain); sorted."""
    chance = F.col("size").cast("double") * F.lit(wanted / max(total, 1))
    point = F.pmod(F.xxhash64("key"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return sorted(bytes(r[0]) for r in rows.where(point < chance).select("key").collect())


def _quantiles(keys: list[bytes], parts: int) -> list[bytes]:
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _with_range(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Adds ``range``: how many splitters are at or below the key."""
    bounds = np.array(splitters, dtype="S24")
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(pc.cast(batch.column("key"), pa.binary(24)).buffers()[1], dtype="S24",
                                 count=batch.num_rows) if batch.num_rows else np.zeros(0, "S24")
            at = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "range"])
    return rows.mapInArrow(locate, "doc_id bigint, size bigint, text_crc32 bigint, key binary, range int")


def _totals(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range; at most as many rows as there are ranges."""
    got = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["range"]: (r["b"], r["n"]) for r in got}


def splitters(slim: DataFrame, ranges: int = RANGES) -> tuple[list[bytes], dict[int, tuple[int, int]]]:
    """Boundary keys and what lies in each range.  The driver holds the sample
    (``ranges * KEYS_PER_RANGE`` keys a round on average) and one total a range."""
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bounds = _quantiles(_draw(slim, total, ranges * KEYS_PER_RANGE), ranges)
    full = _totals(_with_range(slim, bounds))
    for _ in range(ROUNDS):
        share = max(total / ranges, 1), max(rows / ranges, 1)
        over = {k: max(b / share[0], n / share[1]) for k, (b, n) in full.items()
                if n > 1 and max(b / share[0], n / share[1]) > OVERFULL}
        if not over:
            break
        ranged = _with_range(slim, bounds).where(F.col("range").isin(list(over)))
        # rows as well as bytes can overfill a range, so this draw weighs both
        both = ranged.withColumn("size", F.col("size") * rows + F.lit(total))
        weight = sum(full[k][0] * rows + full[k][1] * total for k in over)
        fresh = _draw(both, weight, int(sum(over.values()) + 1) * KEYS_PER_RANGE)
        more: set[bytes] = set()
        for k, times in over.items():
            lo = bisect.bisect_left(fresh, bounds[k - 1]) if k else 0
            hi = bisect.bisect_left(fresh, bounds[k]) if k < len(bounds) else len(fresh)
            more.update(_quantiles(fresh[lo:hi], int(times) + 1))
        if not more - set(bounds):
            break
        bounds = sorted(more | set(bounds))
        full = _totals(_with_range(slim, bounds))
    return bounds, full


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
          ranges: int = RANGES) -> DataFrame:
    """One row per record: doc_id, size (UTF-8 bytes + 1), text_crc32, law
    ``bytes``, shard, slot (gapless from 0 in key order), grown_shard (null).

    Shards hold equal bytes but for the record, or the small group of equal
    texts, that lies across a boundary.  A null text counts as empty (size 1); a
    null id sorts first; repeated rows are records of their own; an empty table
    gives no rows; other columns are not read."""
    slim = _slim(docs, id_col, text_col)
    bounds, full = splitters(slim, ranges)
    total = sum(b for b, _ in full.values())
    before, byte, row = [], 0, 0
    for k in sorted(full):
        before.append((k, byte, row))
        byte, row = byte + full[k][0], row + full[k][1]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(before, "range int, byte_off long, row_off long")
    in_key_order = Window.partitionBy("range").orderBy("key")
    copies = Window.partitionBy("range", F.substring("key", 1, 8))
    share = max(total / n_shards, 1.0)
    placed = (
        _with_range(slim, bounds)
        .join(F.broadcast(offsets), "range")  # one row a range
        .withColumn("byte_at", F.col("byte_off") + F.sum("size").over(in_key_order) - F.col("size"))
        .withColumn("row_at", F.col("row_off") + F.row_number().over(in_key_order) - 1)
        .withColumn("group_bytes", F.sum("size").over(copies))
        .withColumn("group_at", F.min("byte_at").over(copies))
        .withColumn("cut_at", F.when(F.col("group_bytes") <= F.lit(WHOLE_GROUP * share), F.col("group_at"))
                    .otherwise(F.col("byte_at")))
        .withColumn("shard", F.least(F.floor(F.col("cut_at") / F.lit(share)), F.lit(n_shards - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row_at")
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("row_at").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row_at") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
