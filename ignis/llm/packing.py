"""Sequence packing by non-negative least squares.

Documents are cut into full windows and a remainder.  The histogram of
remainder lengths (at most ``window`` numbers, whatever the input) is matched
by repeat counts of shallow combinations of lengths that fill a window exactly;
the counts come from a non-negative least squares fit, are rounded down to what
the histogram holds, and what is left is packed greedily.  All of that is
histogram arithmetic on the driver; which piece goes where is then a matter of
its rank among pieces of its length, which Spark finds with a window over
(bucket, length), so that a length shared by a third of all pieces is spread
over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at
from ignis.llm.common import cut
from ignis.llm.tokens import encode_slice

WINDOW, END = 2048, 1
#: Combinations tried at most (a bound of the plan's size, not of the data) and rounds of the fit.
COMBINATIONS, FIT_ROUNDS = 40_000, 250
#: Pieces a bucket should hold; there are as many buckets as that takes.
BUCKET_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids) of each piece:
    full windows of a document and its remainder, end token included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([END], dtype="<u4").tobytes()
        for part in at.text_slices(batches):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, raw in enumerate(encode_slice(part.column("text"), tokenizer)):
                raw += tail
                n = len(raw) // 4
                for s in range(0, n, window):
                    piece = raw[4 * s: 4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return source.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def combinations(lengths: np.ndarray, window: int, limit: int = COMBINATIONS) -> np.ndarray:
    """Pairs and triples (0 for none) of the given lengths that sum to the
    window.  Where there are more triples than the limit, the longest length of
    a triple runs over every second, third ... of the lengths."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    long = lengths[(lengths * 2 >= window) & (lengths < window)]
    out = [np.stack([long, window - long, np.zeros_like(long)], 1)[have[window - long]]] if len(long) else []
    first = lengths[(lengths * 3 >= window) & (lengths < window - 1)][::-1]
    step = 1
    while len(first[::step]) * len(lengths) > 6 * limit:
        step += 1
    for a in first[::step]:
        b = lengths[(lengths <= a) & (lengths * 2 >= window - a) & (lengths < window - a)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    found = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
    return found[:: max(1, -(-len(found) // limit))] if len(found) > limit else found


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |W(Ax - histogram)|^2, where A counts the lengths in
    each combination and W weighs long lengths more, since they are the hard
    ones to place; by accelerated projected gradients."""
    n = len(histogram)
    weight = (np.arange(n) / max(n - 1, 1)) + 0.05
    weight[0] = 0.0  # no length
    ahead = lambda x: np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=n)
    back = lambda r: (weight * r)[combos].sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(12):  # largest eigenvalue of A'WA
        v = back(ahead(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / max(top * 1.05, 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(ahead(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Groups of equal sequences: (repeats, lengths)."""

    groups: list[tuple[int, tuple[int, ...]]]


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Sequences that hold exactly the pieces of the histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[int, tuple[int, ...]]] = []
    if left[window]:
        groups.append((int(left[window]), (window,)))
        left[window] = 0
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), dtype=np.int64)
    if len(combos):
        x = repeat_counts(combos, left[:window + 1].astype(np.float64))
        for whole in (True, False):  # rounded down first, then one more where the fraction was largest
            for c in np.argsort(-(x if whole else x - np.floor(x)), kind="stable"):
                wanted = int(x[c]) if whole else 1
                if whole and not wanted:
                    break
                if not whole and x[c] < 1e-3:
                    continue
                parts = tuple(int(p) for p in combos[c] if p)
                need = {p: parts.count(p) for p in parts}
                times = min(wanted, *(int(left[p]) // k for p, k in need.items()))
                if times > 0:
                    groups.append((times, parts))
                    for p, k in need.items():
                        left[p] -= times * k
    while True:  # greedy: the longest piece left, then always the longest that still fits
        present = np.flatnonzero(left)
        if not len(present):
            return Plan(groups)
        parts, room, used = [], window, {}
        while room:
            fits = present[present <= room]
            fits = fits[[left[p] > used.get(int(p), 0) for p in fits]] if len(used) else fits
            if not len(fits):
                break
            p = int(fits[-1])
            k = min(room // p, int(left[p]) - used.get(p, 0))
            parts += [p] * k
            used[p] = used.get(p, 0) + k
            room -= p * k
        times = min(int(left[p]) // k for p, k in used.items())
        groups.append((times, tuple(parts)))
        for p, k in used.items():
            left[p] -= times * k


def slots(p: Plan) -> dict[str, np.ndarray]:
    """For each (length, first rank): how many ranks, their first sequence and
    offset; sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for times, parts in p.groups:
        offset = 0
        for length in parts:
            first = taken.get(length, 0)
            rows.append((length, first, base, offset))
            taken[length] = first + times
            offset += length
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def place(cut_pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces (any columns beside doc_id, start, length) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(by_length.values())
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in by_length.items():
        histogram[length] = n
    where = slots(plan(histogram, window))
    n_buckets = max(1, -(-total // BUCKET_ROWS), spark.sparkContext.defaultParallelism)
    bucketed = cut_pieces.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n_buckets)).cast("int"))
    counts = bucketed.groupBy("bucket_", "length").agg(F.count("*").alias("n_"))
    before = counts.select("bucket_", "length", (
        F.sum("n_").over(Window.partitionBy("length").orderBy("bucket_")) - F.col("n_")).alias("before_"))
    ranked = bucketed.withColumn("in_", F.row_number().over(
        Window.partitionBy("bucket_", "length").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["bucket_", "length"]).withColumn("rank_", (F.col("before_") + F.col("in_")).cast("long"))
    ranked = ranked.select(*cut_pieces.columns, "rank_")
    span = np.int64(1) << 50
    keys = where["length"] * span + where["rank"]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank_"))
            k = np.searchsorted(keys, np.asarray(batch.column("length")) * span + rank, side="right") - 1
            columns = [batch.column(c) for c in batch.schema.names if c != "rank_"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(where["sequence"][k] + rank - where["rank"][k]), pa.array(where["offset"][k])],
                [*(c for c in batch.schema.names if c != "rank_"), "sequence_id", "offset"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and the ids).

    A null or empty text is one piece that holds the end token alone; repeated
    rows and null ids are documents of their own; an empty table gives no
    rows; other columns are not read."""
    return place(cut(pieces(docs, tokenizer, window, with_ids=with_ids)), window)
