"""Byte-level BPE by overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel.
Pre-tokenising is a left-to-right scan whose state is its position, so once the
scans of two neighbouring chunks share a boundary they agree from there on: the
text is cut at such a boundary, and the segments between cuts, each whole
pre-tokens, are encoded in parallel.  Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters at a chunk's end where its scan may lack text that it would look at.
EDGE = 4


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def id_bytes(ranks_path: str) -> list[bytes]:
    """The raw bytes of each id."""
    with open(ranks_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the matches of the pattern, from the text's start on."""
    return [m.end() for m in regex.finditer(pattern, text)]


def chunks(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (row, start, piece) of every chunk; ``docs`` has row and text."""
    n = F.greatest(F.ceil(F.length("text") / F.lit(chunk)), F.lit(1)).cast("int")
    return docs.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(
        "row", "doc_id", (F.col("k") * chunk).alias("start"),
        F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))


def _scan(pattern: str):
    """Adds each chunk's boundaries, as positions in the text.  A chunk that
    holds no cut another scan could share still reports them all: stitching
    then goes on with the earlier scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches, "piece"):
            ends = [[s + e for e in boundaries(p, pattern)]
                    for s, p in zip(part.column("start").to_pylist(), part.column("piece").to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.list_(pa.int64()))],
                                             [*part.schema.names, "ends"])
    return run


def stitch(starts: list[int], pieces: list[str], ends: list[list[int]], pattern: str) -> list[str]:
    """Segments of one text, each whole pre-tokens, from its chunks in order.

    The true boundaries run along the current scan; the next chunk takes over
    at the first boundary both scans have, after a character that is no white
    space (what follows white space decides how that is split).  Where two
    scans share none in their overlap, the current scan is carried on through
    the next chunk's text."""
    segments, begin, open_text, open_start, open_ends = [], 0, pieces[0], starts[0], ends[0]
    at_, joined = 1, 1  # the chunk to take over next, and the chunks whose text the open scan has
    while at_ < len(starts):
        start, own = starts[at_], ends[at_]
        limit = min(open_start + len(open_text), start + len(pieces[at_])) - EDGE
        mine = set(own[: bisect_left(own, limit)])
        lo = bisect_left(open_ends, start + 1)
        shared = next((e for e in open_ends[lo: bisect_left(open_ends, limit)]
                       if e in mine and e > begin and not open_text[e - open_start - 1].isspace()), None)
        if shared is not None:
            segments.append(open_text[begin - open_start: shared - open_start])
            begin, open_text, open_start, open_ends = shared, pieces[at_], start, own
            at_ += 1
            joined = at_
            continue
        at_ += 1
        if joined >= at_:
            continue
        # the open scan goes on from its last boundary, through at least as much text again: no text is scanned often
        end = open_start + len(open_text)
        tail = bisect_left(open_ends, end - EDGE)
        resume = open_ends[tail - 1] if tail else open_start
        parts, wanted = [open_text], 2 * (end - resume)
        while joined < len(starts) and (joined < at_ or end - resume < wanted):
            parts.append(pieces[joined][end - starts[joined]:])  # what is not here already
            end, joined = end + len(parts[-1]), joined + 1
        open_text = "".join(parts)
        open_ends = open_ends[:tail] + [resume + e for e in boundaries(open_text[resume - open_start:], pattern)]
    segments.append(open_text[begin - open_start:])
    return segments


def segments(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, place, segment) of texts of several chunks: chunks are
    scanned by separate tasks, then each text is stitched from its chunks."""
    scanned = (chunks(docs, chunk, overlap).repartition("row", "start")
               .mapInArrow(_scan(pattern), "row bigint, doc_id bigint, start int, piece string, ends array<bigint>"))
    def join(key, rows):
        import pandas as pd
        rows = rows.sort_values("start")
        found = stitch(rows["start"].tolist(), rows["piece"].tolist(), [list(e) for e in rows["ends"]], pattern)
        return pd.DataFrame({"row": key[0], "doc_id": rows["doc_id"].iloc[0], "place": range(len(found)), "segment": found}).astype(
            {"doc_id": "Int64"})
    return scanned.groupBy("row").applyInPandas(join, "row bigint, doc_id bigint, place int, segment string")


def _encode_batches(column: str, ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for part in at.text_slices(batches, column):
            ids = [enc.encode_to_numpy(t or "", disallowed_special=()) for t in part.column(column).to_pylist()]
            kept = [(part.column(c), c) for c in part.schema.names if c != column]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()),
                                             pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), lists], [*(n for _, n in kept), "ids"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (array<int>) of every document, in one row each.

    Texts of one chunk are encoded where they are read; longer ones go through
    chunks, stitching and segments.  A null or empty text has no ids; repeated
    rows and null ids are documents of their own; an empty table gives no
    rows; other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = source.where(~is_long).mapInArrow(_encode_batches("text", ranks_path, pattern), "doc_id bigint, ids array<int>")
    long = source.where(is_long).withColumn("row", F.monotonically_increasing_id())
    parts = (segments(long, pattern, chunk, overlap).repartition("row", "place")
             .mapInArrow(_encode_batches("segment", ranks_path, pattern), "row bigint, doc_id bigint, place int, ids array<int>"))
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda s: s["ids"])).alias("ids"))
    return short.unionByName(whole.select("doc_id", "ids"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The raw bytes of each row's ids, joined."""
    length = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int64), pc.take(table, ids.flatten()))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).cast(pa.binary())


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows with ``bytes``, the raw bytes of their ids joined; an id past the
    vocabulary is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(id_bytes(ranks_path), pa.large_binary())
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, _joined(part.column("ids"), table)], [*part.schema.names, "bytes"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*fields, "bytes binary"]))


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents,
    decoded here, so that neither ids nor bytes travel once more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(id_bytes(ranks_path), pa.large_binary())
        for part in _slices(batches):
            lists, raw = part.column("ids"), _joined(part.column("ids"), table)
            n, ids_sha, raw_sha = [], [], []
            for i in range(len(lists)):
                ids = lists[i].values.to_numpy().tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(raw[i].as_buffer()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
