"""Language-model scoring from a log-frequency Bloom filter.

N-gram counts are summed by Spark; each count is quantised to a level, and an
n-gram of level q enters the filter q times, with the levels 1 to q, so that its
level is read back by probing 1, 2, ... until a probe fails.  The filter is laid
out in segments by n-gram hash: the task that sums a bucket's counts also sets
the bits of its segment, which is sized by what the bucket holds, so the filter
grows with the corpus and its error rate doesn't.  Workers get it as a broadcast
of at most SHARD_BYTES; a larger filter goes out shard by shard.  Then the texts are
read once, their distinct n-grams dealt to shards as packed arrays, and each shard's pass
probes those alone and deletes them.  What is stored of a text are its words' codes; the
n-grams' places are worked out again where the levels come back.

A token's probability is the bigram estimate smoothed with the unigram one,
both from probed levels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at
from ignis.llm.common import cut, in_fold
from ignis.session import ensure_checkpoint_dir
from ignis.sources.files import names, remove

#: Bits an entry (n-gram and level) and probes of it: about 2 % of absent entries seem present.
BITS_PER_ENTRY, PROBES = 8, 4
#: Text bytes a count bucket stands for, and n-grams a counting task holds before it hands them on.
BUCKET_BYTES, HELD = 16 << 20, 2_000_000
#: A broadcast's bound: filter bytes a pass; and words of the exact table that is broadcast (16 bytes each).
SHARD_BYTES, FREQUENT = 128 << 20, 1_000_000
#: Weight of the unigram estimate, in observations of the context.
SMOOTHING = 100.0
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hashes that stand for the end of a text and the place before its first token.
END, BEGIN = np.uint64(xxhash.xxh64_intdigest(b" end")), np.uint64(xxhash.xxh64_intdigest(b" begin"))


def _thresholds(base: float = 1.2, top: int = 1 << 50) -> np.ndarray:
    """Least count of each level: exact up to 6, then 1.2 times the last."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * base))))
    return np.array(out, dtype=np.int64)


LEAST = _thresholds()
#: Count that a level is read as: the middle of its range; none for level 0.
READ = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2.0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(context * _C1 + word * _C2 + np.uint64(1))


@dataclass
class Tokens:
    """Tokens of n texts in order, the end of each included."""

    n: int
    owner: np.ndarray
    table: np.ndarray         # hashes of the distinct words, END and BEGIN
    code: np.ndarray          # place of each token's hash in the table
    context_code: np.ndarray  # that of the token before, or of BEGIN

    @property
    def word(self) -> np.ndarray:
        return self.table[self.code]

    @property
    def context(self) -> np.ndarray:
        return self.table[self.context_code]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct bigrams, the place of each token's among them, and how often each occurs."""
        width = len(self.table)
        distinct, place, times = np.unique(self.context_code * width + self.code, return_inverse=True, return_counts=True)
        return pair(self.table[distinct // width], self.table[distinct % width]), place, times


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each (non-empty) word: the sum of mixed (place, byte) pairs, mixed again."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64, count=words.offset + len(words) + 1)[words.offset:]
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    size, start = np.diff(offsets), offsets[:-1] - offsets[0]
    place = (np.arange(len(raw)) - np.repeat(start, size)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix((place << np.uint64(8)) + raw + np.uint64(1)), start) + size.astype(np.uint64) * _C1)


def tokens(texts: pa.Array) -> Tokens:
    words = at.words_of(pc.ascii_lower(at.plain(texts)))
    table = word_hashes(words.dictionary)
    per = words.counts
    owner = np.repeat(np.arange(words.n), per + 1)
    ends = np.cumsum(per + 1) - 1
    end, begin = len(table), len(table) + 1
    code = np.full(len(owner), end, dtype=np.int64)
    body = np.ones(len(owner), dtype=bool)
    body[ends] = False
    code[body] = words.ids
    context = np.concatenate([[begin], code[:-1]])[: len(code)]
    context[ends - per] = begin
    return Tokens(words.n, owner, np.concatenate([table, [END, BEGIN]]).astype(np.uint64), code, context)


def _count(n_buckets: int):
    """Per task: hashes and counts of unigrams and bigrams, handed on by bucket in sorted arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        n_held = 0
        def flush() -> Iterator[pa.RecordBatch]:
            for order, parts in held.items():
                if not parts:
                    continue
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                bucket = bucket_of(keys, n_buckets)
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows = [(b, keys[s:e], counts[s:e]) for b, (s, e) in enumerate(zip(edges, edges[1:])) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([order] * len(rows), pa.int32()),
                     pa.array([_pack_keys(r[1]) for r in rows], pa.binary()), pa.array([_pack(r[2]) for r in rows], pa.binary())],
                    ["bucket", "order", "keys", "counts"])
                parts.clear()
        for part in at.text_slices(batches):
            t = tokens(part.column("text"))
            once = np.bincount(t.code, minlength=len(t.table))
            once[-1] = t.n  # each text begins once
            both, _, times = t.bigrams()
            for order, k, c in ((1, t.table[once > 0], once[once > 0]), (2, both, times)):
                held[order].append((k, c))
                n_held += len(k)
            if n_held > HELD:
                yield from flush()
                n_held = 0
        yield from flush()
    return run


def _pack(counts: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds them; its bytes a count come first."""
    width = next(w for w in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes: how many there are, the bytes a step between them takes, and the steps (the first
    from 0) byte by byte, all lowest bytes first."""
    steps = np.diff(keys)
    width = -(-int(steps.max(initial=0)).bit_length() // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.uint64(len(keys)).tobytes() + keys[:1].tobytes() + bytes([width]) + planes.tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, dtype=np.uint64, count=1)[0])
    if not n:
        return np.zeros(0, np.uint64)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[1:, :raw[16]] = np.frombuffer(raw, dtype=np.uint8, offset=17).reshape(raw[16], n - 1).T
    steps[0] = np.frombuffer(raw, dtype=np.uint8, offset=8, count=8)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)


#: Bits of a block, and levels of a key that share one: their probes meet one line of memory.
BLOCK_BITS, BLOCK_LEVELS = 512, 8


def blocks(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """First bit of the block where (key, level) lies, in a segment of ``bits`` bits."""
    h = _mix(keys * _C1 + np.array([level // BLOCK_LEVELS], dtype=np.uint64) * _C2) >> np.uint64(32)
    return (h * (bits // BLOCK_BITS).astype(np.uint64) >> np.uint64(32)).astype(np.int64) * BLOCK_BITS


def offsets(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash whose parts of 9 bits are the places of the probes in the block."""
    return _mix(keys + np.array([level], dtype=np.uint64) * _C2)


def place_of(h: np.ndarray, probe: int) -> np.ndarray:
    return (h >> np.uint64(9 * probe) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of some n-grams, as bytes."""
    levels = np.searchsorted(LEAST, counts, side="right")
    entries = int(levels.sum())
    bits = np.array([-(-entries * BITS_PER_ENTRY // BLOCK_BITS) * BLOCK_BITS or BLOCK_BITS])
    flags = np.zeros(int(bits[0]), dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        k = keys[levels >= level]
        first, h = blocks(k, level, bits), offsets(k, level)
        for probe in range(PROBES):
            flags[first + place_of(h, probe)] = True
    return np.packbits(flags, bitorder="little")


def build(source: DataFrame, n_buckets: int) -> DataFrame:
    """Per bucket of the training texts (column text): the filter segment, and
    the exact counts of its unigrams."""
    def reduce(key, rows):
        out = {"bucket": key[0], "words": b"", "word_counts": b"\x01"}
        all_keys, all_counts = [], []
        for order, own in rows.groupby("order"):
            parts = [_unpack_keys(k) for k in own["keys"]]
            keys, place = np.unique(np.concatenate(parts), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([_unpack(c) for c in own["counts"]])).astype(np.int64)
            if order == 1:
                word = keys != BEGIN
                out["words"], out["word_counts"] = keys[word].tobytes(), _pack(counts[word])
            all_keys.append(keys)
            all_counts.append(counts)
        out["filter"] = segment(np.concatenate(all_keys), np.concatenate(all_counts)).tobytes()
        return pd.DataFrame([out])
    counted = source.mapInArrow(_count(n_buckets), "bucket int, order int, keys binary, counts binary")
    return counted.groupBy("bucket").applyInPandas(reduce, "bucket int, words binary, word_counts binary, filter binary")


def vocabulary(model: DataFrame) -> DataFrame:
    """(word, c): exact count of every distinct token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("word_counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, dtype=np.int64)), pa.array(_unpack(counts))], ["word", "c"])
    return model.select("words", "word_counts").mapInArrow(run, "word bigint, c bigint")


class Shard:
    """Segments of the buckets first ... first + len(segments) - 1."""

    def __init__(self, n_buckets: int, first: int, segments: list[bytes]):
        size = np.array([len(s) for s in segments], dtype=np.int64)
        self.n_buckets, self.first, self.last = n_buckets, first, first + len(segments) - 1
        self.at, self.bits = np.cumsum(size) - size, size * 8
        self.raw = np.frombuffer(b"".join(segments), dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, -1 for keys of other shards."""
        bucket = bucket_of(keys, self.n_buckets)
        mine = np.flatnonzero((bucket >= self.first) & (bucket <= self.last))
        out = np.full(len(keys), -1, dtype=np.int16)
        out[mine] = 0
        mine = mine[self.bits[bucket[mine] - self.first] > 0]
        level, first = 0, None
        while len(mine):
            level += 1
            own = keys[mine]
            if first is None or level % BLOCK_LEVELS == 0:
                seg = bucket[mine] - self.first
                first = blocks(own, level, self.bits[seg]) + 8 * self.at[seg]
            h = offsets(own, level)
            for probe in range(PROBES):  # a key is out at its first bit that isn't set
                p = first + place_of(h, probe)
                ok = self.raw[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1
                mine, first, h = mine[ok], first[ok], h[ok]
            out[mine] = level
            if level >= len(LEAST) - 1:
                break
        return out


def probe(t: Tokens, shard: Shard) -> np.ndarray:
    """Levels (3, tokens) of word, context and bigram."""
    single = shard.levels(t.table)
    both, place, _ = t.bigrams()
    return np.stack([single[t.code], single[t.context_code], shard.levels(both)[place]])


def log_probability(levels: np.ndarray, n: int, v: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log10 probability of each token from the levels of word, context and bigram."""
    word, context, both = READ[np.maximum(levels, 0)]
    unigram = (word + 0.5) / (n + 0.5 * (v + 1))
    return np.log10((both + smoothing * unigram) / (np.maximum(context, both) + smoothing))


def score(docs: DataFrame, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = SHARD_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (exact add-half unigrams), score (the model's log10 probability).

    Learns from documents outside the held-out fold (a null id is learnt from).
    A null or empty text is its end token; repeated rows are scored each; with
    nothing to learn from, base_score is 0; an empty table gives no rows; other
    columns are not read.

    Counts of the words that matter most, at most ``frequent``, are broadcast;
    rarer words are joined with their counts instead, so both are exact."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    train = source.where(~in_fold(held_out_fold)).select("text")
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    model = _cut_alone(spark, lambda: build(train, n_buckets))
    words = cut(vocabulary(model))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count a frequent word has: from a histogram of counts (narrow, bounded by the levels)
    steps = F.array(*(F.lit(int(x)) for x in LEAST))
    level = F.size(F.filter(steps, lambda s: s <= F.col("c")))
    by_level = {r["level"]: r["n"] for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    room, least = frequent, len(LEAST) + 1
    for q in sorted(by_level, reverse=True):
        if by_level[q] > room:
            break
        room, least = room - by_level[q], q
    floor = int(LEAST[least - 1]) if least <= len(LEAST) else int(LEAST[-1])
    known = words.where(F.col("c") >= floor).toArrow()
    order = np.argsort(known["word"].to_numpy().view(np.uint64), kind="stable")
    table = spark.sparkContext.broadcast((known["word"].to_numpy().view(np.uint64)[order], known["c"].to_numpy()[order]))
    shards, start, taken = [], 0, 0
    sizes = {r["bucket"]: r["b"] for r in model.select("bucket", F.octet_length("filter").alias("b")).collect()}
    for b in range(n_buckets):
        if taken and taken + sizes.get(b, 0) > shard_bytes:
            shards.append((start, b))
            start, taken = b, 0
        taken += sizes.get(b, 0)
    shards.append((start, n_buckets))
    scored_as = "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<bigint>"
    if len(shards) == 1:
        sent = _shard(model, n_buckets, *shards[0])
        scored = cut(source.mapInArrow(_score_texts(sent, table, floor, n, v), scored_as))
        sent.destroy()
    else:
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bloom_lm/{uuid.uuid4().hex}"
        scored = _cut_alone(spark, lambda: _probed_by_shard(source, model, n_buckets, shards, base).mapInArrow(_score_slices(table, floor, n, v), scored_as))
        remove(spark, base)
    table.destroy()
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    counted = rare.join(words.where(F.col("c") < floor), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per_row = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    return scored.join(per_row, "row", "left").select(
        "doc_id", in_fold(held_out_fold).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")


#: Spark's own setting: files of a query's shuffles go once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _cut_alone(spark, make) -> DataFrame:
    """``cut`` of the frame that ``make`` gives; what it shuffled leaves the disk with it."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return cut(make())
    finally:
        spark.conf.set(_CLEANUP, before)


def _shard(model: DataFrame, n_buckets: int, lo: int, hi: int):
    """A broadcast of the segments of buckets lo ... hi - 1 (at most SHARD_BYTES, or one segment)."""
    got = {r["bucket"]: bytes(r["filter"]) for r in model.where(F.col("bucket").between(lo, hi - 1)).select("bucket", "filter").collect()}
    return model.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, n_buckets, lo, [got.get(b, b"") for b in range(lo, hi)]))


_OPEN: dict[str, Shard] = {}


def _open(sent) -> Shard:
    """The worker's shard of a broadcast, put together once."""
    key, *parts = sent.value
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Shard(*parts)
    return _OPEN[key]


#: Where shard is -1 the tokens of a slice of text, else those of its distinct n-grams (sorted hashes) that lie in the shard.
_SLICE = "slice bigint, shard int, ids binary, here binary, table binary, ends binary, code binary, keys binary"
#: A level takes a byte.
assert len(LEAST) < 256


def _slice_keys(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of a slice's words and distinct bigrams, the place among them of each word of
    the table and each bigram, and the place of each token's bigram."""
    both, place, _ = t.bigrams()
    keys = np.concatenate([t.table, both])
    order = np.argsort(keys, kind="stable")
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))
    return keys[order], at, len(t.table) + place


def _tokenise(n_buckets: int, firsts: list[int]):
    """The one pass over the texts where the filter has several shards: for each
    slice of text a row (shard -1) of its tokens' codes, and for each shard one of
    the distinct n-grams that lie in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in at.text_slices(batches):
            t = _sorted_table(tokens(part.column("text")))
            keys, _, _ = _slice_keys(t)
            edges = np.searchsorted(np.searchsorted(firsts, bucket_of(keys, n_buckets), side="right") - 1, np.arange(len(firsts) + 1))
            ids = part.column("doc_id")
            width = next(w for w in (1, 2, 4) if len(t.table) <= 1 << (8 * w))
            rows = [(number, -1, ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                     _pack_keys(t.table), np.bincount(t.owner, minlength=t.n).astype(np.int64).tobytes(), bytes([width]) + t.code.astype(f"<u{width}").tobytes(), None)]
            rows += [(number, s, None, None, None, None, None, _pack_keys(keys[lo:hi])) for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
            number += 1
            columns = [c.split() for c in _SLICE.split(", ")]
            types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(columns)], [c for c, _ in columns])
    return run


def _sorted_table(t: Tokens) -> Tokens:
    """The same tokens, the table's hashes in order."""
    order = np.argsort(t.table, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return Tokens(t.n, t.owner, t.table[order], rank[t.code], rank[t.context_code])


def _stored_tokens(row: dict) -> Tokens:
    """The tokens of a row that ``_tokenise`` made."""
    per, table = np.frombuffer(row["ends"], dtype=np.int64), _unpack_keys(row["table"])
    code = np.frombuffer(row["code"], dtype=f"<u{row['code'][0]}", offset=1).astype(np.int64)
    context = np.concatenate([code[:1], code[:-1]])
    context[np.cumsum(per) - per] = np.searchsorted(table, BEGIN)
    return Tokens(len(per), np.repeat(np.arange(len(per)), per), table, code, context)


def _probe_keys(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _open(sent)
        for batch in batches:
            got = [shard.levels(_unpack_keys(k)).astype(np.uint8).tobytes() for k in batch.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("shard"), pa.array(got, pa.binary())], ["slice", "shard", "levels"])
    return run


def _probed_by_shard(source: DataFrame, model: DataFrame, n_buckets: int, shards: list[tuple[int, int]], base: str) -> DataFrame:
    """The slices of the texts with the levels of their distinct n-grams.

    The texts are read once, whatever the number of shards, and stored under ``base``;
    each shard of the filter is broadcast once and probed with the n-grams dealt to
    it, which no other pass reads and which are deleted then."""
    spark = source.sparkSession
    source.mapInArrow(_tokenise(n_buckets, [lo for lo, _ in shards]), _SLICE).write.option("compression", "zstd").partitionBy("shard").parquet(base)
    read = lambda s: spark.read.schema(_SLICE).option("basePath", base).parquet(f"{base}/shard={s}")
    there, found = set(names(spark, base)), None
    for s, (lo, hi) in enumerate(shards):
        if f"shard={s}" not in there:
            continue
        sent = _shard(model, n_buckets, lo, hi)
        got = cut(read(s).select("slice", "shard", "keys").mapInArrow(_probe_keys(sent), "slice bigint, shard int, levels binary"))
        sent.destroy()
        remove(spark, f"{base}/shard={s}")
        found = got if found is None else found.unionByName(got)
    if found is None:  # no texts
        return spark.createDataFrame([], f"{_SLICE}, levels array<struct<shard:int,levels:binary>>")
    levels = found.groupBy("slice").agg(F.collect_list(F.struct("shard", "levels")).alias("levels"))  # a row a shard
    return read(-1).select("slice", "ids", "here", "table", "ends", "code").join(levels, "slice")


def _score_slices(table, floor: int, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _stored_tokens(row)
                _, at_, place = _slice_keys(t)
                levels = np.frombuffer(b"".join(part["levels"] for part in sorted(row["levels"], key=lambda x: x["shard"])), dtype=np.uint8)[at_].astype(np.int16)
                ids = pa.array(np.frombuffer(row["ids"], dtype=np.int64), mask=~np.frombuffer(row["here"], dtype=np.bool_))
                yield _scores(ids, t, np.stack([levels[t.code], levels[t.context_code], levels[place]]), table, floor, n, v)
    return run


def _score_texts(sent, table, floor: int, n: int, v: int):
    """The scores of texts where one shard holds the whole filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _open(sent)
        for part in at.text_slices(batches):
            t = tokens(part.column("text"))
            yield _scores(part.column("doc_id"), t, probe(t, shard), table, floor, n, v)
    return run


def _scores(ids: pa.Array, t: Tokens, levels: np.ndarray, table, floor: int, n: int, v: int) -> pa.RecordBatch:
    """The model's score, and the base score of frequent words; rarer words are listed with how often each occurs."""
    words, counts = table.value
    model = log_probability(levels, n, v)
    distinct, place = t.table, t.code
    where = np.minimum(np.searchsorted(words, distinct), max(len(words) - 1, 0))
    hit = words[where] == distinct if len(words) else np.zeros(len(distinct), dtype=bool)
    base = np.zeros(len(distinct))
    if len(words):
        base[hit] = np.log10((counts[where[hit]] + 0.5) / (n + 0.5 * (v + 1)))
    frequent = hit[place]
    rare = np.flatnonzero(~frequent)
    width = len(distinct) + 1
    each, times = np.unique(t.owner[rare] * width + place[rare], return_counts=True)
    edges = np.searchsorted(each // width, np.arange(t.n + 1))
    return pa.RecordBatch.from_arrays([
        ids, pa.array(np.bincount(t.owner, minlength=t.n)),
        pa.array(np.bincount(t.owner[frequent], minlength=t.n)),
        pa.array(np.bincount(t.owner, weights=base[place], minlength=t.n)),
        pa.array(np.bincount(t.owner, weights=model, minlength=t.n)),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(distinct[each % width].view(np.int64))),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(times.astype(np.int64))),
    ], ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"])
