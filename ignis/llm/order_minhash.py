"""Near-duplicate classes by order MinHash.

A text is the sequence of its k-mers of words, each labelled with its
occurrence, so that all are distinct.  For each of many random orders the
smallest MINIMA labelled k-mers are taken and *kept in text order*: two texts
agree on such a sketch when they share those k-mers in the same order, which
follows edit similarity rather than set similarity.  Sketches are joined to band
keys; texts that share a key are candidates, and a candidate is verified by a
banded alignment of the two k-mer sequences: k-mers are distinct in a text, so
the longest common subsequence inside the band is a longest increasing run of
matched places, and the threshold itself gives a band that no accepted alignment
leaves.  Similarity is matched k-mers over all k-mers of both, where a text's
repeats may count each or, if that links, once; so a text with repeats has band
keys of its first occurrences alone, too, and a pair is passed over for its sizes
only if neither count fits.

No bucket is expanded into all its pairs.  Copies are collapsed first; in each
bucket every text is verified against one centre, the member that meets most
others; components follow, and only buckets that still hold several components
are looked at again, tile by tile: all pairs across components there are
verified, so no link between two texts of a bucket is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at
from ignis.llm.common import cut, hot_join, spare

K, THRESHOLD = 5, 0.8
#: Minima of a sketch, sketches of a band key, band keys: a pair at the threshold is missed with a chance of 0.2 %.
MINIMA, SKETCHES, BANDS = 2, 3, 20
#: K-mers that one verifying group should hold, and that one copy of a centre should serve.
GROUP_KMERS, CENTRE_KMERS = 1_000_000, 250_000
#: Texts and k-mers of a tile, where a cluster of unlinked candidates is compared tile by tile.
TILE_TEXTS, TILE_KMERS = 256, 500_000
_PLACE = np.uint64((1 << 24) - 1)
#: K-mers of the longest text whose places fit beside the ordering bits; longer texts are ordered without packing.
_PACKED = int(_PLACE)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmers(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Hashes of the occurrence-labelled k-mers of the lower-cased words of each
    text, in order (odd for a k-mer's first occurrence, even for later ones); how
    many each text has; a 128-bit fingerprint of its words (None without words).
    A text of fewer than k words is one k-mer of all."""
    words = at.words_of(pc.utf8_lower(at.plain(texts)))
    n = words.n
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    per = words.counts
    first = np.concatenate([[0], np.cumsum(per)])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), words.values.cast(pa.string())), " ")
    prints = [xxhash.xxh3_128_digest(t.as_py()) if c else None for t, c in zip(joined, per)]
    h = table[words.ids]
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64), prints
    size = np.where(per == 0, 0, np.maximum(per - k + 1, 1))
    owner = np.repeat(np.arange(n), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start = first[owner] + place
    value = np.zeros(len(start), np.uint64)
    for j in range(k):
        inside = place + j < per[owner]
        part = h[np.minimum(start + j, len(h) - 1)]
        value = value * _ODD + np.where(inside, part, np.uint64(j))
    value = _mix(value)
    key = value ^ _mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        at_ = np.arange(len(new))
        occurrence = np.empty(len(new), np.uint64)
        occurrence[order] = at_ - np.maximum.accumulate(np.where(new, at_, 0))
        again = occurrence > 0
        value = np.where(again, _mix(value + occurrence * _ODD), value) | np.uint64(1)
        value[again] ^= np.uint64(1)
    else:
        value |= np.uint64(1)
    return value, size.astype(np.int64), prints


def band_keys(value: np.ndarray, size: np.ndarray, minima: int = MINIMA, sketches: int = SKETCHES, bands: int = BANDS,
              seed: int = 5) -> np.ndarray:
    """Band keys of every text with k-mers (size > 0), one row each."""
    size = size[size > 0]
    start = np.cumsum(size) - size
    place = np.arange(len(value)) - np.repeat(start, size)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(size), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(size), band + 1, np.uint64)
        for _ in range(sketches):
            flip, odd = (np.uint64(v) for v in rng.integers(0, 1 << 63, 2, dtype=np.uint64))
            v = ((value ^ flip) * (odd | np.uint64(1))) & ~_PLACE
            for spot in np.sort(_least_places(v, place, start, size, minima), axis=0):  # text order
                found = value[start + np.minimum(spot, size - 1)]
                key = key * _ODD + np.where(spot >= size, np.uint64(0), found)
        out[:, band] = _mix(key)
    return out


def _least_places(v: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, minima: int) -> np.ndarray:
    """Places of the ``minima`` least values of each text, ties to the earlier
    place; past its end where a text has fewer.  The low bits of v are free: a
    place that fits is packed there."""
    out = np.empty((minima, len(size)), np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    packed = v | np.minimum(place, int(_PLACE)).astype(np.uint64)
    for m in range(minima):
        low = np.minimum.reduceat(packed, start) if len(v) else packed
        out[m] = np.where(low == top, size, (low & _PLACE).astype(np.int64))
        packed[start + np.minimum(out[m], size - 1)] = top
    for text in np.flatnonzero(size > _PACKED):
        own = v[start[text]:start[text] + size[text]]
        out[:, text] = _least_of(own, minima)
    return out


def _least_of(own: np.ndarray, minima: int) -> list[int]:
    """The same for one text, without packing."""
    own, found = own.copy(), []
    for _ in range(minima):
        at_ = int(np.argmin(own))
        found.append(at_ if len(found) < len(own) else len(own))
        own[at_] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return found


def all_keys(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """How many first occurrences each text has, and its band keys: BANDS of all
    its k-mers and, where k-mers recur, BANDS more of the first occurrences
    alone.  None for a text without k-mers."""
    owner = np.repeat(np.arange(len(size)), size)
    first = value & np.uint64(1) == 1
    once = np.bincount(owner[first], minlength=len(size)).astype(np.int64)
    recur = once < size
    every = iter(band_keys(value, size).astype(np.int64))
    alone = iter(band_keys(value[first & recur[owner]], once[recur]).astype(np.int64))
    return once, [(np.concatenate([next(every), next(alone)]) if again else next(every)) if s else None for s, again in zip(size, recur)]


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned k-mers over all k-mers of both, every occurrence counted; where
    that falls short and k-mers recur, each k-mer counted once.  0 where the
    threshold can't be met."""
    found = aligned(a, b, threshold)
    if found:
        return found
    once_a, once_b = a[a & 1 == 1], b[b & 1 == 1]
    return aligned(once_a, once_b, threshold) if len(once_a) < len(a) or len(once_b) < len(b) else 0.0


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Alignment inside the band that the threshold gives."""
    total = len(a) + len(b)
    need = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    order = np.argsort(b)
    ranked = b[order]
    at_ = np.searchsorted(ranked, a)
    at_[at_ == len(b)] = 0
    hit = np.flatnonzero(ranked[at_] == a)
    there = order[at_[hit]]
    there = there[np.abs(there - hit) <= total - 2 * need]
    if len(there) < need:
        return 0.0
    if len(there) and not (np.diff(there) > 0).all():
        tails: list[int] = []
        for x in there.tolist():
            i = bisect_left(tails, x)
            tails[i:i + 1] = [x]
        matched = len(tails)
    else:
        matched = len(there)
    return matched / (total - matched) if matched >= need else 0.0


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text, F.octet_length(text)).alias("text_hash"))


def sketches(source: DataFrame) -> DataFrame:
    """doc_id, text_hash, print, n (k-mers), once (first occurrences among them)
    and keys (band keys) of each row; print and keys are null for a text without
    words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            value, size, prints = kmers(part.column("text"))
            once, keys = all_keys(value, size)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(prints, pa.binary()), pa.array(size), pa.array(once),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "print", "n", "once", "keys"])
    return source.mapInArrow(run, "doc_id bigint, text_hash bigint, print binary, n bigint, once bigint, keys array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node of its
    component.  Labels spread along edges and then jump to their label's label;
    each round is checkpointed, and the driver sees one count a round."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        moved = cut(step.join(up, "new").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return labels


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b), where few nodes, the hubs,
    stand as b: one node of each component is the label of all.

    A node keeps its least hub only; its other hubs become links between hubs,
    and the rounds of ``components`` run on those alone."""
    hubs = edges.select(F.col("b").alias("a"), "b")
    ends = cut(edges.select("a", "b").unionByName(hubs).distinct())
    home = ends.groupBy("a").agg(F.min("b").alias("home"))
    links = cut(ends.join(home, "a").where("b != home").select(F.col("home").alias("a"), "b").distinct())
    far = components(links).select(F.col("node").alias("home"), "label")
    return cut(home.join(far, "home", "left").select(F.col("a").alias("node"), F.coalesce("label", "home").alias("label")))


def _texts_kmers(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kmers) of the nodes (node, doc_id, text_hash), their texts read again."""
    wanted = nodes.select("node", F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("id_"), "text_hash")
    rows = source.select(F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("id_"), "text_hash", "text").join(wanted, ["id_", "text_hash"])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            value, size, _ = kmers(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(value.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "kmers"])
    return rows.select("node", "text").mapInArrow(run, "node bigint, kmers array<bigint>").dropDuplicates(["node"])


def _verify(pairs: DataFrame, kmers_of: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, centre, n) whose alignment meets the threshold, as (a, b).

    A centre that many texts are held against is copied, so that each copy
    serves about CENTRE_KMERS; groups hold about GROUP_KMERS."""
    load = pairs.groupBy("centre").agg(F.sum("n").alias("load"))
    total = load.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    groups = max(1, int(2 * total) // GROUP_KMERS + 1)
    copies = load.select("centre", (F.floor(F.col("load") / CENTRE_KMERS) + 1).cast("int").alias("copies"))
    salted = pairs.join(copies, "centre").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    group = F.pmod(F.xxhash64("centre", "salt"), F.lit(groups)).cast("int")
    left = (salted.select(group.alias("part"), F.col("centre").alias("with"), F.col("a").alias("member"))
            .join(kmers_of.select(F.col("node").alias("member"), F.col("kmers").alias("mine")), "member"))
    spread = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    right = (spread.select(group.alias("group"), F.col("centre").alias("hub")).distinct()
             .join(kmers_of.select(F.col("node").alias("hub"), F.col("kmers").alias("theirs")), "hub"))
    def check(members, hubs):
        known = {c: np.asarray(v) for c, v in zip(hubs["hub"], hubs["theirs"])}
        good = [(a, c) for a, c, v in zip(members["member"], members["with"], members["mine"])
                if c in known and similarity(np.asarray(v), known[c], threshold) >= threshold]
        return pd.DataFrame(good, columns=["a", "b"]).astype("int64")
    return left.groupBy("part").cogroup(right.groupBy("group")).applyInPandas(check, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (least doc_id of its
    class), class_size (documents), kept (true for one document of each class:
    the least id; among repeated rows of that id, one).

    Texts with equal lower-cased words are one text.  A null or wordless text is
    a class of its own, as is a document with a null id whose text no other has
    (class_id null); repeated rows are copies; an empty table gives no rows;
    other columns are not read."""
    source = _source(docs, id_col, text_col)
    slim = cut(sketches(source)).withColumn("row", F.monotonically_increasing_id())
    slim = cut(slim)
    texts = slim.where(F.col("print").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    reps = cut(texts.groupBy("print").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min(order).alias("first"),
                                          F.count("*").alias("copies")))
    known = slim.join(reps.select(F.col("node").alias("row")), "row").select(
        F.col("row").alias("node"), "doc_id", "text_hash", "n", "once", "keys")
    buckets = known.select("node", "n", "once", F.explode(F.array_distinct("keys")).alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = cut(buckets.join(shared, "key"))
    degree = buckets.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = buckets.join(degree, "node")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("m"), "n", "once")).alias("c")).select(
        "key", (-F.col("c.m")).alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.once").alias("centre_once"))
    near = lambda a, b: F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)
    fits = near("n", "centre_n") | near("once", "centre_once")
    star = cut(buckets.join(centre, "key").where((F.col("node") != F.col("centre")) & fits)
               .select(F.col("node").alias("a"), "centre", "n").distinct())
    kmers_of = cut(_texts_kmers(source, known.join(buckets.select("node").distinct(), "node")))
    edges = cut(_verify(star, kmers_of, threshold))
    labels = star_components(edges)
    more = cut(_across(buckets, labels, known, kmers_of, threshold))
    if more.limit(1).count():
        labels = _merge(labels, more)
    of_text = cut(reps.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")))
    summary = cut(of_text.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"),
                                               F.min("first")["row"].alias("kept_row"), F.count("*").alias("texts")))
    # a class may hold much of the texts, and a text much of the rows
    of_text = cut(hot_join(of_text.select("print", "class", "copies"), summary, ["class"], "texts", ["print"]))
    rows = hot_join(texts.select("doc_id", "text_hash", "print", "row"), of_text.drop("class"), ["print"], "copies", ["row"])
    alone = slim.where(F.col("print").isNull()).select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return rows.select("doc_id", "text_hash", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept")).unionByName(alone)


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: only the components that the links join
    are looked at again."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    joined = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    roots = components(joined).select(F.col("node").alias("old"), F.col("label").alias("root"))
    kept = labels.join(roots, F.col("label") == F.col("old"), "left").select("node", F.coalesce("root", "label").alias("label"))
    fresh = roots.join(labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("root").alias("label"))
    return cut(kept.unionByName(fresh))


def _across(buckets: DataFrame, labels: DataFrame, keys_of: DataFrame, kmers_of: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts that share a bucket and still lie in different
    components.

    Buckets with several components are joined to clusters, a cluster's texts
    are dealt into tiles, and every pair of tiles is one piece of work: its task
    compares band keys, and aligns the pairs that share one, differ in
    component and fit in size.  Pairs never become rows, and no task holds more
    than a few tiles."""
    now = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("anchor")).where("lo < hi")
    now = cut(now.join(mixed.select("key", "anchor"), "key").select("node", "n", "once", "label", "anchor"))
    cluster = star_components(now.where("node != anchor").select(F.col("node").alias("a"), F.col("anchor").alias("b")))
    members = now.select("node", "n", "once", "label").distinct().join(
        cluster.select("node", F.col("label").alias("cluster")), "node")
    size = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(TILE_TEXTS)), F.ceil(F.sum("n") / F.lit(TILE_KMERS))).cast("int").alias("tiles"))
    work = members.join(size, "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    work = cut(work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "cluster", "node", "n", "once", "label", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")))
    load = work.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("cluster", "lo", "hi"), F.lit(int(load) // TILE_KMERS + 1)).cast("int")
    work = (work.withColumn("part", part).join(keys_of.select("node", "keys"), "node")
            .join(kmers_of.select(F.col("node").alias("text"), "kmers"), F.col("node") == F.col("text")).drop("text"))
    def links(rows):
        out = []
        for _, own in rows.groupby(["cluster", "lo", "hi"], sort=False):
            out += _tile_links(own["node"].to_numpy(), own["n"].to_numpy(), own["once"].to_numpy(), own["label"].to_numpy(),
                               own["tile"].to_numpy(), own["keys"].to_list(), own["kmers"].to_list(), threshold)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return work.groupBy("part").applyInPandas(links, "a long, b long")


def _tile_links(node, n, once, label, tile, keys, kmers_of, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different components; pairs whose components a
    link found here has joined already are passed over."""
    shared = np.zeros((len(node), len(node)), dtype=np.int16)
    every, alone = (np.stack([k[part] for k in keys]) for part in (slice(BANDS), slice(-BANDS, None)))
    recur = np.flatnonzero(once < n)
    for band in range(BANDS):
        e, o = every[:, band], alone[recur, band]
        shared += e[:, None] == e[None, :]
        if len(recur):
            cross = o[:, None] == e[None, :]
            shared[recur] += cross
            shared[:, recur] += cross.T
            shared[np.ix_(recur, recur)] += o[:, None] == o[None, :]
    near = lambda v: np.minimum(v[:, None], v[None, :]) >= threshold * np.maximum(v[:, None], v[None, :])
    fits = near(n) | near(once)
    across = tile[:, None] != tile[None, :] if tile.min() != tile.max() else np.ones_like(fits)
    i, j = np.nonzero(np.triu((shared > 0) & fits & across & (label[:, None] != label[None, :]), 1))
    parent = {v: v for v in label.tolist()}
    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v
    found = []
    for x, y in zip(*(v[np.argsort(-shared[i, j], kind="stable")].tolist() for v in (i, j))):
        a, b = root(label[x]), root(label[y])
        if a == b:
            continue
        if similarity(kmers_of[x], kmers_of[y], threshold) >= threshold:
            parent[a] = b
            found.append((int(node[x]), int(node[y])))
    return found


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class, all their columns, whatever their
    names and types.  Texts without words all stay; of rows repeated with the same
    id and text one stays: the one whose whole row comes first by hash."""
    found = classes(docs, threshold, id_col, text_col)
    own_id, own_hash, rows, kept, at_, row = spare(docs, "id", "hash", "rows", "kept", "at", "row")
    low = F.lit(-(2 ** 63))
    keys = lambda d, t: [F.coalesce(d.cast("long"), low).alias(own_id), t.alias(own_hash)]
    gone = found.groupBy(*keys(F.col("doc_id"), F.col("text_hash"))).agg(
        F.count("*").alias(rows), F.sum(F.col("kept").cast("int")).alias(kept))
    gone = cut(gone.where(F.col(kept) < F.col(rows)))
    text = docs[text_col]
    marked = docs.select("*", *keys(docs[id_col], F.xxhash64(text, F.octet_length(text))))
    stay = marked.join(gone.select(own_id, own_hash), [own_id, own_hash], "left_anti").drop(own_id, own_hash)
    # of repeated rows one stays and the others go
    part = gone.where(F.col(kept) > 0).select(own_id, own_hash, rows)
    if not part.limit(1).count():
        return stay
    whole = F.struct(*[docs[c] for c in docs.columns])
    packed = docs.select(*keys(docs[id_col], F.xxhash64(text, F.octet_length(text))), whole.alias(row),
                         F.xxhash64(F.to_json(whole)).alias(at_))
    some = hot_join(packed, part, [own_id, own_hash], rows, [at_]).groupBy(own_id, own_hash).agg(F.min_by(row, at_).alias(row))
    return stay.unionByName(some.select(f"{row}.*"))
