import zlib
from collections import Counter

from pyspark.sql import functions as F
from tricky import ROWS, SCHEMA, empty, prose, tricky

from ignis.llm import sharding


def check_law(rows, n_shards, tolerance=0.03):
    by = [[r for r in rows if r.shard == k] for k in range(n_shards)]
    total = sum(r.size for r in rows)
    for own in by:
        assert sorted(r.slot for r in own) == list(range(len(own)))
    slack = tolerance * total / n_shards + max(r.size for r in rows)
    assert all(abs(sum(r.size for r in own) - total / n_shards) <= slack for own in by)
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def test_tricky_rows_are_all_placed(spark):
    rows = sharding.shard(tricky(spark), 3).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert all(0 <= r.shard < 3 for r in rows)
    assert sharding.shard(empty(spark), 3).count() == 0


def test_bytes_are_near_equal_with_a_hot_group(spark):
    hot = prose(99, 200)
    rows = [(i, hot if i % 3 == 0 else prose(i, 20 + i % 300), None, None, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = sharding.shard(docs, 8).collect()
    check_law(got, 8)
    # small groups of equal texts lie in one shard
    assert sum(len(hot) for _ in range(1)) and len({r.shard for r in got if r.text_crc32 == zlib.crc32(hot.encode())}) > 1


def test_identical_rows_can_be_divided(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    check_law(sharding.shard(docs, 8).collect(), 8)


def test_overfull_ranges_are_divided(spark):
    rows = [(i, "x" * (2_000 if i < 40 else 1), None, None, None) for i in range(4000)]
    slim = sharding._slim(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    bounds, full = sharding.splitters(slim, 16)
    total, count = sum(b for b, _ in full.values()), sum(n for _, n in full.values())
    assert (total, count) == (40 * 2001 + 3960 * 2, 4000)
    assert all(n == 1 or (b <= 3.5 * total / 16 and n <= 3.5 * count / 16) for b, n in full.values())
    assert bounds == sorted(set(bounds))


def brute(slim, n_shards):
    """Shard and slot of every record in key order, by the rule's letter, over one range."""
    rows = sorted(slim.collect(), key=lambda r: bytes(r.key))
    share = max(sum(r.size for r in rows) / n_shards, 1.0)
    groups, at = {}, 0
    for r in rows:
        first, size = groups.get(bytes(r.key)[:8], (at, 0))
        groups[bytes(r.key)[:8]] = (first, size + r.size)
        at += r.size
    out, at, slots = Counter(), 0, Counter()
    for r in rows:
        first, size = groups[bytes(r.key)[:8]]
        cut = first if size <= sharding.WHOLE_GROUP * share else at
        k = min(int(cut // share), n_shards - 1)
        out[(r.doc_id, r.size, r.text_crc32, k, slots[k])] += 1
        slots[k] += 1
        at += r.size
    return out


def test_shards_equal_brute_force(spark, monkeypatch):
    rows = [(i, prose(i % 900, 3 + i % 50), None, None, None) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).persist()
    slim = sharding._slim(docs, "doc_id", "text")
    monkeypatch.setattr(sharding, "_slim", lambda *_: slim)  # row numbers in the keys are those of one reading
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, 6, ranges=1).collect())
    assert got == brute(slim, 6)


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, f"{i} " + "y" * (i * 37 % 900), None, None, None) for i in range(3000)]  # distinct texts
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    slim = sharding._slim(docs, "doc_id", "text")
    monkeypatch.setattr(sharding, "_slim", lambda *_: slim)
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, 7, ranges=24).collect())
    assert got == brute(slim, 7)
