"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ignis.llm import (bloom_lm, bpe_chunks, hash_forest, lang_id, merkle, mtree, order_minhash, packing, quality_qda, quality_rules,
                       sharding, token_rollups, whitening)
from ignis.llm.common import cut, table
from ignis.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents, with the production policy's verdict."""
    ledger = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return ledger.select(
        "*", (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.PRODUCTION).alias("kept"))


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy takes away from all documents, from the ledger's bits."""
    ledger = cut(quality_rules.ledger(table(spark, sf_dir, "documents")).select("fail_bits"))
    parts = [quality_rules.ablate(ledger, p).select("policy", "rule", "fails", "fails_only_this", "kept", "kept_without") for p in quality_rules.POLICIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after batches of inserts (all documents), a replayed batch,
    deletes (all copies of a text but the first) and revisions (repeated lines
    removed from the texts that remain)."""
    docs = table(spark, sf_dir, "documents").withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", "text", "source", "lang", F.xxhash64("text", F.octet_length("text")).alias("hash"))
    path = public_tokenizers.path(TOKENIZER)
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    both = docs.withColumn("version", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("v"), F.when(lines != F.col("text"), lines).alias("t")))))
    both = both.where((F.col("version.v") == 0) | F.col("version.t").isNotNull()).select(
        "row", "doc_id", "source", "lang", "hash", "version.v", F.col("version.t").alias("text"))
    counted = cut(token_rollups.count_tokens(both, path, TOKENIZER, ("row", "doc_id", "source", "lang", "hash", "v")))
    original = counted.where("v = 0")
    first = original.groupBy("hash").agg(F.min("row").alias("row"))  # one row a text
    kept = original.join(first.select("row"), "row", "left_semi")
    gone = original.join(first.select("row"), "row", "left_anti")
    revised = counted.where("v = 1").select("row", F.col("tokens").alias("new_tokens"), F.col("bytes").alias("new_bytes"))
    keys = ["doc_id", "source", "lang", "tokenizer"]
    none = F.lit(None).cast("long")
    insert = lambda part: original.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part).select(
        F.lit("insert").alias("op"), *keys, "tokens", "bytes", none.alias("old_tokens"), none.alias("old_bytes"))
    rollup = token_rollups.Rollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollups/{uuid.uuid4().hex}")
    for part in range(4):
        rollup.commit(f"insert-{part}", insert(part))
    rollup.commit("insert-0", insert(0))
    rollup.commit("delete-copies", gone.select(
        F.lit("delete").alias("op"), *keys, none.alias("tokens"), none.alias("bytes"),
        F.col("tokens").alias("old_tokens"), F.col("bytes").alias("old_bytes")))
    rollup.commit("revise-lines", kept.join(revised, "row").select(
        F.lit("revise").alias("op"), *keys, F.col("new_tokens").alias("tokens"), F.col("new_bytes").alias("bytes"),
        F.col("tokens").alias("old_tokens"), F.col("bytes").alias("old_bytes")))
    return rollup.totals()


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 nearest found for every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return hash_forest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    ranks = public_tokenizers.path(RANKS)
    encoded = bpe_chunks.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe_chunks.digests(encoded, ranks)


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language-model score of every document."""
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op10_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op11_bitmap_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its holder's
    text still verifies: where 3 divides the id's CRC, A-Z were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.audit(docs, tampered, merkle.lower_ascii(F.col("text")))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings, whitened on the first four components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sampled_splitters, op2_rule_ledger, op3_token_rollup, op4_hash_forest, op5_order_minhash, op6_nnls_packing,
    op7_quadratic_discriminant, op8_overlapping_chunks, op9_bloom_lm, op10_family_svm, op11_bitmap_merkle, op12_lanczos_whitening, op13_mtree_topk, pipeline,
    ledger_ablation)}

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
flat AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM flat WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM win WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM twice, (VALUES (0), (1), (2)) AS v(k)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lin AS (SELECT r, count(*) AS n, count(DISTINCT line) AS u FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lin.n - lin.u, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lin.n, 0) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lin USING (r)),
b AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 3 * n_words > 2 * word_chars THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""



def _ablation() -> str:
    parts = []
    for policy, rules in quality_rules.POLICIES.items():
        m = quality_rules.mask(policy)
        for rule in rules:
            b = quality_rules.bit(rule)
            parts.append(f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER (WHERE fail_bits & {b} <> 0) AS fails, "
                         f"count(*) FILTER (WHERE fail_bits & {m} = {b}) AS fails_only_this, count(*) FILTER (WHERE fail_bits & {m} = 0) AS kept, "
                         f"count(*) FILTER (WHERE fail_bits & {m - b} = 0) AS kept_without FROM ledger")
    return f"WITH ledger AS ({_OP2})\n" + "\nUNION ALL ".join(parts)


_OP11 = """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
             lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS crc
  FROM documents, crc_table),
leaf AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS claimed
  FROM doc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaf),
node AS (
  SELECT 0 AS lvl, g, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT lvl + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lvl, g, pos // 8, n),
subroot AS (SELECT g, d, count(*) OVER () AS n FROM node WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, g AS pos, n, d FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 8, n),
every AS (SELECT lvl, g, pos, n, d, false AS up FROM node UNION ALL SELECT lvl, -1, pos, n, d, true FROM upper),
side AS (
  SELECT a.up, a.lvl, a.g, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.up = b.up AND a.lvl = b.lvl AND a.g = b.g AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.up, a.lvl, a.g, a.pos),
climb AS (
  SELECT r, g, 0 AS lvl, pos, coalesce(claimed, leaf) AS d, '' AS proof FROM placed
  UNION ALL
  SELECT c.r, c.g, c.lvl + 1, c.pos // 8, sha256(s.l || c.d || s.r), c.proof || s.l || s.r
  FROM climb c JOIN side s ON NOT s.up AND s.lvl = c.lvl AND s.g = c.g AND s.pos = c.pos),
crown AS (
  SELECT r, 0 AS lvl, g AS pos, d, proof FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl DESC) AS k FROM climb) WHERE k = 1
  UNION ALL
  SELECT c.r, c.lvl + 1, c.pos // 8, sha256(s.l || c.d || s.r), c.proof || s.l || s.r
  FROM crown c JOIN side s ON s.up AND s.lvl = c.lvl AND s.pos = c.pos),
done AS (SELECT r, d, proof FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl DESC) AS k FROM crown) WHERE k = 1)
SELECT p.doc_id, p.leaf, s.d AS subroot, u.d AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = u.d AS verified
FROM placed p JOIN done f USING (r) JOIN subroot s USING (g), (SELECT d FROM upper WHERE n = 1) u
"""

_OP13 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pair)
WHERE rank <= 20
"""

ORACLE: dict[str, str] = {"op2_rule_ledger": _OP2, "op11_bitmap_merkle": _OP11, "op13_mtree_topk": _OP13, "ledger_ablation": _ablation()}
