"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, revise) becomes signed deltas per source,
language and tokenizer version, and totals are the sum of the deltas of all
committed batches, so nothing is ever recounted.  A batch is committed once: its
deltas are written to a folder that no other attempt uses, and then a marker,
which can be put only once, names that folder.  Readers sum the folders that
markers name, so a job may be run twice, by two writers at once, or die at any
point.  Every so many batches their sum is written as a base, published in the
same way; reading costs the base and the batches since.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at
from ignis.llm.tokens import encode_slice
from ignis.sources import files

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("documents", "tokens", "bytes")
CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, bytes long, old_tokens long, old_bytes long"


def count_tokens(docs: DataFrame, tokenizer_path: str, tokenizer: str, columns: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """The columns, tokenizer (its version), tokens and bytes of every whole
    text (null: none); repeated rows are counted each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            ids = encode_slice(part.column("text"), tokenizer_path)
            kept = [part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, part.column("bytes"), pa.array([len(i) // 4 for i in ids], pa.int64())],
                                             [*columns, "bytes", "tokens"])
    source = docs.select(*columns, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*columns).schema.fields]
    return source.mapInArrow(run, ", ".join([*fields, "bytes bigint", "tokens bigint"])).withColumn("tokenizer", F.lit(tokenizer))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key of change rows (op, keys, tokens, bytes, old_tokens,
    old_bytes): ``insert`` adds the new counts, ``delete`` takes the old ones
    off, ``revise`` does both and leaves the number of documents.  Null counts
    are 0, null keys are a key of their own, an unknown op is an error."""
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    add, take = F.col("op") != "delete", F.col("op") != "insert"
    signed = changes.withColumn("op", op)
    one = lambda new, old: F.sum(F.when(add, zero(new)).otherwise(0) - F.when(take, zero(old)).otherwise(0))
    return signed.groupBy(*KEYS).agg(
        F.sum(add.cast("long") - take.cast("long")).alias("documents"),
        one("tokens", "old_tokens").alias("tokens"), one("bytes", "old_bytes").alias("bytes"))


#: Batches since the last base after which a commit writes the next.
COMPACT_AFTER = 64
_TOTALS = ", ".join([*(f"{k} string" for k in KEYS), *(f"{m} long" for m in MEASURES)])
_COVERED = "batch_id string, attempt string, base int"


class Rollup:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> DataFrame:
        """batch_id and attempt (the folder of its deltas) of every committed batch."""
        if not files.names(self.spark, f"{self.root}/commits"):
            return self.spark.createDataFrame([], "batch_id string, attempt string")
        return self.spark.read.text(f"{self.root}/commits").select(
            F.col("_metadata.file_name").alias("batch_id"), F.col("value").alias("attempt"))

    def _base(self) -> tuple[int, DataFrame, DataFrame]:
        """Number, totals and covered batches of the newest base; 0 and empty tables without one."""
        found = files.names(self.spark, f"{self.root}/bases")
        if not found:
            return 0, self.spark.createDataFrame([], _TOTALS), self.spark.createDataFrame([], _COVERED)
        at_ = f"{self.root}/base_data/{files.read_small(self.spark, f'{self.root}/bases/{found[-1]}')}"
        return int(found[-1]), self.spark.read.schema(_TOTALS).parquet(f"{at_}/totals"), self.spark.read.schema(_COVERED).parquet(f"{at_}/covered")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch unless it was; says whether it did."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"batch id: {batch_id!r}")
        marker = f"{self.root}/commits/{batch_id}"
        if files.read_small(self.spark, marker) is not None:
            return False
        attempt = uuid.uuid4().hex
        deltas(changes).write.parquet(f"{self.root}/deltas/{attempt}")
        if not files.put_if_absent(self.spark, marker, attempt):
            files.remove(self.spark, f"{self.root}/deltas/{attempt}")
            return False
        if self._since(self._base()[2]).count() > COMPACT_AFTER:
            self.compact()
        return True

    def _since(self, covered: DataFrame) -> DataFrame:
        return self.committed().join(covered.select("batch_id"), "batch_id", "left_anti")

    def _sum(self, base: DataFrame, since: list[str]) -> DataFrame:
        parts = base
        if since:
            parts = base.unionByName(self.spark.read.schema(_TOTALS).parquet(*[f"{self.root}/deltas/{a}" for a in since]))
        return parts.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).where(" or ".join(f"{m} != 0" for m in MEASURES))

    def compact(self) -> bool:
        """Writes the next base; whether it was this call that did.  Deltas that the
        base before had covered are deleted: readers are one base behind at most."""
        number, base, covered = self._base()
        since = self._since(covered).collect()
        attempt = uuid.uuid4().hex
        at_ = f"{self.root}/base_data/{attempt}"
        self._sum(base, [r["attempt"] for r in since]).write.parquet(f"{at_}/totals")
        fresh = self.spark.createDataFrame([(r["batch_id"], r["attempt"], number + 1) for r in since], _COVERED)
        covered.unionByName(fresh).write.parquet(f"{at_}/covered")
        if not files.put_if_absent(self.spark, f"{self.root}/bases/{number + 1:08d}", attempt):
            files.remove(self.spark, at_)
            return False
        for r in covered.where(F.col("base") == number).collect():  # the batches of one base
            files.remove(self.spark, f"{self.root}/deltas/{r['attempt']}")
        return True

    def totals(self) -> DataFrame:
        """Current totals per key; keys that no document is left of are gone."""
        _, base, covered = self._base()
        return self._sum(base, [r["attempt"] for r in self._since(covered).collect()])
