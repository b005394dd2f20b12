"""Rule bitmask ledger.

Every rule is evaluated once per text; the ledger keeps the measurements and
one failure bit per rule.  Policies are versioned masks over those bits, so a
new policy, or the question what a rule costs, is bitwise arithmetic on the
ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``left * a > right * b`` (integers, so any engine agrees)."""

    name: str
    left: str
    a: int
    right: str
    b: int


#: A rule's place is its bit and never changes; new rules go to the end.  "one" is the constant 1.
RULES = (
    Rule("few_words", "one", 50, "n_words", 1),
    Rule("repeated_windows", "n_repeat_words", 100, "n_words", 50),
    Rule("symbols", "n_symbols", 10, "n_words", 1),
    Rule("duplicate_lines", "n_dup_lines", 2, "n_lines", 1),
    Rule("long_words", "word_chars", 1, "n_words", 20),
    Rule("short_words", "n_words", 3, "word_chars", 2),
    Rule("upper_case", "n_upper", 2, "n_letters", 1),
)
BASE = ("few_words", "repeated_windows")

#: Versions are never edited; a change is a new version.
POLICIES = {
    "base-1": BASE,
    "strict-1": tuple(r.name for r in RULES),
}
PRODUCTION = "strict-1"


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(bit(name) for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text, in one pass over its words, lines and bytes."""
    words = at.words_of(texts)
    n_lines, n_dup = at.line_counts(texts)
    symbols, upper, lower = at.byte_counts(texts, [SYMBOLS, UPPER, LOWER])
    chars = pc.utf8_length(words.values).to_numpy(zero_copy_only=False)
    return {"n_words": words.counts, "word_chars": at.sums(chars, words.owner, words.n), "n_symbols": symbols,
            "n_dup_lines": n_dup, "n_repeat_words": at.repeated_window_words(words), "n_lines": n_lines,
            "n_upper": upper, "n_letters": upper + lower}


def fail_bits(values: dict[str, np.ndarray]) -> np.ndarray:
    n = len(values["n_words"])
    values = values | {"one": np.ones(n, dtype=np.int64)}
    bits = np.zeros(n, dtype=np.int64)
    for rule in RULES:
        bits |= np.where(values[rule.left] * rule.a > values[rule.right] * rule.b, bit(rule.name), 0)
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements, fail_bits.

    A null text counts as empty (no word: it fails few_words alone); repeated
    rows and null ids stay rows of their own; an empty table gives none; other
    columns are not read.  No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            values = measure(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(values[m].astype(np.int64)) for m in MEASURES),
                 pa.array(fail_bits(values))], ["doc_id", *MEASURES, "fail_bits"])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", fail_bits bigint")


def passes(policy: str | tuple[str, ...] = PRODUCTION, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policies(ledger_df: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """The ledger once per policy version, with its verdict."""
    named = F.array(*(F.struct(F.lit(p).alias("policy"), passes(p).alias("kept")) for p in policies))
    return ledger_df.withColumn("p", F.explode(named)).select(*ledger_df.columns, "p.policy", "p.kept")


def ablate(ledger_df: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents that fail it, those that fail no other
    rule of it, and what the policy keeps with and without the rule.

    Works on the counts of distinct bit patterns (at most 2^rules rows after the
    partial aggregate), not on documents."""
    m = mask(policy)
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(
        F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[policy]))
    each = patterns.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.b")
    def count(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("b")) != 0).alias("fails"),
        count(F.col("bits") == F.col("b")).alias("fails_only_this"),
        count(F.col("bits") == 0).alias("kept"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("b")) == 0).alias("kept_without"),
    ).withColumn("policy", F.lit(policy))


def keep(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    m = mask(policy)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches, text_col):
            yield part.filter(pa.array(fail_bits(measure(part.column(text_col))) & m == 0))
    return docs.mapInArrow(run, docs.schema)
