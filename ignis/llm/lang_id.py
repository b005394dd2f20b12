"""Language identification by hierarchical discrimination.

One linear support vector machine per family tells families apart; within the
family found, one-versus-one machines separate its languages and vote.  Features
are hashed byte n-grams of the lower-cased letters of the whole text.  The
machines are fitted on a bounded sample of labelled documents (SAMPLE rows over
all languages, shared evenly); prediction reads every text once and needs no
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.llm import arrow_text as at
from ignis.llm.common import cut, in_fold

#: Labelled documents to fit on at most on average, over all languages; at most ROWS of a language.
SAMPLE, ROWS = 4_000, 700
#: Languages that are learnt at most, the most frequent ones: a column of other things than languages has any number of values.
LANGUAGES = 256
DIMENSIONS, ORDERS = 4096, (1, 2, 3, 4)
ROUNDS, PENALTY = 150, 1e-4
UNDETERMINED = "und"

#: Language families by ISO 639-1 code. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "semitic": "ar he am mt",
    "indic": "hi ur bn pa mr gu ne si",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def vectors(texts: pa.Array) -> np.ndarray:
    """Unit vectors of the square roots of hashed n-gram counts; zero for a text without letters."""
    texts = at.plain(pc.utf8_lower(at.plain(texts)))
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    letter = np.zeros(256, dtype=np.uint32)
    letter[list(range(97, 123)) + list(range(128, 256))] = list(range(97, 123)) + list(range(128, 256))
    codes = letter[raw]  # everything else is 0
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros(n * DIMENSIONS)
    for order in ORDERS:
        m = len(codes) - order + 1
        if m <= 0:
            continue
        h = np.full(m, order, dtype=np.uint32)
        for k in range(order):
            h = h * np.uint32(16777619) ^ codes[k: m + k]
        h = (h * np.uint32(2654435761)) >> np.uint32(20)
        ok = (owner[:m] == owner[order - 1:]) & ((codes[:m] > 0) | (codes[order - 1:] > 0))
        out += np.bincount(owner[:m][ok] * DIMENSIONS + h[ok], minlength=n * DIMENSIONS)
    x = np.sqrt(out.reshape(n, DIMENSIONS)).astype(np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(at.plain(texts), r"\p{L}").to_numpy(zero_copy_only=False)


def train_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, classes
    weighed evenly, by accelerated gradients."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (2 * 2.0 + PENALTY)  # rows have length sqrt(2) at most
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    t = 1.0
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (PENALTY * v - 2 * (x.T @ (weight * y * slack)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w


@dataclass(frozen=True)
class Hierarchy:
    families: tuple[str, ...]
    family_weights: np.ndarray                      # one row a family
    languages: dict[str, tuple[str, ...]]           # of each family
    pairs: dict[tuple[str, str], np.ndarray]        # > 0: the first of the two

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each vector: the share the family's machine has
        among the families, times the winner's mean pairwise probability."""
        n = len(x)
        if not self.families:
            return np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
        one = np.hstack([x, np.ones((n, 1), dtype=np.float32)])
        margin = np.clip(one @ self.family_weights.T, -20, 20) * 3
        share = np.exp(margin - margin.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        lang, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
        for f, family in enumerate(self.families):
            at_ = np.flatnonzero(best == f)
            names = self.languages[family]
            votes, chance = np.zeros((len(at_), len(names))), np.zeros((len(at_), len(names)))
            for (a, b), w in self.pairs.items():
                if a not in names:
                    continue
                p = 1 / (1 + np.exp(-3 * np.clip(one[at_] @ w, -20, 20)))
                i, j = names.index(a), names.index(b)
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                chance[:, i] += p
                chance[:, j] += 1 - p
            pick = (votes + 1e-3 * chance).argmax(axis=1) if len(at_) else np.zeros(0, dtype=int)
            own = chance[np.arange(len(at_)), pick] / (len(names) - 1) if len(names) > 1 else np.ones(len(at_))
            lang[at_] = np.array(names, dtype=object)[pick]
            score[at_] = share[at_, f] * own
        return lang, np.clip(score, 0, 1)


def sample(labelled: DataFrame, total: int = SAMPLE, rows: int = ROWS, languages: int = LANGUAGES) -> DataFrame:
    """lang and text of about min(rows, total / languages) documents of each of the
    most frequent languages (ties: the lesser name), ``languages`` at most, drawn by
    a hash of id and text.  Their table is joined to the documents; the driver sees
    how many there are."""
    most = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages))
    each = min(rows, max(1, total // max(most.count(), 1)))
    rates = most.select("lang", (F.lit(float(each)) / F.col("n")).alias("rate"))
    point = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return labelled.join(F.broadcast(rates), "lang").where(point < F.col("rate")).select("lang", "text")


def fit(labelled: DataFrame, total: int = SAMPLE, rows: int = ROWS) -> Hierarchy:
    """Machines from ``labelled`` (doc_id, text, lang); rows without lang or letters teach nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            for k in range(0, part.num_rows, 256):
                few = part.slice(k, 256)
                x = vectors(few.column("text"))
                ok = has_letter(few.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [few.column("lang").filter(pa.array(ok)), pa.array([r.astype(np.float16).tobytes() for r in x[ok]], pa.binary())], ["lang", "x"])
    got = sample(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), total, rows).mapInArrow(
        run, "lang string, x binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["x"])))  # the same fit whatever order tasks end in
    langs = np.array([r["lang"] for r in got], dtype=object)
    x = (np.frombuffer(b"".join(bytes(r["x"]) for r in got), dtype=np.float16).reshape(-1, DIMENSIONS).astype(np.float32))
    family = np.array([FAMILY_OF.get(v, v) for v in langs], dtype=object)
    families = tuple(sorted(set(family)))
    languages = {f: tuple(sorted(set(langs[family == f]))) for f in families}
    if len(families) > 1:
        weights = np.stack([train_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in families])
    else:
        weights = np.zeros((len(families), DIMENSIONS + 1), dtype=np.float32)
    pairs = {}
    for names in languages.values():
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                both = (langs == a) | (langs == b)
                pairs[a, b] = train_svm(x[both], np.where(langs[both] == a, 1, -1).astype(np.float32))
    return Hierarchy(families, weights, languages, pairs)


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            for k in range(0, part.num_rows, 512):
                few = part.slice(k, 512)
                lang, score = model.predict(vectors(few.column("text")))
                ok = has_letter(few.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id"), pa.array(np.where(ok, lang, UNDETERMINED), pa.string()), pa.array(np.where(ok, score, 0.0))],
                    ["doc_id", "lang_pred", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from documents with a lang outside the held-out fold (a null id is
    never learnt from).  A text that is null or has no letter is ``und`` with
    score 0, as is every text where nothing could be learnt; repeated rows are
    predicted each; an empty table gives no rows; other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(source.where(F.col("doc_id").isNotNull() & ~in_fold(held_out_fold)))
    return predict(source, model).select("doc_id", in_fold(held_out_fold).alias("held_out"), "lang_pred", "score")
