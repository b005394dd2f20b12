"""Regularised quadratic discriminant analysis over document statistics.

Each class has its own mean and a covariance shrunk towards the pooled one and
its diagonal; the score is the logistic of the difference of the two Gaussian
log densities, computed from Cholesky factors found once.  Class moments are
sums, so Spark adds them up over all labelled rows; the driver sees two
matrices of FEATURES x FEATURES, whatever the input.
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

THRESHOLD = 0.3
#: Shares of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.3, 0.2
#: Standardised statistics are clipped here, so one odd value can't decide alone.
CLIP = 8.0
DIGITS, PUNCTUATION, SYMBOLS = b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>@\\^_`{}[]~+=/"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
FEATURES = ("words", "word_length", "length_spread", "distinct", "repeated", "dup_lines", "upper", "digits",
            "punctuation", "symbols", "exclamations", "words_per_line")


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed statistics of each text, one row each.  Shares are taken
    over the count plus a constant, so that a short text, empty ones included,
    stays near the middle."""
    words = at.words_of(texts)
    n = words.counts.astype(np.float64)
    n_lines, n_dup = at.line_counts(texts)
    upper, lower, digits, punct, symbols, bangs = at.byte_counts(
        texts, [UPPER, LOWER, DIGITS, PUNCTUATION, SYMBOLS, b"!"])
    size = pc.utf8_length(words.values).to_numpy(zero_copy_only=False).astype(np.float64)
    chars = at.sums(size, words.owner, words.n)
    squares = np.bincount(words.owner, weights=size * size, minlength=words.n)
    width = len(words.dictionary) + 1
    distinct = np.bincount(np.unique(words.owner * width + words.ids) // width, minlength=words.n)
    mean = (chars + 5 * 20.0) / (n + 20)
    spread = np.maximum((squares + 20 * 34.0) / (n + 20) - mean * mean, 0)
    letters = upper + lower + 100.0
    return np.stack([
        np.log1p(n), np.log(mean), np.log1p(np.sqrt(spread)),
        np.log(distinct + 10.0) - np.log(n + 10),
        np.sqrt(at.repeated_window_words(words) / (n + 20)),
        np.sqrt(n_dup / (n_lines + 4.0)),
        np.sqrt(upper / letters), np.sqrt(digits / letters), np.sqrt(punct / (n + 20)), np.sqrt(symbols / (n + 20)),
        np.sqrt(bangs / (n + 20)), np.log((n + 20) / (n_lines + 1)),
    ], axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of statistics) of every document; null text as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                ["doc_id", "x"])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse of the Cholesky factor, log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray] | None = None
    whiten: tuple[np.ndarray, np.ndarray] | None = None
    log_det: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; the prior where a class was never seen."""
        if self.means is None:
            return np.full(len(x), 1 / (1 + np.exp(self.log_prior[0] - self.log_prior[1])))
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        log = [self.log_prior[c] - self.log_det[c] - 0.5 * np.sum(((z - self.means[c]) @ self.whiten[c].T) ** 2, axis=1)
               for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def _moments(labelled: DataFrame, centre: np.ndarray, scale: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of the standardised statistics, by class."""
    d = len(FEATURES)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("label"))
            z = np.clip((x - centre) / scale, -CLIP, CLIP)
            for c in (0, 1):
                part = z[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        c, at_ = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at_), pa.array(total.ravel())], ["label", "place", "v"])
    got = labelled.mapInArrow(run, "label bigint, place bigint, v double").groupBy("label", "place").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in got:
        flat[r["label"], r["place"]] = r["v"]
    return {c: (flat[c, 0], flat[c, 1:1 + d], flat[c, 1 + d:].reshape(d, d)) for c in (0, 1)}


def _labelled(feats: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """Statistics joined with one 0/1 label a document: nulls are no labels, and
    where a document has several, most votes win (a tie counts as 1)."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("v"))
           .where(F.col("doc_id").isNotNull() & F.col("v").isin(0.0, 1.0))
           .groupBy("doc_id").agg((F.avg("v") >= 0.5).cast("long").alias("label")))
    return feats.join(one, "doc_id").select("doc_id", "x", "label")


def fit(feats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """Fit on every labelled row of ``feats`` (doc_id, x)."""
    labelled = cut(_labelled(feats, labels, label_col))
    d = len(FEATURES)
    scales = labelled.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    centre, scale = np.zeros(d), np.ones(d)
    for r in scales:
        centre[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    moments = _moments(labelled, centre, scale)
    n = {c: moments[c][0] for c in (0, 1)}
    prior = tuple(float(np.log((n[c] + 1) / (n[0] + n[1] + 2))) for c in (0, 1))
    if min(n.values()) < 2:
        return Discriminant(centre, scale, prior)
    mean = {c: moments[c][1] / n[c] for c in (0, 1)}
    cov = {c: moments[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    whiten, det = [], []
    for c in (0, 1):
        shrunk = (1 - POOLED - DIAGONAL) * cov[c] + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
        factor = np.linalg.cholesky(shrunk + 1e-4 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        det.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, prior, (mean[0], mean[1]), tuple(whiten), tuple(det))


def score(feats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row of ``feats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])
    return feats.mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from labelled documents outside the held-out fold.  Null or empty
    texts get the score of their (all zero) counts; repeated rows are scored
    each; null ids are scored and never learnt from; with no label of a class
    the score is the prior (0.5 with no label at all); an empty table gives no
    rows; other columns are not read."""
    feats = cut(features(docs))
    model = fit(feats.where(~in_fold(held_out_fold)), labels)
    return score(feats, model).select(
        "doc_id", in_fold(held_out_fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, threshold: float = THRESHOLD,
         text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(features(docs).where(~in_fold(held_out_fold)), labels)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.text_slices(batches, text_col):
            yield part.filter(pa.array(model.score(statistics(part.column(text_col))) >= threshold))
    return docs.mapInArrow(run, docs.schema)
