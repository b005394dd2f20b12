"""Bootstrap and permutation test on counts, not rows.

Rows with one score, label and prediction are alike, so a resample only needs to
know how many of each are drawn.  The distinct scores are divided into blocks
in descending order; a replicate first draws how many of its draws fall to each
block (by label and prediction), and then, in the block's own task, to each score.
The draws are split by seeded binomials (bootstrap: with replacement) or
hypergeometrics (permutation: without), so each replicate has exactly as many as
it should, and the cost is distinct scores x replicates, however many rows share
a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ignis.operators.metrics import metrics_from_counts
from ignis.operators.prefix import _block_index, block_bounds, prefix_sums

#: Distinct scores of a block (more, where that would take over MOST_BLOCKS), and replicates drawn at a time.
BLOCK_SCORES, MOST_BLOCKS, TURN = 4_096, 4_096, 64
#: numpy draws hypergeometrics of fewer items than this.
NUMPY_MOST = 1_000_000_000
#: Label and prediction of the four kinds of rows, in the order that arrays hold them.
KINDS = ((0, 0), (0, 1), (1, 0), (1, 1))


def score_cells(df: DataFrame, label: str, score: str, pred: str | None = None) -> DataFrame:
    """s (score) and kinds (rows of each of KINDS; without ``pred`` all count as
    predicted 0) of each present score, stored."""
    y, p = F.col(label), F.col(pred) if pred else F.lit(0)
    known = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    counts = [F.count_if((y == a) & (p == b)) for a, b in KINDS]
    return known.groupBy(F.col(score).cast("double").alias("s")).agg(F.array(*counts).alias("kinds")).checkpoint(eager=True)


def _blocks(cells: DataFrame, block_scores: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """The cells with their block (0: the highest scores), and the blocks' totals by kind."""
    n = cells.count()
    bounds = block_bounds(cells, "s", max(1, min(MOST_BLOCKS, -(-n // block_scores))), n_rows=n)
    dealt = cells.withColumn("block", F.lit(len(bounds)) - _block_index(F.col("s"), bounds))
    sums = dealt.groupBy("block").agg(F.array(*[F.sum(F.get("kinds", F.lit(i))) for i in range(4)]).alias("kinds"))
    return dealt, {r["block"]: list(r["kinds"]) for r in sums.collect()}  # MOST_BLOCKS rows at most


def _turns(df: DataFrame, replicates: int) -> DataFrame:
    """A row a turn of replicates, in as many partitions: turn, first, last."""
    turns = -(-replicates // TURN)
    rows = df.sparkSession.range(0, turns, 1, turns)
    return rows.select(F.col("id").cast("int").alias("turn"), (F.col("id") * TURN).cast("int").alias("first"),
                       F.least(F.lit(replicates), (F.col("id") + 1) * TURN).cast("int").alias("last"))


def multinomial(rng: np.random.Generator, n: int, counts: np.ndarray) -> np.ndarray:
    """n draws with replacement among cells of these counts."""
    return _split(rng, n, counts, lambda k, a, b: rng.binomial(k, a / np.maximum(a + b, 1)))


def hypergeometric(rng: np.random.Generator, n: int, counts: np.ndarray) -> np.ndarray:
    """n draws without replacement."""
    def draw(k, a, b):
        if (a + b).max(initial=0) < NUMPY_MOST:
            return rng.hypergeometric(a, b, k)
        return np.array([one_hypergeometric(rng, *v) for v in zip(k.tolist(), a.tolist(), b.tolist())], dtype=np.int64)
    return _split(rng, n, counts, draw)


def _split(rng: np.random.Generator, n: int, counts: np.ndarray, draw) -> np.ndarray:
    """The draws are split down a binary tree of the cells, a level at a time."""
    if not len(counts):
        return np.zeros(0, dtype=np.int64)
    size = 1 << (len(counts) - 1).bit_length()
    edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64), np.full(size - len(counts), np.sum(counts), dtype=np.int64)])
    k, width = np.array([n], dtype=np.int64), size
    while width > 1:
        low, middle, high = edges[0:size:width], edges[width // 2:size:width], edges[width::width]
        left = draw(k, middle - low, high - middle)
        k, width = np.stack([left, k - left], axis=1).ravel(), width // 2
    return k[:len(counts)]


def one_hypergeometric(rng: np.random.Generator, k: int, a: int, b: int) -> int:
    """How many of k draws without replacement from a + b fall among the a.

    Numpy draws it up to its limit.  Beyond, x is drawn from the binomial of a and
    kept with the chance that the other side makes up the rest, relative to its
    likeliest number: the binomials cancel out to the hypergeometric."""
    if a + b < NUMPY_MOST:
        return int(rng.hypergeometric(a, b, k))
    if a > b:
        return k - one_hypergeometric(rng, k, b, a)
    p = k / (a + b)
    log_p = lambda y: math.lgamma(b + 1) - math.lgamma(y + 1) - math.lgamma(b - y + 1) + y * math.log(p) + (b - y) * math.log1p(-p)
    top = log_p(min(b, int((b + 1) * p))) if p < 1 else 0.0
    while True:
        x = int(rng.binomial(a, p)) if p < 1 else a
        if 0 <= k - x <= b and (p == 1 or math.log(rng.random() or 1e-300) <= log_p(k - x) - top):
            return x


def bootstrap_counts(df: DataFrame, label: str = "label", score: str = "score", pred: str = "pred", n_boot: int = 1000, seed: int = 42,
                     probs: tuple[float, float] = (0.025, 0.975), block_scores: int = BLOCK_SCORES) -> DataFrame:
    """Bootstrap mean and percentile interval of ROC-AUC, PR-AUC, F1 and accuracy,
    each replicate n draws with replacement from the n scored rows; replicates of
    a single class are skipped.  metric, mean, ci_low, ci_high, n_reps."""
    reps = bootstrap_replicates(df, label, score, pred, n_boot, seed, block_scores)
    names = {"roc_auc": "roc_auc", "pr_auc": "average_precision", "f1": "f1", "accuracy": "accuracy"}
    long = reps.where("n_pos > 0 AND n_neg > 0").select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in names.items()])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", probs[0]).alias("ci_low"),
                                      F.percentile("value", probs[1]).alias("ci_high"), F.count(F.lit(1)).alias("n_reps"))


def bootstrap_replicates(df: DataFrame, label: str = "label", score: str = "score", pred: str = "pred", n_boot: int = 1000, seed: int = 42,
                         block_scores: int = BLOCK_SCORES) -> DataFrame:
    """rep, n_pos, n_neg, roc_auc, average_precision, f1 and accuracy of each
    replicate; n_pos + n_neg is the number of scored rows."""
    cells, totals = _blocks(score_cells(df, label, score, pred), block_scores)
    order = sorted(totals)
    kinds = np.array([totals[b] for b in order], dtype=np.int64).reshape(-1, 4)
    n = int(kinds.sum())

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for turn, first, last in rows.itertuples(index=False):
                for rep in range(first, last):
                    drawn = multinomial(np.random.default_rng([seed, rep]), n, kinds.ravel()).reshape(-1, 4)
                    neg, pos = drawn[:, :2].sum(1), drawn[:, 2:].sum(1)
                    yield pd.DataFrame({"turn": turn, "rep": rep, "block": order, "k0": drawn[:, 0], "k1": drawn[:, 1], "k2": drawn[:, 2],
                                        "k3": drawn[:, 3], "pos_before": np.cumsum(pos) - pos, "neg_before": np.cumsum(neg) - neg})
    draws = _turns(df, n_boot).mapInPandas(
        deal, "turn int, rep int, block int, k0 long, k1 long, k2 long, k3 long, pos_before long, neg_before long").checkpoint(eager=True)

    def rank(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("s", ascending=False)
        counts = np.stack(own["kinds"].to_list()) if len(own) else np.zeros((0, 4), np.int64)
        out = []
        for _, rep, block, k0, k1, k2, k3, pos_before, neg_before in asked.sort_values("rep").itertuples(index=False):
            rng = np.random.default_rng([seed, rep, block + 1])
            drawn = np.stack([multinomial(rng, k, counts[:, i]) for i, k in enumerate((k0, k1, k2, k3))], axis=1)
            neg, pos = drawn[:, :2].sum(1).astype(float), drawn[:, 2:].sum(1).astype(float)
            tp, fp = pos_before + np.cumsum(pos), neg_before + np.cumsum(neg)
            some = tp + fp > 0
            out.append((rep, float((pos * fp - 0.5 * pos * neg).sum()), float((pos[some] * tp[some] / (tp + fp)[some]).sum())))
        return pd.DataFrame(out, columns=["rep", "disc", "ap"])
    turns = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n_boot // TURN) - 1))))
    spread = cells.select(F.col("block").alias("of"), turns.alias("at"), "s", "kinds")  # a block's scores for each turn
    parts = spread.groupBy("of", "at").cogroup(draws.groupBy("block", "turn")).applyInPandas(rank, "rep int, disc double, ap double")
    sums = parts.groupBy("rep").agg(F.sum("disc").alias("disc"), F.sum("ap").alias("ap"))
    cm = draws.groupBy("rep").agg(*[F.sum(k).cast("double").alias(c) for k, c in zip(("k0", "k1", "k2", "k3"), ("tn", "fp", "fn", "tp"))])
    both = metrics_from_counts(cm).join(sums, "rep")
    P, N = F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp")
    return both.select("rep", P.cast("long").alias("n_pos"), N.cast("long").alias("n_neg"),
                       F.when((P > 0) & (N > 0), F.lit(1.0) - F.col("disc") / (P * N)).alias("roc_auc"),
                       F.when(P > 0, F.col("ap") / P).alias("average_precision"), "f1", "accuracy")


def permutation_aucs(df: DataFrame, label: str = "label", score: str = "score", n_perm: int = 1000, seed: int = 42,
                     block_scores: int = BLOCK_SCORES) -> tuple[DataFrame, dict]:
    """(perm, n_pos, auc) of each permutation of the labels over the scored rows;
    and the observed auc, n_pos and n."""
    cells = score_cells(df, label, score).select("s", (F.get("kinds", F.lit(0)) + F.get("kinds", F.lit(1))).alias("neg"),
                                                 (F.get("kinds", F.lit(2)) + F.get("kinds", F.lit(3))).alias("pos"))
    cells = cells.withColumn("rows", F.col("pos") + F.col("neg")).checkpoint(eager=True)
    # twice the average rank of each score: whole numbers, so equal sums compare as equal
    ranked = prefix_sums(cells, "s", ["rows"], stored=True).withColumn("rank2", 2 * F.col("cum_rows") - F.col("rows") + 1).checkpoint(eager=True)
    n = cells.count()
    bounds = block_bounds(cells, "s", max(1, min(MOST_BLOCKS, -(-n // block_scores))), n_rows=n)
    dealt = ranked.withColumn("block", _block_index(F.col("s"), bounds).cast("int"))
    exact = F.sum(F.col("pos").cast("decimal(38,0)") * F.col("rank2").cast("decimal(38,0)"))
    tot = dealt.agg(F.sum("pos").alias("pos"), F.sum("rows").alias("rows"), exact.alias("sum2")).first()
    n_pos, total = int(tot["pos"] or 0), int(tot["rows"] or 0)
    n_neg = total - n_pos
    base = n_pos * (n_pos + 1)
    auc = lambda twice: (int(twice) - base) / (2 * n_pos * n_neg) if n_pos and n_neg else float("nan")
    sizes = {r["block"]: int(r["n"]) for r in dealt.groupBy("block").agg(F.sum("rows").alias("n")).collect()}
    order = sorted(sizes)
    counts = np.array([sizes[b] for b in order], dtype=np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for turn, first, last in rows.itertuples(index=False):
                for perm in range(first, last):
                    yield pd.DataFrame({"turn": turn, "perm": perm, "block": order, "k": hypergeometric(np.random.default_rng([seed, perm]), n_pos, counts)})
    draws = _turns(df, n_perm).mapInPandas(deal, "turn int, perm int, block int, k long").checkpoint(eager=True)

    def rank(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("s")
        rows, rank2 = own["rows"].to_numpy(), own["rank2"].to_numpy().astype(object)
        out = []
        for _, perm, block, k in asked.sort_values("perm").itertuples(index=False):
            drawn = hypergeometric(np.random.default_rng([seed, perm, block + 1]), k, rows)
            out.append((perm, int(drawn.sum()), str(int((drawn * rank2).sum()) if len(drawn) else 0)))
        return pd.DataFrame(out, columns=["perm", "k", "sum2"])
    turns = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n_perm // TURN) - 1))))
    spread = dealt.select(F.col("block").alias("of"), turns.alias("at"), "s", "rows", "rank2")
    parts = spread.groupBy("of", "at").cogroup(draws.groupBy("block", "turn")).applyInPandas(rank, "perm int, k long, sum2 string")
    sums = parts.groupBy("perm").agg(F.sum("k").alias("n_pos"), F.sum(F.col("sum2").cast("decimal(38,0)")).alias("sum2"))
    found = sums.select("perm", "n_pos", "sum2", ((F.col("sum2") - F.lit(base)).cast("double") / F.lit(float(2 * n_pos * n_neg or 1))).alias("auc"))
    return found, {"observed": auc(tot["sum2"] or 0), "sum2": int(tot["sum2"] or 0), "n_pos": n_pos, "n": total}


def permutation_counts(df: DataFrame, label: str = "label", score: str = "score", n_perm: int = 1000, seed: int = 42,
                       block_scores: int = BLOCK_SCORES) -> DataFrame:
    """ROC-AUC under ``n_perm`` permutations of the labels: observed_auc, perm_mean,
    perm_std, p_value = mean(perm >= observed), p_value_corrected and n_perm.
    Rows without a score or label take no part."""
    found, seen = permutation_aucs(df, label, score, n_perm, seed, block_scores)
    obs = F.lit(float(seen["observed"]))
    above = F.avg(F.when(F.col("sum2") >= F.lit(str(seen["sum2"])).cast("decimal(38,0)"), 1.0).otherwise(0.0))
    return found.agg(obs.alias("observed_auc"), F.avg("auc").alias("perm_mean"), F.stddev_pop("auc").alias("perm_std"), above.alias("p_value"),
                     ((above * F.count(F.lit(1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value_corrected"), F.count(F.lit(1)).alias("n_perm"))
