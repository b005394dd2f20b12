"""Splits, folds, sampling, bootstrap and permutation tests.

All randomness comes from ``ignis.functions.hashing.mix_col`` -- a seeded
integer hash of the row id -- so every result is deterministic, survives task
retries and executor loss unchanged, and can be replayed in SQL.
Replicate x row expansions are generated inside tasks (``explode(sequence)``)
and reduced by partial aggregates before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ignis.functions.hashing import LANE, ReplicateMix, bucket_col, with_mix, with_replicate_mix
from ignis.functions.hashing import RANGE as HASH_RANGE
from ignis.operators.metrics import metrics_from_counts
from ignis.operators.prefix import MAX_BLOCKS, _block_index, block_bounds, null_safe_join, prefix_sums, rank_rows


def n_buckets_for(group_size: int, rows_per_bucket: int = 64, most: int = 1 << 16) -> int:
    """Power-of-two bucket count so a bucket holds ~``rows_per_bucket`` rows
    (more, where that takes over ``most`` buckets)."""
    b = 16
    while b < most and group_size / b > rows_per_bucket:
        b <<= 1
    return b


def flag_smallest(df: DataFrame, group_cols: Sequence[str], h_col: str, id_col: str, k_col: str,
                  out: str = "selected", n_buckets: int = 4096) -> DataFrame:
    """Flag, per group, the ``k_col`` rows with the smallest (hash, id).

    The hash is uniform: a per-group histogram over ``n_buckets`` buckets (a
    partial aggregate) locates the boundary bucket; only rows of that one bucket
    are ranked exactly.  ``k_col`` must be constant per group; a NULL group is a
    group.  ``df`` is read three times, so it should be stored.
    """
    g = list(group_cols)
    d = df.withColumn("__b", bucket_col(F.col(h_col), n_buckets))
    hist = d.groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__c"), F.first(k_col).alias("__k"))
    w = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__cum", F.sum("__c").over(w))
    edge = (hist.where((F.col("__cum") >= F.col("__k")) & (F.col("__cum") - F.col("__c") < F.col("__k")))
                .select(*g, F.col("__b").alias("__edge"), (F.col("__k") - (F.col("__cum") - F.col("__c"))).alias("__need")))
    # ``edge`` has one row per group; callers pass few groups (classes), so the
    # broadcast is bounded by the group count they already know
    d = null_safe_join(d, F.broadcast(edge), g, "left")
    in_edge = F.col("__b") == F.col("__edge")
    wr = Window.partitionBy(*g, "__b").orderBy(F.col(h_col), F.col(id_col))
    edge_rows = (d.where(in_edge).withColumn("__r", F.row_number().over(wr))
                  .withColumn(out, F.col("__r") <= F.col("__need")).drop("__r"))
    rest = d.where(~in_edge | F.col("__edge").isNull())
    rest = rest.withColumn(out, F.coalesce(F.col("__b") < F.col("__edge"), F.col(k_col) > 0))
    edge_rows, rest = (x.drop("__b", "__edge", "__need") for x in (edge_rows, rest))
    return rest.unionByName(edge_rows)


MAX_CLASSES = 10_000


def _allocate(counts: dict, n_take: int) -> dict:
    """Largest-remainder allocation of ``n_take`` over classes by their share."""
    n = sum(counts.values())
    base = {c: (n_take * v) // n for c, v in counts.items()}
    left = n_take - sum(base.values())
    order = sorted(counts, key=lambda c: (-((n_take * counts[c]) % n), c is None, c if c is not None else 0))
    for c in order[:left]:
        base[c] += 1
    return base


def _class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; more than MAX_CLASSES classes are an error (a label, not a key, is meant)."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    return {r[label]: r["n"] for r in rows}


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id", test_frac: float = 0.2,
                     seed: int = 42, exact: bool = True) -> DataFrame:
    """Adds ``split`` in {'train','test'}.

    ``exact=True``: the test set has ceil(test_frac * n) rows shared over the
    classes by largest remainder (stratified shuffle split sizes); rows are
    chosen by the smallest seeded hash per class; rows without a label are a
    class of their own.  The input is stored once and read from there.
    ``exact=False``: a hash threshold per row, no shuffle at all, shares are
    approximate.
    """
    if not exact:
        d = with_mix(df, "__h", id_col, seed)
        return d.withColumn("split", F.when(F.col("__h") < F.lit(int(test_frac * HASH_RANGE)), "test")
                            .otherwise("train")).drop("__h")
    df = with_mix(df, "__h", id_col, seed).checkpoint(eager=True)
    counts = _class_counts(df, label)
    n = sum(counts.values())
    take = _allocate(counts, int(math.ceil(test_frac * n))) if n else {}
    per_class = df.sparkSession.createDataFrame([(c, t) for c, t in take.items()],
                                                f"`{label}` {df.schema[label].dataType.simpleString()}, __kt long")
    d = null_safe_join(df, F.broadcast(per_class), [label], "left")  # one row a class
    f = flag_smallest(d, [label], "__h", id_col, "__kt", out="__test", n_buckets=n_buckets_for(max(counts.values(), default=0)))
    return f.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__h", "__kt", "__test")


def stratified_folds(df: DataFrame, label: str = "label", id_col: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1: rows ranked by seeded hash within their class
    and dealt round-robin, so every fold has the same class mix (+-1 row)."""
    d = with_mix(df, "__h", id_col, seed)
    r = rank_rows(d, "__h", [label], tiebreak=[id_col], out="__rank")
    return r.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__h", "__rank")


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Simple random sample of ``n`` rows without replacement (deterministic):
    the rows with the smallest seeded hash.  Up to SAMPLE_TOP_K rows by a top-k;
    more by a histogram of the hash and exact ranks in its boundary bucket, so
    that the sample is never merged in one task."""
    d = with_mix(df, "__h", id_col, seed)
    if n <= SAMPLE_TOP_K:
        return d.orderBy("__h", id_col).limit(n).drop("__h")
    d = d.withColumn("__all", F.lit(0)).withColumn("__kt", F.lit(n).cast("long")).checkpoint(eager=True)
    f = flag_smallest(d, ["__all"], "__h", id_col, "__kt", out="__in", n_buckets=n_buckets_for(d.count()))
    return f.where("__in").select(*df.columns)


SAMPLE_TOP_K = 100_000


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Per-row weight: positives get n_neg / n_pos, all others 1.0."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    ratio = n["neg"] / n["pos"] if n["pos"] else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


# Poisson(1) cumulative probabilities P(K <= j), j = 0..11.
POISSON1_CDF = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(j + 1)) for j in range(12)]


def poisson_weight(u) -> F.Column:
    """Inverse-CDF draw of Poisson(1) from a uniform column."""
    return sum((F.when(u >= F.lit(c), 1).otherwise(0) for c in POISSON1_CDF), F.lit(0))


def spread_for_expansion(df: DataFrame, key: str) -> DataFrame:
    """Before a replicate x row expansion, make sure the input is split over at
    least the cluster's default parallelism (hash of ``key``, deterministic):
    only the N input rows are shuffled, never the N x replicates rows."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want, key)
    return df


#: Expanded rows (input rows x replicates) that a score block should stand for, and rows of an offset table that is broadcast.
EXPANDED_PER_BLOCK, OFFSET_ROWS = 2e7, 1_000_000


def bootstrap_ci(df: DataFrame, label: str = "label", score: str = "score", pred: str = "pred", id_col: str = "id",
                 n_boot: int = 1000, seed: int = 42, probs: tuple[float, float] = (0.025, 0.975),
                 n_blocks: int | None = None) -> DataFrame:
    """Bootstrap mean and percentile interval of ROC-AUC, PR-AUC, F1 and accuracy.

    Each replicate re-weights every row by an independent Poisson(1) count (the
    usual distributed stand-in for drawing n rows with replacement); replicates
    with a single class are skipped.

    Plan: rows get a descending score block (bounds from the quantile sketch)
    and only the N input rows are hash-partitioned by block.  The replicate
    expansion, the (block, replicate, score) aggregation and the in-block
    running sums all stay inside those partitions (hash partitioning on the
    block satisfies clustering on (block, replicate)), so the N x replicates
    rows are never shuffled, even when every score is distinct.  A block that is
    overfull holds few scores that many rows share: such blocks are dealt by a
    salt of the id instead, and what their tasks have summed per score meets in
    a second aggregate.  The (replicate x block) offset table is broadcast; where
    it would pass OFFSET_ROWS, replicates are done in several turns.
    Output: metric, mean, ci_low, ci_high, n_reps.
    """
    base = with_mix(df.select(id_col, label, F.col(score).cast("double").alias("score"), pred)
                    .where(F.col("score").isNotNull()), "__id", id_col, seed).checkpoint(eager=True)
    n = base.count()
    par = base.sparkSession.sparkContext.defaultParallelism
    if n_blocks is None:
        n_blocks = min(MAX_BLOCKS, max(8 * par, math.ceil(n * n_boot / EXPANDED_PER_BLOCK)))
    bounds = block_bounds(base, "score", n_blocks, n_rows=n)
    k = len(bounds)
    base = base.withColumn("__blk", (F.lit(k) - _block_index(F.col("score"), bounds)).cast("int"))
    sizes = {r["__blk"]: r["n"] for r in base.groupBy("__blk").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= MAX_BLOCKS rows
    fair = max(1, n // max(len(sizes), 1))
    hot = {b: -(-m // fair) for b, m in sizes.items() if m > 4 * fair}
    turn = max(1, min(n_boot, OFFSET_ROWS // (k + 1)))
    reps = None
    for start in range(0, n_boot, turn):
        part = _bootstrap_turn(base, hot, max(par, min(len(sizes), 4 * par)), label, pred, start, min(start + turn, n_boot))
        reps = part if reps is None else reps.unionByName(part)
    names = {"roc_auc": "roc_auc", "pr_auc": "average_precision", "f1": "f1", "accuracy": "accuracy"}
    long = reps.select(F.explode(F.array(*[F.struct(F.lit(k_).alias("metric"), F.col(v).alias("value"))
                                           for k_, v in names.items()])).alias("__m")).select("__m.*")
    # group size is n_boot (a parameter), so the exact percentile buffer is bounded
    return long.groupBy("metric").agg(F.avg("value").alias("mean"),
                                      F.percentile("value", probs[0]).alias("ci_low"),
                                      F.percentile("value", probs[1]).alias("ci_high"),
                                      F.count(F.lit(1)).alias("n_reps"))


def _weighted(x: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Summed Poisson weights per keys and replicate, positive ones."""
    x = x.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    x = with_replicate_mix(x, "__h", "__id", "rep")
    x = x.withColumn("__u", F.col("__h") / F.lit(float(LANE))).withColumn("w", poisson_weight(F.col("__u")))
    # zero-weight rows are dropped after the aggregate: a filter on the weight
    # would be pushed below the projections and re-inline the hash
    return x.groupBy(*keys).agg(F.sum("w").cast("double").alias("w")).where(F.col("w") > 0)


#: What is summed of each replicate and block: positives, negatives, and the confusion counts.
CELLS = ("__tp", "__tn", "tn", "fp", "fn", "tp")


def _cell_totals(first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's summed Poisson weights by replicate, block and cell."""
    least = np.array([math.ceil(c * LANE) for c in POISSON1_CDF])  # a draw of at least the j-th weighs more than j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in _chunks(batches):
            mix, blocks = ReplicateMix(batch.column("__id").to_numpy()), batch.column("__blk").to_numpy()
            y, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "p"))  # NaN where missing
            own, at = np.unique(blocks, return_inverse=True)
            kinds = np.select([y == 1, y == 0], [3, 0], 6) + np.select([p == 1, p == 0], [2, 1], 0)
            cell, sums = at * 9 + kinds, np.empty((last - first, len(own) * 9))
            for i, rep in enumerate(range(first, last)):
                h = mix.draw(rep)
                w = np.zeros(len(h))
                for c in least:
                    more = h >= c
                    if not more.any():
                        break
                    w += more
                sums[i] = np.bincount(cell, w, len(own) * 9)
            for j, blk in enumerate(own.tolist()):
                part = sums[:, j * 9:j * 9 + 9]
                totals[blk] = totals[blk] + part if blk in totals else part.copy()
        for blk, t in totals.items():
            values = (t[:, 3:6].sum(axis=1), t[:, 0:3].sum(axis=1), t[:, 1], t[:, 2], t[:, 4], t[:, 5])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last, dtype=np.int32)), pa.array(np.full(last - first, blk, np.int32)),
                                              *[pa.array(v) for v in values]], ["rep", "__blk", *CELLS])
    return run


def _bootstrap_turn(base: DataFrame, hot: dict[int, int], parts: int, label: str, pred: str, first: int, last: int) -> DataFrame:
    """Replicates first ... last - 1: rep and its four metrics."""
    keys = ["__blk", "rep", "score", label, pred]
    is_hot = F.col("__blk").isin(list(hot)) if hot else F.lit(False)
    branches = [_weighted(base.where(~is_hot).repartition(parts, "__blk"), keys, first, last)]
    if hot:
        salts = F.create_map(*[F.lit(v) for kv in hot.items() for v in kv])
        salted = base.where(is_hot).withColumn("__salt", F.pmod(F.col("__id"), F.get(F.array(salts[F.col("__blk")]), F.lit(0))))
        salted = salted.repartition(max(parts, sum(hot.values())), "__blk", "__salt")
        branches.append(_weighted(salted, [*keys, "__salt"], first, last).groupBy(*keys).agg(F.sum("w").alias("w")))
    y, p, w = F.col(label), F.col(pred), F.col("w")
    # pass 1: per (replicate, block) totals, incl. the confusion counts, from arrays of draws -- a
    # small table (replicates x blocks rows), checkpointed to cut the lineage
    shape = ["__id", "__blk", F.col(label).cast("double").alias("y"), F.col(pred).cast("double").alias("p")]
    rows = [base.where(~is_hot).select(*shape).repartition(parts, "__blk")]
    if hot:
        rows.append(salted.select(*shape))
    tots = [d.mapInArrow(_cell_totals(first, last), "rep int, __blk int, " + ", ".join(f"{c} double" for c in CELLS)) for d in rows]
    tot = _union(tots).groupBy("rep", "__blk").agg(*[F.sum(c).alias(c) for c in CELLS]).checkpoint(eager=True)
    before = Window.partitionBy("rep").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select("rep", "__blk", F.coalesce(F.sum("__tp").over(before), F.lit(0.0)).alias("__op"),
                         F.coalesce(F.sum("__tn").over(before), F.lit(0.0)).alias("__on"))
    cm = metrics_from_counts(tot.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]))
    # pass 2: in-block running sums in descending score order plus the offsets
    wb = Window.partitionBy("__blk", "rep").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = []
    for a in branches:
        sc = a.groupBy("__blk", "rep", "score").agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"),
                                                    F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg"))
        sc = sc.join(F.broadcast(offsets), ["rep", "__blk"])  # at most OFFSET_ROWS rows
        pos, neg = F.col("pos"), F.col("neg")
        sc = sc.select("rep", "pos", "neg", (F.sum("pos").over(wb) + F.col("__op")).alias("cum_pos"),
                       (F.sum("neg").over(wb) + F.col("__on")).alias("cum_neg"))
        cpos, cneg = F.col("cum_pos"), F.col("cum_neg")
        sums.append(sc.groupBy("rep").agg(
            F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"), F.sum(pos * cneg - 0.5 * pos * neg).alias("__disc"),
            F.sum(F.when(cpos + cneg > 0, pos * cpos / (cpos + cneg)).otherwise(0.0)).alias("__ap")))
    rank = _union(sums).groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n_pos", "n_neg", "__disc", "__ap")])
    P, N = F.col("n_pos"), F.col("n_neg")
    rank = rank.where((P > 0) & (N > 0)).select("rep", (F.lit(1.0) - F.col("__disc") / (P * N)).alias("roc_auc"),
                                                (F.col("__ap") / P).alias("average_precision"))
    return rank.join(cm.select("rep", "f1", "accuracy"), "rep")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def average_ranks(df: DataFrame, score: str = "score", out: str = "avg_rank") -> DataFrame:
    """Average (mid) rank of each row's score among all rows, ascending."""
    counts = df.groupBy(F.col(score).cast("double").alias("__s")).agg(F.count(F.lit(1)).alias("__c")).checkpoint(eager=True)
    cum = prefix_sums(counts, "__s", ["__c"], prefix="__cum", stored=True)
    ranks = cum.select("__s", (F.col("__cum__c") - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(score).cast("double") == F.col("__s")).drop("__s")


#: Buckets of the permutation histogram at each step; a boundary bucket is ranked exactly once it holds few enough rows;
#: permutations that are done at a time, and rows whose draws are made at a time.
PERM_BUCKETS, PERM_RANKED, PERM_TURN, PERM_CHUNK = 1024, 1 << 16, 1000, 1 << 14

#: Of each permutation: the start of the interval of draws still open, how many of its rows are wanted, the rank sum below it.
Edges = dict[int, tuple[int, int, float]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PERM_CHUNK):
            yield batch.slice(start, PERM_CHUNK)


def _open_histograms(edges: Edges, step: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows and rank sums by permutation and bucket of ``span`` draws in its open interval."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ranks = np.zeros((len(edges), step), np.int64), np.zeros((len(edges), step))
        for batch in _chunks(batches):
            mix, rank = ReplicateMix(batch.column("__id").to_numpy()), batch.column("avg_rank").to_numpy()
            for i, (perm, (lo, _, _)) in enumerate(edges.items()):
                at = (mix.draw(perm) - lo) // span if lo or span * step < LANE else mix.draw(perm) >> (span.bit_length() - 1)
                own = rank
                if span * step < LANE:
                    inside = np.flatnonzero((at >= 0) & (at < step))
                    at, own = at[inside], rank[inside]
                count[i] += np.bincount(at, minlength=step)
                ranks[i] += np.bincount(at, own, step)
        yield pa.RecordBatch.from_arrays([pa.array(list(edges), pa.int32()), pa.array([v.tobytes() for v in count], pa.binary()),
                                          pa.array([v.tobytes() for v in ranks], pa.binary())], ["perm", "c", "s"])
    return run


def _next_edges(r: DataFrame, edges: Edges, step: int, span: int) -> Edges:
    """The bucket of each permutation that holds the last row wanted; none where none is wanted."""
    def find(own: pa.Table) -> pa.Table:
        perm = own.column("perm")[0].as_py()
        lo, need, below = edges[perm]
        count, ranks = (sum(np.frombuffer(v.as_buffer(), dtype=t) for v in own.column(c)) for c, t in (("c", np.int64), ("s", np.float64)))
        upto = np.cumsum(count)
        at = int(np.searchsorted(upto, need))
        found = [(perm, lo + at * span, int(need - upto[at] + count[at]), float(below + ranks[:at].sum()))] if need > 0 and at < step else []
        return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(
            (("perm", pa.int32()), ("lo", pa.int64()), ("need", pa.int64()), ("below", pa.float64())))})
    parts = r.select("__id", "avg_rank").mapInArrow(_open_histograms(edges, step, span), "perm int, c binary, s binary")
    found = parts.groupBy("perm").applyInArrow(find, "perm int, lo long, need long, below double").collect()  # one row a permutation
    return {f["perm"]: (f["lo"], f["need"], f["below"]) for f in sorted(found)}


def _open_rows(edges: Edges, span: int, id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of each permutation whose draws lie in its open interval."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            mix = ReplicateMix(batch.column("__id").to_numpy())
            perms, draws, rows = [], [], []
            for perm, (lo, _, _) in edges.items():
                h = mix.draw(perm)
                inside = np.flatnonzero((h >= lo) & (h < lo + span))
                perms.append(np.full(len(inside), perm, np.int32))
                draws.append(h[inside])
                rows.append(inside)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(perms)), pa.array(np.concatenate(draws)), batch.column(id_col).take(at),
                                              batch.column("avg_rank").take(at)], ["perm", "__h", id_col, "avg_rank"])
    return run


def _permuted_sums(r: DataFrame, id_col: str, first: int, last: int, n: int, n_pos: int) -> DataFrame:
    """Permutations first ... last - 1: perm and the rank sum of its n_pos smallest draws."""
    edges: Edges = {perm: (0, n_pos, 0.0) for perm in range(first, last)}
    held, span = n, LANE
    while True:
        step = min(PERM_BUCKETS, n_buckets_for(held, 1024), span)
        span //= step
        edges = _next_edges(r, edges, step, span)
        held = -(-held // step)
        if held <= PERM_RANKED or span == 1 or not edges:
            break
    spark = r.sparkSession
    kept = spark.createDataFrame([(p, need, below) for p, (_, need, below) in edges.items()], "perm int, __need long, __below double")
    if not edges:
        return kept.select("perm", F.lit(0.0).alias("__sum"))
    # exact ranking only inside each permutation's open interval; one row per permutation is broadcast
    inner = r.select("__id", id_col, "avg_rank").mapInArrow(_open_rows(edges, span, id_col),
                                                          f"perm int, __h long, `{id_col}` {r.schema[id_col].dataType.simpleString()}, avg_rank double")
    inner = inner.withColumn("__r", F.row_number().over(Window.partitionBy("perm").orderBy("__h", id_col))).join(F.broadcast(kept), "perm")
    return inner.groupBy("perm").agg((F.first("__below") + F.sum(F.when(F.col("__r") <= F.col("__need"), F.col("avg_rank")).otherwise(0.0))).alias("__sum"))


def permutation_test(df: DataFrame, label: str = "label", score: str = "score", id_col: str = "id",
                     n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """ROC-AUC under ``n_perm`` label permutations: each permutation gives the
    positive label to exactly n_pos rows (smallest seeded draw), AUC from the
    rank sum of the (fixed) average score ranks.  p = mean(perm >= observed),
    without +1 correction.  Output: observed_auc, perm_mean, perm_std, p_value,
    p_value_corrected, n_perm.

    Draws are made inside the tasks, as arrays, and reduced there to a histogram
    of at most PERM_BUCKETS buckets per permutation, whatever the number of rows;
    so what is shuffled grows with tasks x permutations only.  The bucket that
    holds the n_pos-th draw is divided again in the same way until it holds few
    rows, which are then ranked."""
    # N rows, read by the totals and by the expansion passes: materialize once
    r = average_ranks(df.select(id_col, label, score), score).select(id_col, label, "avg_rank")
    r = with_mix(r, "__id", id_col, seed + 7).checkpoint(eager=True)
    tot = r.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("np"), F.count(F.lit(1)).alias("n"),
                F.sum(F.when(F.col(label) == 1, F.col("avg_rank")).otherwise(0.0)).alias("rs")).first()
    n_pos, n = int(tot["np"] or 0), int(tot["n"] or 0)
    n_neg = n - n_pos
    denom = float(n_pos * n_neg) if n_pos and n_neg else float("nan")
    base = n_pos * (n_pos + 1) / 2.0
    observed = (float(tot["rs"] or 0.0) - base) / denom
    r = r.repartition(r.sparkSession.sparkContext.defaultParallelism, "__id") if n else r
    sums = _union([_permuted_sums(r, id_col, first, min(first + PERM_TURN, n_perm), n, n_pos) for first in range(0, n_perm, PERM_TURN)])
    perm = sums.select(((F.col("__sum") - F.lit(base)) / F.lit(denom)).alias("auc"))
    obs = F.lit(observed)
    return perm.agg(obs.alias("observed_auc"), F.avg("auc").alias("perm_mean"), F.stddev_pop("auc").alias("perm_std"),
                    F.avg(F.when(F.col("auc") >= obs, 1.0).otherwise(0.0)).alias("p_value"),
                    ((F.sum(F.when(F.col("auc") >= obs, 1.0).otherwise(0.0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value_corrected"),
                    F.count(F.lit(1)).alias("n_perm"))
