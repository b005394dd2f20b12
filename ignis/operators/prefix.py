"""Global order statistics without a single-partition window over raw rows.

``prefix_sums`` is a two-level scan: rows are assigned to ranges of the ordering
column (as many as the row count takes, bounds from Spark's quantile sketch), block
totals are summed (a tiny table), their running totals become per-block
offsets, and the final running sum is a window partitioned by
``(group, block)``.  The only unpartitioned window runs over the
block table.  Exact ranks, exact quantiles, ROC/PR curves,
splits and permutation ranks are all built on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a block should hold, and the most blocks a plan is given (blocks then hold more rows; their windows spill).
ROWS_PER_BLOCK = 250_000
MAX_BLOCKS = 4096
#: Up to this many bounds the block is a balanced CASE (generated code); beyond, a binary search in a literal array.
CASE_BOUNDS = 256
#: Sampled values per block for bounds of a type that has no quantile sketch.
SAMPLE_PER_BLOCK = 64


def blocks_for(n_rows: int) -> int:
    """Blocks for an input of ``n_rows``: one per ROWS_PER_BLOCK."""
    return max(1, min(MAX_BLOCKS, -(-n_rows // ROWS_PER_BLOCK)))


def _case_index(x: Column, bounds: list, lo: int, hi: int) -> Column:
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x >= F.lit(bounds[mid]), _case_index(x, bounds, mid + 1, hi)) \
            .otherwise(_case_index(x, bounds, lo, mid))


def _block_index(x: Column, bounds: list) -> Column:
    """Number of bounds <= x, in O(log k) per row; 0 for a missing x."""
    k = len(bounds)
    if k <= CASE_BOUNDS:
        return _case_index(x, bounds, 0, k)
    literal = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in range(k.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= k) & (x >= F.get(literal, at + step - 1)), at + step).otherwise(at))


def block_bounds(df: DataFrame, col: str, n_blocks: int, rel_err: float | None = None, n_rows: int | None = None) -> list:
    """~n_blocks ascending split points of ``col`` (only the bounds reach the
    driver).  Numbers: the quantile sketch.  Other types: every k-th value of a
    sample of about SAMPLE_PER_BLOCK values per block, ranked in Spark."""
    if n_blocks <= 1:
        return []
    if isinstance(df.schema[col].dataType, T.NumericType):
        qs = df.approxQuantile(col, [i / n_blocks for i in range(1, n_blocks)], rel_err or min(0.001, 0.2 / n_blocks))
    else:
        known = df.select(col).where(F.col(col).isNotNull())
        n = known.count() if n_rows is None else n_rows
        want = SAMPLE_PER_BLOCK * n_blocks
        sample = known.sample(False, min(1.0, want / max(n, 1)), seed=17) if n > want else known
        ranked = sample.select(col, F.row_number().over(Window.orderBy(col)).alias("__r"),
                               F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"))
        step = F.greatest(F.floor(F.col("__n") / n_blocks), F.lit(1))
        qs = [r[0] for r in ranked.where((F.col("__r") % step == 0) & (F.col("__r") < F.col("__n")))
              .orderBy("__r").select(col).collect()]
    out = []
    for q in qs:
        if q is not None and (not out or q > out[-1]):
            out.append(q)
    return out


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__k_{k}" for k in keys])


def prefix_sums(df: DataFrame, order_col: str, value_cols: Sequence[str], group_cols: Sequence[str] = (),
                descending: bool = False, tiebreak: Sequence[str] = (), inclusive: bool = True,
                n_blocks: int | None = None, bounds: list | None = None, prefix: str = "cum_",
                stored: bool = False) -> DataFrame:
    """Running sums of ``value_cols`` in ``order_col`` order within ``group_cols``.

    ``inclusive=False`` gives the sum over strictly earlier rows.  Rows with
    equal order value are ordered by ``tiebreak``; give each row a distinct
    order (or aggregate to distinct values first) for a deterministic result.
    A NULL group is a group.  The input is read for the bounds, the block totals
    and the result, so it is checkpointed once, unless the caller says that it
    is ``stored`` already.
    """
    group_cols, value_cols = list(group_cols), list(value_cols)
    if not stored:
        df = df.checkpoint(eager=True)
    if bounds is None:
        n = df.count()
        bounds = block_bounds(df, order_col, n_blocks or blocks_for(n), n_rows=n)
    k = len(bounds)
    blk = _block_index(F.col(order_col), bounds)
    if descending:
        blk = F.lit(k) - blk
    order = [F.col(order_col).desc() if descending else F.col(order_col).asc()] + [F.col(c).asc() for c in tiebreak]
    upto = 0 if inclusive else -1
    w = Window.partitionBy(*group_cols, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    d = df.withColumn("__blk", blk.cast("int"))
    own = lambda v: F.coalesce(F.sum(v).over(w), F.lit(0))
    if not k:  # one block: nothing lies before it
        return d.select(*df.columns, *[own(v).alias(f"{prefix}{v}") for v in value_cols])
    totals = d.groupBy(*group_cols, "__blk").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    before = Window.partitionBy(*group_cols).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "__blk",
                            *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}")
                              for v in value_cols])
    # The offsets table has (#groups x #blocks) rows; AQE broadcasts it when its
    # measured size is under the broadcast threshold, otherwise it is shuffled.
    d = null_safe_join(d, offsets, [*group_cols, "__blk"])
    return d.select(*df.columns, *[(own(v) + F.col(f"__o_{v}")).alias(f"{prefix}{v}") for v in value_cols])


def bounds_of(df: DataFrame, col: str, n_blocks: int | None = None) -> list:
    """Bounds of as many blocks as the rows of ``df`` (stored) take."""
    n = df.count()
    return block_bounds(df, col, n_blocks or blocks_for(n), n_rows=n)


def following(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False, bounds: list | None = None,
              source: DataFrame | None = None, n_blocks: int | None = None, prefix: str = "next_") -> DataFrame:
    """Adds the values of the next row in ``order_col`` order (null after the last),
    where each row has an order of its own.  ``source`` is a stored frame of the same
    rows, by default ``df`` itself.

    Inside a block the next row comes from a window over the block; the last row of
    a block is handed the first row of the next one that has rows, through a table
    of one row a block."""
    value_cols, source = list(value_cols), df if source is None else source
    if bounds is None:
        bounds = bounds_of(source, order_col, n_blocks)
    blk = _block_index(F.col(order_col), bounds)
    blk = (F.lit(len(bounds)) - blk if descending else blk).cast("int")
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    d = df.withColumn("__blk", blk).withColumn("__own", F.lead(F.struct(*value_cols)).over(Window.partitionBy("__blk").orderBy(order)))
    if bounds:
        row = F.struct(F.col(order_col).alias("o"), F.struct(*value_cols).alias("v"))
        firsts = source.groupBy(blk.alias("__blk")).agg((F.max(row) if descending else F.min(row))["v"].alias("__v"))
        handed = firsts.select("__blk", F.lead("__v").over(Window.orderBy("__blk")).alias("__first"))  # one row a block
        d = d.join(handed, "__blk").withColumn("__own", F.coalesce("__own", "__first"))
    return d.select(*df.columns, *[F.col(f"__own.{v}").alias(f"{prefix}{v}") for v in value_cols])


def rank_rows(df: DataFrame, order_col: str, group_cols: Sequence[str] = (), tiebreak: Sequence[str] = (),
              out: str = "rank", descending: bool = False, n_blocks: int | None = None, stored: bool = False) -> DataFrame:
    """1-based ``row_number`` within ``group_cols`` (ties broken by ``tiebreak``)."""
    d = df.withColumn("__one", F.lit(1).cast("long"))
    r = prefix_sums(d, order_col, ["__one"], group_cols, descending=descending, tiebreak=tiebreak,
                    n_blocks=n_blocks, prefix="__cum", stored=stored)
    return r.withColumnRenamed("__cum__one", out).drop("__one")


def dense_rank_values(dictionary: DataFrame, col: str, out: str) -> DataFrame:
    """0-based dense rank of the distinct values in ``dictionary`` (one row per value)."""
    r = rank_rows(dictionary, col, out="__r")
    return r.select(col, (F.col("__r") - 1).cast("int").alias(out))


def value_counts(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group, value, __c): rows per distinct present value, checkpointed."""
    valid = F.col(value_col).isNotNull() & ~F.isnan(value_col)
    return df.where(valid).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("__c")).checkpoint(eager=True)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    n_blocks: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles (numpy/pandas default) per group.

    Distributed selection: counts per distinct value (the only pass over the
    input), two-level running counts, then the values at ranks
    floor/ceil((N-1)p) are picked by an equi-join on the group key.  No group is
    ever gathered into one task.  Output: group columns, ``p``, ``q``.
    """
    return quantiles_of_counts(value_counts(df, value_col, group_cols), value_col, probs, group_cols, n_blocks)


def quantiles_of_counts(counts: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                        n_blocks: int | None = None) -> DataFrame:
    """``exact_quantiles`` from stored ``value_counts``."""
    group_cols = list(group_cols)
    if not group_cols:
        return _exact_quantiles_global(counts, value_col, probs, n_blocks)
    cum = prefix_sums(counts, value_col, ["__c"], group_cols, n_blocks=n_blocks, prefix="__cum", stored=True)
    totals = counts.groupBy(*group_cols).agg(F.sum("__c").alias("__n"))
    parr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (totals.select(*group_cols, "__n", F.explode(parr).alias("p"))
                     .withColumn("__h", (F.col("__n") - 1) * F.col("p"))
                     .withColumn("__lo", F.floor("__h").cast("long"))
                     .withColumn("__hi", F.ceil("__h").cast("long"))
                     .withColumn("__frac", F.col("__h") - F.col("__lo")))
    start = F.col("__cum__c") - F.col("__c")
    hit_lo = (start <= F.col("__lo")) & (F.col("__lo") < F.col("__cum__c"))
    hit_hi = (start <= F.col("__hi")) & (F.col("__hi") < F.col("__cum__c"))
    # equi-join on the group key; the target table has (#groups x #probs) rows
    # and AQE broadcasts it when its measured size allows
    picked = null_safe_join(cum, targets, group_cols).where(hit_lo | hit_hi)
    v = F.col(value_col).cast("double")
    res = (picked.groupBy(*group_cols, "p")
                 .agg(F.max(F.when(hit_lo, v)).alias("__vlo"), F.max(F.when(hit_hi, v)).alias("__vhi"),
                      F.first("__frac").alias("__frac")))
    q = F.col("__vlo") + F.col("__frac") * (F.col("__vhi") - F.col("__vlo"))
    return res.select(*group_cols, "p", F.when(F.col("__frac") == 0, F.col("__vlo")).otherwise(q).alias("q"))


def _ranks(n: int, p: float, plotting: float | None) -> tuple[int, int, float]:
    """0-based ranks below and above the p-quantile of n values, and the share of
    the upper one: linear interpolation, or plotting positions with
    alphap = betap = ``plotting``."""
    if plotting is None:
        h = (n - 1) * p
        lo = int(h // 1)
        return lo, int(-(-h // 1)), h - lo
    at = n * p + plotting + p * (1 - 2 * plotting)
    k = int(min(max(at, 1), max(n - 1, 1)) // 1)
    return k - 1, min(k, n - 1), min(max(at - k, 0.0), 1.0)


def plotting_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], plotting: float = 0.4) -> DataFrame:
    """Ungrouped quantiles (p, q) at plotting positions."""
    return _exact_quantiles_global(value_counts(df, value_col), value_col, probs, None, plotting)


def _exact_quantiles_global(counts: DataFrame, value_col: str, probs: Sequence[float], n_blocks: int | None,
                            plotting: float | None = None) -> DataFrame:
    """Ungrouped case: the row count (one number) is fetched, the needed ranks
    are computed on the driver and selected with a literal filter -- no join."""
    spark = counts.sparkSession
    n = counts.agg(F.sum("__c").alias("n")).first()["n"] or 0
    if n == 0:
        return spark.createDataFrame([(float(p), None) for p in probs], "p double, q double")
    cum = prefix_sums(counts, value_col, ["__c"], n_blocks=n_blocks, prefix="__cum", stored=True)
    start = F.col("__cum__c") - F.col("__c")
    plan = [(float(p), *_ranks(n, float(p), plotting)) for p in probs]
    ranks = sorted({r for _, lo, hi, _ in plan for r in (lo, hi)})
    covers = [(start <= F.lit(r)) & (F.lit(r) < F.col("__cum__c")) for r in ranks]
    cond = covers[0]
    for c in covers[1:]:
        cond = cond | c
    v = F.col(value_col).cast("double")
    one = cum.where(cond).agg(*[F.max(F.when(c, v)).alias(f"r{r}") for r, c in zip(ranks, covers)])
    rows = [F.struct(F.lit(p).alias("p"),
                     (F.col(f"r{lo}") + F.lit(frac) * (F.col(f"r{hi}") - F.col(f"r{lo}")) if frac
                      else F.col(f"r{lo}")).alias("q"))
            for p, lo, hi, frac in plan]
    return one.select(F.explode(F.array(*rows)).alias("__r")).select("__r.*")


def quantiles_wide(df: DataFrame, value_col: str, probs: dict[str, float], group_cols: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per named probability."""
    return _wide(exact_quantiles(df, value_col, list(probs.values()), group_cols), probs, group_cols)


def _wide(long: DataFrame, probs: dict[str, float], group_cols: Sequence[str]) -> DataFrame:
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name) for name, p in probs.items()]
    if group_cols:
        return long.groupBy(*group_cols).agg(*aggs)
    return long.agg(*aggs)


def quantiles_wide_of_counts(counts: DataFrame, value_col: str, probs: dict[str, float], group_cols: Sequence[str] = ()) -> DataFrame:
    """``quantiles_wide`` from stored ``value_counts``."""
    return _wide(quantiles_of_counts(counts, value_col, list(probs.values()), group_cols), probs, group_cols)
