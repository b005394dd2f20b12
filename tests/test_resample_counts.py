"""Resampling by counts: exact sums, marginals, metrics against expanded rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ignis.operators import resample as RS
from ignis.operators import resample_counts as RC


def rows_of(seed, n, values):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        y = r.randrange(2)
        s = min(1.0, max(0.0, round(r.gauss(0.45 + 0.15 * y, 0.2) * values) / values))
        out.append((y, s, int(s >= 0.5)))
    return out + [(None, 0.5, 1), (1, None, 1), (0, float("nan"), 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, pred int").repartition(4)


def auc_of(rows):
    pos, neg = [s for y, s, _ in rows if y == 1], [s for y, s, _ in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def ap_of(rows):
    total, out, tp, seen = sum(y for y, *_ in rows), 0.0, 0, 0
    for s in sorted({s for _, s, _ in rows}, reverse=True):
        own = [y for y, x, _ in rows if x == s]
        tp, seen = tp + sum(own), seen + len(own)
        out += sum(own) / total * tp / seen
    return out


def test_replicates_equal_expanded_rows(spark):
    """Each replicate's draws are made again, its rows written out, its metrics computed on them."""
    rows = rows_of(1, 300, 25)
    df = frame(spark, rows)
    got = {r.rep: r for r in RC.bootstrap_replicates(df, n_boot=70, seed=5, block_scores=8).collect()}
    known = [r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1]]
    assert len(got) == 70 and {r.n_pos + r.n_neg for r in got.values()} == {len(known)}
    cells, totals = RC._blocks(RC.score_cells(df, "label", "score", "pred"), 8)
    assert len(totals) > 2
    by = {}
    for r in cells.collect():
        by.setdefault(r.block, []).append((r.s, list(r.kinds)))
    order = sorted(totals)
    for rep in range(0, 70, 7):
        drawn = RC.multinomial(np.random.default_rng([5, rep]), len(known), np.array([totals[b] for b in order]).ravel()).reshape(-1, 4)
        sample = []
        for b, k in zip(order, drawn):
            rng = np.random.default_rng([5, rep, b + 1])
            own = sorted(by[b], reverse=True)
            for i, (y, p) in enumerate(RC.KINDS):
                for (s, _), times in zip(own, RC.multinomial(rng, int(k[i]), np.array([c[i] for _, c in own]))):
                    sample += [(y, s, p)] * int(times)
        r = got[rep]
        assert len(sample) == len(known) and set(sample) <= set(known)
        assert abs(r.roc_auc - auc_of(sample)) < 1e-12 and abs(r.average_precision - ap_of(sample)) < 1e-12
        assert abs(r.accuracy - sum(y == p for y, _, p in sample) / len(sample)) < 1e-12


def chi2(seen, want):
    return ((seen - want) ** 2 / want).sum()


def test_marginals_of_the_draws():
    counts = np.array([5, 0, 1, 40, 30, 24, 100])
    draws = np.stack([RC.multinomial(np.random.default_rng([3, i]), 200, counts) for i in range(4000)])
    assert (draws.sum(1) == 200).all() and (draws[:, 1] == 0).all()
    want = 4000 * 200 * counts / counts.sum()
    assert chi2(draws.sum(0)[counts > 0], want[counts > 0]) < 25  # 5 degrees of freedom: 20.5 at 0.001
    p = counts / counts.sum()
    assert np.allclose(draws.var(0)[counts > 0], (200 * p * (1 - p))[counts > 0], rtol=0.12)


def test_hypergeometric_draws(monkeypatch):
    counts = np.array([7, 0, 3, 50, 20])
    for most in (1_000_000_000, 10):  # numpy's, and by rejection
        monkeypatch.setattr(RC, "NUMPY_MOST", most)
        draws = np.stack([RC.hypergeometric(np.random.default_rng([4, i]), 30, counts) for i in range(3000)])
        assert (draws.sum(1) == 30).all() and (draws <= counts).all()
        n = counts.sum()
        assert np.allclose(draws.mean(0), 30 * counts / n, atol=0.12)
        var = 30 * counts / n * (1 - counts / n) * (n - 30) / (n - 1)
        assert np.allclose(draws.var(0), var, rtol=0.12, atol=1e-9)
        assert (RC.hypergeometric(np.random.default_rng(1), n, counts) == counts).all()
    monkeypatch.setattr(RC, "NUMPY_MOST", 1_000_000_000)
    big = [RC.one_hypergeometric(np.random.default_rng(i), 4 * 10 ** 9, 6 * 10 ** 9, 10 ** 10) for i in range(400)]
    assert abs(np.mean(big) - 1.5e9) < 4 * np.sqrt(4e9 * .375 * .625 * .75 / 400)


def test_permutations_have_exact_positives_and_the_right_spread(spark):
    rows = rows_of(2, 500, 40)
    df = frame(spark, rows)
    found, seen = RC.permutation_aucs(df, n_perm=1000, seed=3, block_scores=8)
    got = found.collect()
    known = [r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1]]
    assert len(got) == 1000 and {r.n_pos for r in got} == {seen["n_pos"]} == {sum(y for y, *_ in known)}
    assert abs(seen["observed"] - auc_of(known)) < 1e-12
    aucs = np.array([r.auc for r in got])
    rng = np.random.default_rng(0)
    labels, scores = np.array([y for y, *_ in known]), np.array([s for _, s, _ in known])
    ranks = np.array([(scores < s).sum() + ((scores == s).sum() + 1) / 2 for s in scores])
    def one():
        own = rng.permutation(labels)
        p = own.sum()
        return (ranks[own == 1].sum() - p * (p + 1) / 2) / (p * (len(own) - p))
    other = np.array([one() for _ in range(1000)])
    assert abs(aucs.mean() - 0.5) < 0.004 and abs(aucs.std() / other.std() - 1) < 0.1


def test_p_value_within_sampling_error_of_the_row_version(spark):
    r = random.Random(7)
    rows = [(i, int(r.random() < 0.5), round(r.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    a = RC.permutation_counts(df, n_perm=1000, seed=1).first()
    b = RS.permutation_test(df, n_perm=1000, seed=1).first()
    assert a.observed_auc == pytest.approx(b.observed_auc) and abs(a.p_value - b.p_value) < 0.08 and a.n_perm == 1000


def test_repeated_rows_cost_cells_only(spark):
    """Ten copies of each row: the same cells, the same number of draws to make."""
    rows = rows_of(3, 400, 30)
    one, ten = (RC.score_cells(frame(spark, rows * k), "label", "score", "pred") for k in (1, 10))
    assert one.count() == ten.count()
    scale = {r.s: list(r.kinds) for r in one.collect()}
    assert all(list(r.kinds) == [10 * k for k in scale[r.s]] for r in ten.collect())
    wide, narrow = (RC.bootstrap_counts(frame(spark, rows * k), n_boot=200).where("metric = 'roc_auc'").first() for k in (1, 10))
    assert (narrow.ci_high - narrow.ci_low) < 0.5 * (wide.ci_high - wide.ci_low)


def test_intervals_agree_with_poisson_weights(spark):
    from ignis.plans import views as V
    exact = {r.metric: r for r in RC.bootstrap_counts(V.scored(spark, SF01), n_boot=300).collect()}
    poisson = {r.metric: r for r in RS.bootstrap_ci(V.scored(spark, SF01), n_boot=300).collect()}
    assert set(exact) == set(poisson)
    for m, r in exact.items():
        assert r.n_reps == 300 and abs(r.mean - poisson[m].mean) < 0.005
        assert abs((r.ci_high - r.ci_low) / (poisson[m].ci_high - poisson[m].ci_low) - 1) < 0.35


def test_nothing_to_draw(spark):
    none = frame(spark, []).limit(0)
    assert RC.bootstrap_counts(none, n_boot=5).count() == 0
    one = frame(spark, [(1, 0.3, 0), (1, 0.6, 1)])
    assert RC.bootstrap_counts(one, n_boot=5).count() == 0 and RC.permutation_counts(one, n_perm=3).first().n_perm == 3
