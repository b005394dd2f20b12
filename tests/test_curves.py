"""ROC and PR points against the textbook rule, over several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from ignis.operators import metrics as M
from ignis.operators import prefix as PX
from ignis.operators import stats as ST


def textbook(rows):
    """Cumulative (threshold, fp, tp) from the origin, points whose second differences vanish left out."""
    scores = sorted({s for _, s in rows if s is not None}, reverse=True)
    fp = [sum(y == 0 and s >= t for y, s in rows if s is not None) for t in scores]
    tp = [sum(y == 1 and s >= t for y, s in rows if s is not None) for t in scores]
    keep = [i for i in range(len(scores)) if i in (0, len(scores) - 1)
            or fp[i - 1] - 2 * fp[i] + fp[i + 1] or tp[i - 1] - 2 * tp[i] + tp[i + 1]]
    return [(float("inf"), 0.0, 0.0)] + [(scores[i], fp[i] / fp[-1], tp[i] / tp[-1]) for i in keep]


def rows_of(seed, n, values):
    r = random.Random(seed)
    return [(r.randrange(2), r.randrange(values) / values if r.random() > 0.02 else None) for _ in range(n)]


@pytest.mark.parametrize("blocks", [1, 7])
def test_roc_points_equal_textbook(spark, monkeypatch, blocks):
    monkeypatch.setattr(PX, "blocks_for", lambda n: blocks)
    for seed, n, values in ((1, 400, 2000), (2, 300, 12), (3, 50, 3), (4, 2000, 500)):
        rows = rows_of(seed, n, values) + [(1, 2.0), (1, 2.5), (1, 3.0), (0, -1.0), (0, -2.0), (0, -3.0)]
        got = M.roc_curve(spark.createDataFrame(rows, "label int, score double")).collect()
        want = textbook(rows)
        assert sorted((r.threshold, round(r.fpr, 12), round(r.tpr, 12)) for r in got) == sorted((t, round(a, 12), round(b, 12)) for t, a, b in want)
        assert len(want) < len({s for _, s in rows}) + 1


def test_pr_points_close(spark):
    rows = rows_of(5, 200, 30)
    got = M.pr_curve(spark.createDataFrame(rows, "label int, score double")).collect()
    assert [(r.precision, r.recall) for r in got if r.threshold is None] == [(1.0, 0.0)]
    assert len(got) == len({s for _, s in rows if s is not None}) + 1 and max(r.recall for r in got) == 1.0


def test_curves_without_rows_or_with_one_class(spark):
    none = spark.createDataFrame([], "label int, score double")
    assert M.roc_curve(none).count() == 0 and M.pr_curve(none).count() == 0
    one = M.roc_curve(spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")).collect()
    assert sorted((r.threshold, r.fpr, r.tpr) for r in one) == [(0.2, None, 1.0), (0.7, None, 0.5), (float("inf"), None, 0.0)]


def test_following_hands_rows_across_blocks(spark):
    rows = [(float(i * i % 1009), i) for i in range(900)]
    rows = list({x: (x, v) for x, v in rows}.values())
    df = spark.createDataFrame(rows, "x double, v long").repartition(5)
    for down in (False, True):
        got = {r.x: r.next_v for r in PX.following(df, "x", ["v"], descending=down, n_blocks=23).collect()}
        order = sorted(rows, reverse=down)
        assert [got[x] for x, _ in order] == [v for _, v in order[1:]] + [None]


def test_trend_needs_enough_years(spark):
    d = spark.range(10).select(F.col("id").alias("yr"), (F.col("id") * 2).alias("n_"))
    assert ST.yearly_trend(d, "yr", ["n_"]).count() == 0 and ST.yearly_trend(d, "yr", ["n_"], 10).first().slope == 2.0
