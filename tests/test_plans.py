"""Plan-shape checks: no Python UDFs in the core, no cartesian products, one
window sort for both antecedent frames, pushed-down scans."""

from conftest import SF001
from ignis.operators import metrics as M
from ignis.plans import views as V
from ignis.sources import fixtures as fx


def _plan(df) -> str:
    """The executed plan; with AQE, only its final part."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_joined_features_plan(spark):
    plan = _plan(V.joined(spark, SF001))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # both antecedent frames and the day-of frame are evaluated by the same Window node(s) over one sort
    assert plan.count("Window [") == 1
    window_sorts = [line for line in plan.split("\n") if "Sort [__site" in line and "__dn" in line]
    assert len(window_sorts) == 1


def test_nearest_plan_has_no_pairing_of_all_rows(spark):
    from ignis.operators.nearest import nearest_site
    df = nearest_site(V.clean(spark, SF001), fx.sites(spark, SF001))
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_curve_has_no_single_partition_exchange_over_rows(spark):
    df = M.roc_curve(fx.scored(spark, SF001))
    df.collect()
    plan = _plan(df)
    # the only global (unpartitioned) window is over the block table
    assert plan.count("SinglePartition") <= 1


def test_scan_pushdown_and_pruning(spark):
    df = fx.incidents(spark, SF001).where("inc_id < 100").select("inc_id", "cause")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)" in plan or "LessThan(o_orderkey,100)" in plan
    assert "ReadSchema" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_no_nested_loop_join_in_one_row_combinations(spark):
    from __spark_entry__ import queries
    qs = queries()
    for name in ("baseline_lift", "size_describe", "site_distance_quantiles", "class_distribution"):
        df = qs[name](spark, SF001)
        df.collect()
        plan = _plan(df)
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_weather_window_partitioned_by_site_and_block(spark):
    from ignis.operators.climate import weather_features
    from ignis.operators.clean import fire_date
    from ignis.operators.nearest import nearest_site
    inc = fire_date(nearest_site(V.clean(spark, SF001), fx.sites(spark, SF001)))
    df = weather_features(inc, fx.daily_obs(spark, SF001), probe_site="nearest_site", probe_date="fire_date")
    df.collect()
    plan = _plan(df)
    assert plan.count("Window [") == 1                     # day-of, 7-day and 30-day frames in one node
    assert "hashpartitioning(__site" in plan and "__blk" in plan.split("hashpartitioning(__site")[1].split(")")[0]


def _scans(spark, table, run):
    """How often the executed plans of ``run`` scan a table's files, eager jobs included."""
    tracker = []
    frame = type(spark.range(0))
    checkpoint = frame.checkpoint
    def counted(self, *a, **k):
        out = checkpoint(self, *a, **k)
        tracker.append(_plan(self))
        return out
    frame.checkpoint = counted
    try:
        df = run()
        df.collect()
        tracker.append(_plan(df))
    finally:
        frame.checkpoint = checkpoint
    return sum(line.count(f"{table}.parquet") for text in tracker for line in text.split("\n") if "FileScan" in line)


def test_input_is_scanned_once(spark):
    from __spark_entry__ import queries
    qs = queries()
    for name in ("yearly_stats", "roc_curve", "stratified_split"):
        assert _scans(spark, "orders", lambda n=name: qs[name](spark, SF001)) == 1, name


def test_observations_are_pruned_by_the_probes(spark):
    from ignis.operators.climate import weather_features
    probes = fx.daily_obs(spark, SF001).where("site_id = 1 and dn = 100").selectExpr("site_id", "obs_date as fire_date")
    df = weather_features(probes, fx.daily_obs(spark, SF001))
    assert "LeftSemi" in _plan(df)
    assert df.count() == 1


def test_bootstrap_expansion_is_not_shuffled(spark):
    from ignis.operators.resample import bootstrap_ci
    df = bootstrap_ci(fx.scored(spark, SF001), n_boot=20)
    df.collect()
    plan = _plan(df)
    # the only exchange keyed by the score block is the repartition of the input rows
    assert "REPARTITION_BY_NUM" in plan or "REPARTITION_BY_COL" in plan
    for line in plan.split("\n"):
        if "Exchange hashpartitioning(" in line and "ENSURE_REQUIREMENTS" in line:
            keys = line.split("Exchange hashpartitioning(")[1]
            assert not keys.startswith("__blk"), line    # no re-shuffle of expanded rows by block
