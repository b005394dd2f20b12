"""Driver contract: entry runs, every query is registered with an oracle or
listed as rows-only."""

import os
import shutil
import subprocess
import sys
import tempfile

from conftest import SF001

from ignis.plans.queries import QUERIES

ROWS_ONLY = {"train_lr", "train_rf", "train_gbt", "rf_size_regression", "cross_validate",
             "best_model", "feature_importance", "grouped_importance", "partial_dependence", "sampled_shapley",
             "walked_dependence", "tree_shapley", "bootstrap_multinomial", "permutation_by_counts"}


def test_registry_and_oracle_keys():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    own = {n for n in q if n in QUERIES}
    assert own - set(o) == ROWS_ONLY


def test_entry_without_the_training_data_subpackage():
    """A copy of the repository without the llm folders still lists the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = os.path.join(tempfile.mkdtemp(prefix="ignis-entry-"), "repo")
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": copy})
    assert out.returncode == 0, out.stderr
    assert "joined_features" in out.stdout and "pipeline" not in out.stdout and "op1_" not in out.stdout


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "station_dist_km" in df.columns and "temp_mean_30d" in df.columns


def test_trend_p_value(spark):
    from __spark_entry__ import queries
    r = queries()["yearly_trend_pvalue"](spark, SF001).collect()
    assert len(r) == 2 and all(0.0 <= x.p_value <= 1.0 and x.significant == (x.p_value < 0.05) for x in r)
