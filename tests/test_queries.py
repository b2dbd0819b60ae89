"""Every query against its DuckDB statement; those without one against what must hold."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from cuelattice.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(name, spark, duck, data, same):
    same(QUERIES[name](spark, data), duck, ORACLES[name])


def test_names_have_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"q16_svd_embedding", "q19_dimension_sweep", "q20_ridge_cv_scores"}


def test_svd_query_has_all_components(spark, data):
    rows = QUERIES["q16_svd_embedding"](spark, data).toPandas()
    assert rows.groupby("cue").size().eq(16).all()
    assert np.isfinite(rows["value"]).all()


def test_regressions_give_a_row_a_norm(spark, data):
    rows = QUERIES["q20_ridge_cv_scores"](spark, data).collect()
    assert {r["norm"] for r in rows} == {"A", "N", "R"} and all(r["dimensions"] == 64 and r["r2_mean"] <= 1 for r in rows)
    sweep = QUERIES["q19_dimension_sweep"](spark, data).collect()
    assert {r["dim"] for r in sweep} == {16, 32, 64}


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_engine_stands_alone(tmp_path):
    """Without the training-data folders and their pipeline everything else is there."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "cuelattice", tmp_path / "cuelattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from cuelattice import queries as q; import cuelattice.__main__; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr
