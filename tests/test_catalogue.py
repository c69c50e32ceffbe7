"""Every query of the catalogue against its SQL, and the driver's contract."""

import os
import subprocess
import sys

import pytest
from oracle import compare

from eventloom.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLE:
        assert compare(spark, sf_dir, QUERIES[name], ORACLE[name]) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_works_without_the_llm_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("eventloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{part}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/eventloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_upsert' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_plans_push_filters_and_never_nest_loops(spark, sf_dir):
    for name in ("q_window_overlap", "q_fuzzy_pairs", "q_interval_join", "q_digest", "q_alias"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    scan = QUERIES["q_post_age"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scan.split("ReadSchema")[1]
