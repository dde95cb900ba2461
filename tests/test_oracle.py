"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as entry
from dq_helpers import SF_SMALL
from oracle_compare import compare, duck_connect
from sparkdq.plans import registry

registry.load_all()
#: No SQL form: held against brute force in tests of their own.
WITHOUT_SQL = {"q_diff_hunks", "d_phrase_hits"}
NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in WITHOUT_SQL])
def test_query_matches_oracle(spark, con, name):
    q = entry.queries()
    o = entry.oracle_sql()
    assert name in o
    ok, msg = compare(spark, con, name, q[name], o[name], SF_SMALL)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"column", "metric", "value"}


PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsIn", "FlatMapCoGroupsIn", "MapInPandas", "MapInArrow")
#: Vector blocks are scored with numpy; diffs and automata run in Arrow batches.
WITH_NUMPY = {"r_top_k", "r_combined_text"} | WITHOUT_SQL


@pytest.mark.parametrize("name", [n for n in NAMES if n not in WITH_NUMPY])
def test_query_plan_is_native(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PY_NODES), plan
    assert "RoundRobinPartitioning" not in plan and "REPARTITION_BY_NUM" not in plan, plan  # no input is spread


def test_label_exemplars_use_group_limit(spark):
    from sparkdq.plans.signal_queries import label_exemplars

    plan = label_exemplars(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_grounding_uses_keyed_broadcast_join(spark):
    from sparkdq.plans.grounding_queries import bench_verdicts

    plan = bench_verdicts(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Contains" in plan and "NestedLoopJoin" not in plan and "Cartesian" not in plan
