"""Registered queries against their SQL. HOSTWATCH_CORE=1 runs a short list only."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


CORE = ("window_features", "label_windows", "assemble_flows", "flows_to_windows", "threshold_at_fpr", "evaluation_results",
        "bootstrap_auroc", "annotate_intervals", "threshold_transfer", "rank_fusion", "flagged_flows", "graph_top_nodes",
        "segment", "kstep_detail", "horizon_table", "host_state_asof", "decode_frames", "read_operator_log", "write_alerts",
        "evasion_table", "append_chain", "ledger_status", "explain_top_features", "window_features_stream")
NAMES = CORE if os.environ.get("HOSTWATCH_CORE") else sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"host", "window_id", "stage"} <= set(df.columns) and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    status, _, _, note = compare(spark, con, SF, name, entry.queries(), entry.oracle_sql())
    assert status == "ok", note


@pytest.mark.parametrize("name", ["window_features", "label_windows", "assemble_flows", "flows_to_windows", "threshold_at_fpr",
                                  "auroc", "bootstrap_f1", "rank_fusion", "flagged_flows", "host_state_asof", "segment"])
def test_plan_has_no_python_and_no_pairwise_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_top_k_prunes_before_the_shuffle(spark):
    plan = entry.queries()["flagged_flows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
