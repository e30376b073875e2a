"""Physical-plan properties: pushdown, pruning, partial aggregation, bounded broadcasts."""

import pytest

from riskweave.plans.registry import load_all
from conftest import SF_SMALL

REG = load_all()


def _plan(spark, qid):
    df = REG[qid].build(spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_parquet_reader(spark):
    plan = _plan(spark, "S08")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_report_scan_is_pruned_and_partially_aggregated(spark):
    plan = _plan(spark, "A01")
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l][0]
    assert "event_type" not in scan  # not needed by the hourly report
    assert "partial_count" in plan and "partial_avg" in plan


def test_per_user_lookup_has_no_forced_broadcast(spark):
    # per-user history grows with users: no hint on it (AQE decides at runtime);
    # the only hinted side is the one-row frame mean
    df = REG["F19"].build(spark, SF_SMALL)
    logical = df._jdf.queryExecution().analyzed().toString()
    assert logical.count("ResolvedHint") == 1
    hinted = logical.split("ResolvedHint")[1]
    assert "_frame_mean" in hinted.split("\n")[1] or "avg(amount" in hinted


@pytest.mark.parametrize("qid", ["W01", "W03"])
def test_trailing_windows_partition_by_user_and_chunk(spark, qid):
    plan = _plan(spark, qid)
    assert "_chunk" in plan and "hashpartitioning(user_id" in plan
