"""Stateful streaming operators against brute-force replays of the same rows."""

from riskweave.streaming.jobs import ttl_for
from conftest import SF_SMALL


def _reuse_replay(events):
    """Plain replay in order of time; at equal times clearings, then drops, then requests by id."""
    rank = {"invalidate_all": 0, "invalidate": 1, "score": 2}
    expires, out = {}, {}
    for kind, key, pid, p, t in sorted(events, key=lambda e: (e[4], rank[e[0]], e[2] or "")):
        if kind == "invalidate_all":
            expires.clear()
        elif kind == "invalidate":
            expires.pop(key, None)
        elif t < expires.get(key, t):
            out[pid] = (True, None)
        else:
            ttl = ttl_for(p)
            expires[key] = t + ttl * 1_000_000
            out[pid] = (False, ttl)
    return out


EVENT = "kind string, cache_key string, prediction_id string, fraud_probability double, created_at timestamp_ntz"


def _reuse_events(seed, n, span, late):
    """Events in order of arrival: each comes up to ``late`` seconds after its time."""
    import random
    rng = random.Random(seed)
    events = []
    for i in range(n):
        kind = rng.choices(["score", "invalidate", "invalidate_all"], [60, 6, 1])[0]
        t = rng.randrange(span) * 1_000_000 if rng.random() < 0.9 else rng.randrange(20) * 300_000_000
        events.append((kind, rng.choice("aaaabcde") if kind != "invalidate_all" else None, f"p{i}" if kind == "score" else None,
                       rng.choice([0.05, 0.2, 0.3, 0.5, 0.7, 0.9]) if kind == "score" else None, t))
    return sorted(events, key=lambda e: e[4] + rng.randrange(late) * 1_000_000)


def _event_frame(spark, events):
    from datetime import datetime, timedelta
    return spark.createDataFrame([(*e[:4], datetime(2024, 1, 1) + timedelta(microseconds=e[4])) for e in events], EVENT)


def test_score_reuse_with_late_rows_drops_and_clearings_equals_a_replay(spark, tmp_path):
    from riskweave.streaming import jobs
    events = _reuse_events(0, 700, 40_000, 3000)
    step = jobs.score_reuse_sink(f"{tmp_path}/out", f"{tmp_path}/state", late_seconds=3600)
    for k in range(5):
        batch = _event_frame(spark, events[k * 140:(k + 1) * 140])
        step(batch, k)
        if k in (0, 3):
            step(batch, k)  # the batch runs again after a failure
    decided = spark.read.parquet(f"{tmp_path}/out").count()
    step(None, 5, spark)
    got = {r.prediction_id: (r.cache_hit, r.ttl_seconds) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = _reuse_replay(events)
    assert got == want and sum(h for h, _ in want.values()) > 100
    assert 0 < decided < len(want)  # most are decided as the newest event time passes them
    import os
    assert len([d for d in os.listdir(f"{tmp_path}/state/entries") if d.startswith("_batch")]) <= 3


def test_score_reuse_does_not_answer_from_the_future(spark, tmp_path):
    from riskweave.streaming import jobs
    step = jobs.score_reuse_sink(f"{tmp_path}/out", f"{tmp_path}/state", late_seconds=3600)
    step(_event_frame(spark, [("score", "k", "first", 0.5, 1000_000_000)]), 0)
    step(_event_frame(spark, [("score", "k", "late", 0.5, 100_000_000)]), 1)
    step(None, 2, spark)
    got = {r.prediction_id: r.cache_hit for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"late": False, "first": True}


def test_score_reuse_without_events(spark, tmp_path):
    from riskweave.streaming import jobs
    step = jobs.score_reuse_sink(f"{tmp_path}/out", f"{tmp_path}/state")
    step(None, 0, spark)
    step(_event_frame(spark, []), 1)
    step(_event_frame(spark, [("invalidate_all", None, None, None, 5)]), 2)
    step(None, 3, spark)
    assert spark.read.schema("prediction_id string").parquet(f"{tmp_path}/out").count() == 0


def test_ttl_tiers():
    assert ttl_for(0.05) == 300 and ttl_for(0.75) == 300
    assert ttl_for(0.5) == 1800
    assert ttl_for(0.3) == 3600 and ttl_for(0.7) == 3600 and ttl_for(0.2) == 3600


def test_rate_limit_resumes_from_checkpoint(spark):
    """Stop after part of the input, restart on the same checkpoint with more
    files: the combined output equals the batch twin over all rows."""
    import tempfile

    from pyspark.sql import functions as F

    from riskweave.operators.windows import micros, rate_limit
    from riskweave.sources.tables import transactions
    from riskweave.streaming import jobs
    from riskweave.streaming import runtime as rt

    tx = transactions(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="rw-restart-")
    src, sink, ck = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    t = micros("created_at")
    cut = tx.agg(F.percentile_approx(t, 0.6)).first()[0]
    first, rest = tx.where(t < cut), tx.where(t >= cut)

    def run():
        stream = rt.event_time(rt.read_stream(spark, src, tx.schema), "created_at")
        rt.run_available_now(stream.writeStream.foreachBatch(jobs.rate_limit_sink(sink, sink + "-state")), ck)

    rt.stage_files(first, src, "created_at", chunks=2)
    run()
    n_first = spark.read.parquet(sink).count()  # (a foreachBatch sink adds a batch_id column)
    rt.stage_files(rest, src, "created_at", chunks=1)
    run()  # resumes: only the new file is read, keyed state carries over
    got = _final_counts(spark, sink)
    want = {r.transaction_id: r.requests_last_minute for r in rate_limit(tx).collect()}
    assert 0 < n_first < len(want)
    assert got == want


def test_replayed_batch_writes_the_same_rows(spark, tmp_path):
    from riskweave.streaming import runtime as rt
    sink = rt.append_batches(f"{tmp_path}/sink")
    batch = spark.range(1000)
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.range(10), 1)
    rows = spark.read.parquet(f"{tmp_path}/sink")
    assert {r["batch_id"]: r["count"] for r in rows.groupBy("batch_id").count().collect()} == {0: 1000, 1: 10}


def _rate_rows(spark, rows):
    from datetime import datetime, timedelta
    return spark.createDataFrame([(u, i, datetime(2024, 1, 1) + timedelta(seconds=t)) for u, i, t in rows],
                                 "user_id long, transaction_id long, created_at timestamp_ntz")


def _final_counts(spark, path):
    from riskweave.streaming import runtime as rt
    return {r.transaction_id: r.requests_last_minute for r in rt.final_updates(spark, path, ["transaction_id"]).collect()}


def test_rate_limit_counts_late_rows_and_corrects_earlier_ones(spark, tmp_path):
    from riskweave.streaming import jobs
    step = jobs.rate_limit_sink(f"{tmp_path}/out", f"{tmp_path}/state")
    step(_rate_rows(spark, [(1, 0, 0), (1, 1, 10), (1, 2, 20), (1, 3, 600), (1, 5, 70)]), 0)
    step(_rate_rows(spark, [(1, 4, 25)]), 1)
    assert _final_counts(spark, f"{tmp_path}/out") == {0: 1, 1: 2, 2: 3, 3: 1, 4: 4, 5: 3}


def test_rate_limit_over_shuffled_batches_equals_the_batch_window(spark, tmp_path):
    import random

    from riskweave.operators.windows import rate_limit
    from riskweave.streaming import jobs
    rng = random.Random(4)
    rows = sorted(((rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(6000)) for i in range(800)), key=lambda r: r[2] + rng.randrange(1500))
    step = jobs.rate_limit_sink(f"{tmp_path}/out", f"{tmp_path}/state", late_seconds=1800)
    for k in range(5):
        batch = _rate_rows(spark, rows[k * 160:(k + 1) * 160])
        step(batch, k)
        if k == 2:
            step(batch, k)
    want = {r.transaction_id: r.requests_last_minute for r in rate_limit(_rate_rows(spark, rows)).collect()}
    assert _final_counts(spark, f"{tmp_path}/out") == want and max(want.values()) > 5


def test_old_rate_limit_state_is_removed(spark, tmp_path):
    import os

    from riskweave.streaming import jobs
    step = jobs.rate_limit_sink(f"{tmp_path}/out", f"{tmp_path}/state", late_seconds=3600)
    for k in range(4):
        step(_rate_rows(spark, [(k, k, k * 86_400)]), k)
    assert sorted(d for d in os.listdir(f"{tmp_path}/state/rows") if "=" in d) == ["_batch=2", "_batch=3"]
    assert len([d for d in os.listdir(f"{tmp_path}/state/progress") if "=" in d]) <= 3
    step(_rate_rows(spark, [(0, 9, 0)]), 4)  # far too late: dropped, as a watermark drops it
    assert 9 not in _final_counts(spark, f"{tmp_path}/out")


def test_unreadable_canary_state_is_an_error(spark, tmp_path):
    import os

    import pytest
    from pyspark.sql import functions as F
    from riskweave.streaming import jobs
    os.makedirs(f"{tmp_path}/state")
    with open(f"{tmp_path}/state/part-0.parquet", "w") as f:
        f.write("broken")
    step = jobs.canary_health_sink(f"{tmp_path}/state", F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(Exception):
        step(spark.range(1).selectExpr("'v2' AS variant", "200 AS status_code", "1.0D AS processing_time_ms",
                                       "timestamp_ntz'2024-01-01' AS created_at", "id AS transaction_id"), 0)


def test_live_drift_and_its_alerts_equal_the_batch(spark):
    """The stream's PSI rows, and the alert states over them, are those of the batch job on the same rows."""
    from pyspark.sql import functions as F
    from riskweave.operators.windows import persistent_alerts
    from riskweave.plans.registry import load_all
    reg = load_all()
    rules = spark.createDataFrame([(f, 1440, 1440, "warning") for f in ("amount", "hour", "device_score", "country_risk")],
                                  "rule string, step_minutes int, for_minutes int, severity string")
    told = []
    for name in ("D08", "D08L"):
        rows = reg[name].build(spark, SF_SMALL)
        series = rows.select(F.col("feature").alias("rule"), F.col("window_start").alias("at"), F.col("drift_detected").alias("breach"))
        told.append((sorted(map(tuple, rows.collect())), sorted(map(str, persistent_alerts(series, rules).collect()))))
    assert told[0] == told[1] and told[0][0] and any("resolved" in a or "firing" in a for a in told[0][1])
