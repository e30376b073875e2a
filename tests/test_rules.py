"""Cases the driver's tables don't hold: missing columns, empty categories, gaps, severities, repeats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.operators import curves as cv
from riskweave.operators import drift as dr
from riskweave.operators import windows as wn
from riskweave.plans.window_plans import ALERT_RULES
from riskweave.sources import files as fl
from riskweave.sources import unique as un


def test_missing_column_is_drift(spark):
    ref = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    rows = {r["feature"]: r for r in dr.summary_drift(ref, ref.select("a"), ["a", "b"]).collect()}
    assert (rows["b"]["drift_detected"], rows["b"]["drift_score"], rows["b"]["reference_mean"]) == (True, 1.0, 0.0)
    assert rows["a"]["drift_score"] == 0.5
    rows = {r["feature"]: r["drift_score"] for r in dr.drift_report(ref, ref.select("a"), ["a", "b"]).collect()}
    assert rows["b"] == 1.0


def test_category_without_values_has_not_drifted(spark):
    frame = spark.createDataFrame([(None, 1.0)], "c string, x double")
    assert dr.psi_categorical(frame, frame, "c").first()["psi"] == 0.0
    (row,) = dr.drift_report(frame, frame, [], ["c"]).collect()
    assert (row["drift_score"], row["drift_detected"]) == (0.0, False)
    assert dr.drift_report(frame, frame, [], []).count() == 0


def test_alert_rows_hold_scores_and_history_is_cut(spark):
    report = spark.createDataFrame([("b", 0.15, True), ("a", 0.5, True), ("c", 0.01, False)],
                                   "feature string, drift_score double, drift_detected boolean")
    rows = dr.drift_alerts(report).collect()
    assert [(r["severity"], r["features"], r["scores"]) for r in rows] == [
        ("warning", "a,b", "a:0.500000000,b:0.150000000"), ("critical", "a", "a:0.500000000")]
    assert dr.drift_alerts(report.where("feature = 'c'")).count() == 0
    many = spark.range(250).selectExpr("id AS at", "'warning' AS severity")
    kept = [r["at"] for r in dr.alert_history(many, "at").collect()]
    assert len(kept) == 100 and min(kept) == 150


def test_daily_average_counts_calendar_days(spark):
    days = [("2024-01-01", 10), ("2024-03-01", 20), ("2024-03-03", 40), ("2024-06-01", 5)]
    rows = [(dt.datetime.fromisoformat(d),) for d, n in days for _ in range(n)]
    frame = spark.createDataFrame(rows, "ts timestamp").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    got = {str(r["day"]): (r["avg_7d"], r["spike"]) for r in wn.daily_spike(frame, "ts").collect()}
    assert got == {"2024-01-01": (10.0, False), "2024-03-01": (20.0, False), "2024-03-03": (30.0, True), "2024-06-01": (5.0, False)}


def test_alert_severities():
    assert {(m, op, limit): s for m, op, limit, s in ALERT_RULES} == {
        ("latency_p95_seconds", ">", 0.5): "warning", ("latency_p99_seconds", ">", 1.0): "critical",
        ("reuse_rate", "<", 0.5): "warning", ("accuracy", "<", 0.8): "critical",
        ("fraud_predictions", ">", 100.0): "warning", ("invocations_per_hour", ">", 10000.0): "info"}


def test_append_keeps_the_first_and_counts_rejects(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "id long, at long, v string")
    path = f"{tmp_path}/t"
    told = un.append_unique(spark, path, batch((1, 5, "late"), (1, 2, "first"), (2, 1, "x"), (None, 1, "no key")), "id", "at")
    assert told == {"appended": 2, "rejected": 1, "buckets_read": 0}
    told = un.append_unique(spark, path, batch((1, 0, "again"), (3, 1, "y")), "id", "at")
    assert (told["appended"], told["rejected"], told["buckets_read"]) == (1, 1, 1)
    assert {r["id"]: r["v"] for r in un.read_unique(spark, path, batch((1, 1, "")).schema).collect()} == {1: "first", 2: "x", 3: "y"}


def _opened(spark, tmp_path, job):
    """Input files that the job's plans name, by listening to nothing but the files' access: unreadable files would fail it."""
    import os
    hidden = [os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet") and "/data/" in d]
    for f in hidden:
        os.rename(f, f + ".away")
    try:
        return job()
    finally:
        for f in hidden:
            os.rename(f + ".away", f)


def test_unique_append_opens_no_old_data_file(spark, tmp_path):
    from riskweave.sources import unique as un
    path = f"{tmp_path}/t"
    frame = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(0).alias("at"), F.lit(v).alias("v"))
    assert un.append_unique(spark, path, frame(0, 5000, "a"), "id", "at")["appended"] == 5000
    told = _opened(spark, path, lambda: un.append_unique(spark, path, frame(5000, 5040, "b"), "id", "at"))
    assert told["appended"] == 40 and told["buckets_read"] <= 3  # new keys: at most the filters' false alarms
    told = _opened(spark, path, lambda: un.append_unique(spark, path, frame(4990, 5050, "c"), "id", "at"))
    assert (told["appended"], told["rejected"]) == (10, 50)
    kept = un.read_unique(spark, path, frame(0, 1, "").schema).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in kept} == {"a": 5000, "b": 40, "c": 10}


def test_failed_unique_append_leaves_nothing_and_runs_again(spark, tmp_path, monkeypatch):
    from riskweave.sources import unique as un
    path = f"{tmp_path}/t"
    frame = spark.range(20).select("id", F.lit(0).alias("at"))
    un.append_unique(spark, path, frame, "id", "at")
    more = spark.range(10, 40).select("id", F.lit(0).alias("at"))

    def broken(*a, **k):
        raise OSError("disk")
    with monkeypatch.context() as m:
        m.setattr(un, "key_filters", broken)
        with pytest.raises(OSError):
            un.append_unique(spark, path, more, "id", "at")
    assert un.read_unique(spark, path, frame.schema).count() == 20
    assert un.append_unique(spark, path, more, "id", "at")["appended"] == 20
    assert un.read_unique(spark, path, frame.schema).count() == 40


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    import os
    os.makedirs(f"{tmp_path}/x")
    want = []
    for i in range(3):
        lines = [f"{i * 1000 + j},v" for j in range(400 + i)] + (["a,b"] if i == 1 else [])  # a data line like the header
        want += lines
        with open(f"{tmp_path}/x/part-0000{i}.csv", "w") as f:
            f.write("a,b\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbered = fl.numbered_lines(spark, f"{tmp_path}/x")
            assert "Python" not in numbered._jdf.queryExecution().executedPlan().toString()
            got = numbered.orderBy("row_id").collect()
            assert [r["row_id"] for r in got] == list(range(len(want))) and [r["line"] for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_recall_at_an_unreachable_precision_is_null(spark):
    from riskweave.operators import models as ml
    rows = [(float(i) / 10, int(i % 3 == 0)) for i in range(10)]
    scored = spark.createDataFrame(rows, f"{ml.PROB} double, {ml.LABEL} int")
    row = ml.evaluate_test(scored, 0.95).first()
    assert row["recall_at_target"] is not None or row["threshold_at_target"] is None
    none = ml.evaluate_test(scored.withColumn(ml.LABEL, F.when(F.col(ml.PROB) < 0.25, 1).otherwise(0)), 0.95).first()
    assert none["recall_at_target"] is None and none["threshold_at_target"] is None
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from riskweave.session import ensure_checkpoint_dir
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
                           conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)


def test_held_alerts_pend_fire_and_resolve(spark):
    start = dt.datetime(2024, 1, 1)
    at = lambda k: start + dt.timedelta(minutes=5 * k)
    breaches = {"a": {1, 2, 3, 6, 8, 9, 10, 11}, "b": {0, 1}}
    missing = {("a", 10)}  # no evaluation at that step: the alert ends there
    rows = [(r, at(k), k in b) for r, b in breaches.items() for k in range(12) if (r, k) not in missing]
    series = spark.createDataFrame(rows, "rule string, at timestamp_ntz, breach boolean")
    rules = spark.createDataFrame([("a", 5, 7, "w"), ("b", 5, 0, "c"), ("c", 5, 0, "i")], "rule string, step_minutes int, for_minutes int, severity string")
    got = {(r.rule, r.started_at): (r.held_minutes, r.state, r.fired_at, r.resolved_at) for r in wn.persistent_alerts(series, rules).collect()}
    assert got == {("a", at(1)): (10, "resolved", at(3), at(4)), ("a", at(6)): (0, "pending", None, None), ("a", at(8)): (5, "pending", None, None),
                   ("a", at(11)): (0, "pending", None, None), ("b", at(0)): (5, "resolved", at(0), at(2))}
    held = wn.persistent_alerts(series.where("at >= '2024-01-01 00:40:00'").withColumn("breach", F.lit(True)), rules).where("rule = 'b'").first()
    assert (held.state, held.resolved_at) == ("firing", None)


def test_drift_alerts_by_day_and_their_history(spark):
    rows = [("d1", "a", 0.15, True), ("d1", "b", 0.05, False), ("d2", "a", 0.01, False), ("d2", "b", None, False),
            ("d3", "b", 0.5, True), ("d3", "a", 0.12, True), ("d4", "a", 0.4, False)]  # d4: no feature drifted, no alert
    report = spark.createDataFrame(rows, "day string, feature string, drift_score double, drift_detected boolean")
    alerts = dr.drift_alerts(report, by=["day"])
    got = [tuple(r) for r in dr.alert_history(alerts, "day").select("day", "severity", "features", "scores").collect()]
    assert got == [("d3", "critical", "b", "b:0.500000000"), ("d3", "warning", "a,b", "a:0.120000000,b:0.500000000"),
                   ("d1", "warning", "a", "a:0.150000000")]
    assert len(dr.alert_history(alerts, "day", keep=2).collect()) == 2
