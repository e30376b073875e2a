"""Stored tables: bucketed joins, the compacted feature store, archives that fail on the way, saved models."""

import random
import re
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskweave.operators import featurestore as fs
from riskweave.operators import lookups
from riskweave.operators import retention as rt


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    tag = uuid.uuid4().hex[:8]
    rows = spark.range(2000).select(F.col("id").alias("transaction_id"), (F.col("id") % 7).alias("a"))
    a = lookups.write_bucketed(rows.union(rows.limit(5)), f"t_a_{tag}", f"{tmp_path}/a", "transaction_id", 4)
    b = lookups.write_bucketed(rows.where("a < 3").withColumnRenamed("a", "b"), f"t_b_{tag}", f"{tmp_path}/b", "transaction_id", 4)
    joined = lookups.predictions_with_transactions(a, b)
    assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert joined.count() == rows.where("a < 3").count() + rows.limit(5).where("a < 3").count()


def _store(spark, seed):
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for i in range(600):
        at = start + timedelta(minutes=rng.randrange(6000))
        gone = rng.random() < 0.15
        rows.append((rng.choice("abcdefg"), rng.choice(["x", "y"]), rng.choice(["v1", "v2"]), None if gone else str(i), at,
                     at if gone else at + timedelta(minutes=rng.choice([10, 300, 3000])), gone))
    return spark.createDataFrame(rows, "entity_id string, feature_name string, version string, value_json string,"
                                       " written_at timestamp_ntz, expires_at timestamp_ntz, deleted boolean")


def test_compacted_store_answers_as_the_whole_log(spark, tmp_path):
    store = _store(spark, 1).persist()
    at = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    snapshot = fs.write_snapshot(store, at, f"t_snap_{uuid.uuid4().hex[:8]}", f"{tmp_path}/snap", 4)
    assert 0 < snapshot.count() < 30
    tail = store.where(F.col("written_at") > at)
    sizes = set()
    for t in ("2024-01-03 00:00:00", "2024-01-03 09:30:00", "2024-01-04 02:00:00", "2024-01-05 04:00:00", "2024-01-09 00:00:00"):
        when = F.lit(t).cast("timestamp_ntz")
        for version in ("v1", "v2"):
            got = fs.get_live_compacted(snapshot, tail, when, version)
            want = fs.get_live(store, when).where(F.col("version") == version)
            rows = lambda d: sorted(map(tuple, d.select("entity_id", "feature_name", "version", "value_json").collect()))
            assert rows(got) == rows(want)
            sizes.add(len(rows(want)))
    assert len(sizes) > 2
    store.unpersist()


def test_compacted_reads_do_not_shuffle_the_snapshot(spark, tmp_path):
    _store(spark, 2).write.parquet(f"{tmp_path}/log")
    store = spark.read.parquet(f"{tmp_path}/log")
    at = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    snapshot = fs.write_snapshot(store, at, f"t_snap_{uuid.uuid4().hex[:8]}", f"{tmp_path}/snap", 4)
    tail = store.where(F.col("written_at") > at)
    plan = plan_of(fs.get_live_compacted(snapshot, tail, at, "v1"))
    snap_side = plan[plan.index("SortMergeJoin"):]
    first_branch = snap_side[:snap_side.index("/snap")]
    assert "Exchange" not in first_branch and len(re.findall("FileScan parquet", plan)) == 2
    assert "PartitionFilters: [isnotnull(version" in plan  # one version's folder only


def _log(spark):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, f"v{i}", start + timedelta(hours=5 * i)) for i in range(60)], "id long, v string, at timestamp_ntz")


CUT = "2024-01-06 12:00:00"


@pytest.mark.parametrize("broken", ["write_archive", "content_sum", "_mark", "drop_partitions_before", "second _mark", None])
def test_archive_that_fails_on_the_way_ends_the_same(spark, tmp_path, monkeypatch, broken):
    log, table, archive = _log(spark), f"{tmp_path}/table", f"{tmp_path}/archive"
    rt.write_by_day(log, table, "at")
    old = log.where(F.col("at") < F.lit(CUT).cast("timestamp_ntz")).count()

    def run(**options):
        return tuple(rt.archive_in_place(spark, table, log.schema, "at", CUT, archive, "r", **options).first())
    assert run(dry_run=True) == (old, None, False)
    assert rt.read_by_day(spark, table, log.schema).count() == 60  # a dry run moves nothing
    if broken:
        name, calls = broken.split()[-1], []
        real = getattr(rt, name)

        def fails(*a, **k):
            calls.append(1)
            if "second" in broken and len(calls) == 1:
                return real(*a, **k)
            raise OSError("disk")
        with monkeypatch.context() as m:
            m.setattr(rt, name, fails)
            with pytest.raises(OSError):
                run()
        left = rt.read_by_day(spark, table, log.schema).select("id").union(
            spark.read.schema("id long").json(f"{archive}/run=r").select("id") if broken != "write_archive" else spark.range(0).toDF("id"))
        assert {r["id"] for r in left.collect()} == set(range(60))  # nothing is lost at any step
    assert run() == (old, 60 - old, True) == run()
    assert {r["id"] for r in rt.read_by_day(spark, table, log.schema).collect()} == set(range(old, 60))
    back = rt.read_archive(spark, f"{archive}/run=r", log.schema)
    assert sorted((r["id"], r["v"], r["at"]) for r in back.collect()) == sorted((r["id"], r["v"], r["at"]) for r in log.limit(old).collect())


def test_archive_that_does_not_match_touches_nothing(spark, tmp_path, monkeypatch):
    log = _log(spark)
    rt.write_by_day(log, f"{tmp_path}/t", "at")
    monkeypatch.setattr(rt, "write_archive", lambda df, path, ts: df.limit(3).withColumn("day", F.lit("2024-01-01")).write.mode(
        "overwrite").partitionBy("day").option("compression", "gzip").json(path))
    told = rt.archive_in_place(spark, f"{tmp_path}/t", log.schema, "at", CUT, f"{tmp_path}/a", "r").first()
    assert told["verified"] is False and rt.read_by_day(spark, f"{tmp_path}/t", log.schema).count() == 60


def test_saved_models_are_found_by_the_registry(spark, tmp_path):
    from riskweave.operators.registry import newest_model, save_model_run
    data = f"set-{uuid.uuid4().hex}"
    assert newest_model(spark, data, "random_forest") is None
    for name in ("one", "two"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}")
        save_model_run(spark, data, "random_forest", f"{tmp_path}/{name}")
    save_model_run(spark, data, "random_forest", f"{tmp_path}/one", "Production")
    # a new session of the same cluster sees the same table
    other = spark.newSession()
    assert newest_model(other, data, "random_forest") == f"{tmp_path}/two"
    assert newest_model(other, data, "random_forest", "Production") == f"{tmp_path}/one"
    assert newest_model(other, data, "xgboost") is None


def test_stream_scores_as_the_batch_and_keeps_invalid_rows_apart(spark, tmp_path):
    from riskweave.functions import features as fe
    from riskweave.operators import models as ml
    from riskweave.plans import model_plans as mp
    from riskweave.streaming import jobs
    from riskweave.streaming import runtime as st
    stats, train, _, test = mp.fitted_frames(spark, SF_SMALL)
    model = ml.fit(train, "logistic_regression")
    raw = mp.split_tx(spark, SF_SMALL).where(F.col("split") == "test").drop("split")
    bad = raw.limit(4).withColumn("transaction_id", -F.col("transaction_id") - 1).withColumn("amount", F.lit(-5.0))
    st.stage_files(raw.unionByName(bad), f"{tmp_path}/src", "created_at")
    step = jobs.model_scoring_sink(model, stats, 0.4, f"{tmp_path}/out", f"{tmp_path}/bad")
    st.run_available_now(st.read_stream(spark, f"{tmp_path}/src", raw.schema).writeStream.foreachBatch(step), f"{tmp_path}/ck")
    cols = ["transaction_id", "fraud_probability", "fraud_label", "threshold_used"]
    want = ml.score(model, test, 0.4).select(cols)
    got = spark.read.parquet(f"{tmp_path}/out").select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    kept = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert len(kept) == 4 and all(r["reject_reasons"] and r["transaction_id"] < 0 for r in kept)
    assert fe.FEATURE_COLUMNS
