"""Work that is done once, and by all cores, where large tables are trained on, evaluated and replayed."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import curves as cv
from riskweave.operators import models as ml
from riskweave.plans import model_plans as mp
from riskweave.streaming import jobs
from riskweave.streaming import runtime as rt


def _events(spark, path):
    """600 events over two days, a fifth of them errors."""
    rows = spark.range(600).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 288)").alias("ts"),
        (F.col("id") % 37).alias("user_id"), F.when(F.col("id") * 7919 % 5 == 0, "error").otherwise("view").alias("event_type"),
        (F.col("id") * 31 % 101 + 0.25).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props"))
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_all_families_are_trained_on_one_split(spark, monkeypatch):
    made, used = [], []
    monkeypatch.setattr(mp, "fitted_frames", lambda *a: made.append(object()) or (made[-1],))

    def job(session, sf_dir, kind, fitted=None):
        used.append(fitted)
        if kind == "random_forest":
            raise ValueError("no trees today")
        return session.createDataFrame([(kind, 0.7, 0.2)], "model_type string, roc_auc double, average_precision double")
    monkeypatch.setattr(mp, "train_job", job)
    rows = {r["model_type"]: r for r in mp.q_l05(spark, "anywhere").collect()}
    assert len(made) == 1 and len(used) == 3 and all(u == (made[0],) for u in used)
    assert rows["random_forest"]["error"] == "no trees today" and rows["xgboost"]["error"] is None


def test_scoring_jobs_train_on_the_split_that_they_score(spark, tmp_path, monkeypatch):
    sf_dir, plain, splits = _events(spark, tmp_path), mp.split_tx, []
    monkeypatch.setattr(mp, "split_tx", lambda *a: splits.append(a) or plain(*a))
    curve = mp.q_l07p(spark, sf_dir).collect()  # no saved model yet: trains one
    assert len(splits) == 1 and curve
    monkeypatch.setattr(mp, "newest_model", lambda *a: None)
    assert mp.q_t01m(spark, sf_dir).count() == 120 and len(splits) == 2


def test_metrics_come_from_one_score_table(spark, monkeypatch):
    scored = spark.range(500).select((F.col("id") * 37 % 100 / 100).alias(ml.PROB), (F.col("id") % 4 == 0).cast("int").alias(ml.LABEL))
    plain, tables = cv.score_table, []
    want = (cv.roc_auc(scored, ml.PROB, ml.LABEL).first()[0], cv.average_precision(scored, ml.PROB, ml.LABEL).first()[0],
            *cv.tune_threshold(scored, ml.PROB, ml.LABEL).first())
    monkeypatch.setattr(cv, "score_table", lambda *a, **k: tables.append(a) or plain(*a, **k))
    got = tuple(ml.evaluate(scored).first())
    assert len(tables) == 1
    assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_forest_keeps_the_node_of_each_row_and_grows_the_same_trees(spark):
    rows = spark.range(3000).select(
        *[(F.col("id") * k % 1009 / 1009).alias(c) for k, c in ((7919, "a"), (104729, "b"), (31, "c"))], F.col("id")).select(
        array_to_vector(F.array("a", "b", "c")).alias("features"), F.lit(1.0).alias(ml.WEIGHT),
        (F.col("a") + F.col("b") * F.col("c") + (F.col("id") % 3) / 9 > 1).cast("int").alias(ml.LABEL)).persist()
    forest = ml.estimator("random_forest")
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() == -1
    few = {forest.numTrees: 8}
    trees = [f.fit(rows, few).toDebugString.split("\n", 1)[1] for f in (forest, forest.copy({forest.cacheNodeIds: False}))]
    assert trees[0] == trees[1] and "Predict: 1.0" in trees[0] and "Predict: 0.0" in trees[0]
    rows.unpersist()


def test_a_chunk_of_time_is_written_as_several_files_in_order(spark, tmp_path):
    df = spark.range(1000).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("at"))
    rt.stage_files(df, f"{tmp_path}/src", "at", chunks=2, files=3)
    made = sorted(tmp_path.glob("src/part-*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(made) == 6
    spans = [spark.read.parquet(str(p)).agg(F.min("id"), F.max("id")).first() for p in made]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_clearings_are_counted_by_time_and_carried_entries_keep_their_epoch():
    names = [c.split()[0] for c in jobs.REUSE_EVENT.split(", ")]
    batch = pa.RecordBatch.from_arrays([
        pa.array(["k"] * 4), pa.array([50, 9, 10, 25]), pa.array([jobs._STORED, jobs._ASK, jobs._ASK, jobs._DROP], pa.int32()),
        pa.array([None] * 4, pa.string()), pa.array([None] * 4, pa.float64()), pa.array([2, None, None, None], pa.int64()),
        pa.array([60, None, None, None], pa.int64())], names)
    out, = jobs._with_epochs(iter([batch]), np.array([10, 20, 30]), 4)
    assert out.column("epoch").to_pylist() == [2, 4, 5, 6] and out.schema.names == names
