"""Model run registry as append-only tables.

``runs(name, version, metrics...)`` and ``stage_events(name, version, stage,
at)``; the current stage of a version is its latest event, and promotions
are new event rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import scratch_path
from riskweave.streaming.state import path_exists

SAVED = "dataset string, model_type string, stage string, model_path string, saved_at double"


def promote_newest(runs: DataFrame, stage: str, at: str) -> DataFrame:
    """Stage the newest version of every model name."""
    newest = runs.groupBy("name").agg(F.max("version").alias("version"))
    return newest.select("name", "version", F.lit(stage).alias("stage"),
                         F.lit(at).cast("timestamp_ntz").alias("event_at"))


def promote_best(runs: DataFrame, metric: str, stage: str, at: str) -> DataFrame:
    """Promote the single best run by ``metric`` (ties -> smallest name, version)."""
    key = F.struct(-F.col(metric), F.col("name"), F.col("version"))
    best = runs.where(F.col(metric).isNotNull()).agg(F.min_by(F.struct("name", "version"), key).alias("b"))
    return best.select("b.name", "b.version", F.lit(stage).alias("stage"), F.lit(at).cast("timestamp_ntz").alias("event_at"))


def current_stages(runs: DataFrame, events: DataFrame) -> DataFrame:
    last = events.groupBy("name", "version").agg(F.max_by("stage", "event_at").alias("current_stage"))
    return runs.join(last, ["name", "version"], "left").withColumn(
        "current_stage", F.coalesce("current_stage", F.lit("None")))


def best_in_stage(runs: DataFrame, events: DataFrame, stage: str, metric: str) -> DataFrame:
    """Best run by ``metric`` among versions currently in ``stage`` (e.g. Production)."""
    cur = current_stages(runs, events).where(F.col("current_stage") == stage)
    return cur.agg(F.max_by(F.struct("name", "version"), F.col(metric)).alias("best"))


def save_model_run(spark: SparkSession, dataset: str, model_type: str, model_path: str, stage: str = "Staging") -> None:
    """One more row of the saved models' table; any later session finds the model there."""
    spark.createDataFrame([(dataset, model_type, stage, model_path, time.time())], SAVED).coalesce(1).write.mode("append").parquet(
        scratch_path(spark, "model-runs"))


def newest_model(spark: SparkSession, dataset: str, model_type: str, stage: str = "Staging") -> str | None:
    """Path of the newest saved model of a dataset and family in a stage, if its folder is still there."""
    table = scratch_path(spark, "model-runs")
    if not path_exists(spark, table):
        return None
    rows = spark.read.schema(SAVED).parquet(table).where(
        (F.col("dataset") == dataset) & (F.col("model_type") == model_type) & (F.col("stage") == stage))
    path = rows.agg(F.max_by("model_path", "saved_at")).first()[0]
    return path if path is not None and path_exists(spark, path) else None
