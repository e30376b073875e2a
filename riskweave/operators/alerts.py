"""Metric series and the alert table.

Series are long rows (metric, day, value); rules are a small table of
(metric, op, threshold, severity) joined by metric, so new rules are rows,
not code. The rules table is a fixed handful of rows: broadcast is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranking import exact_quantiles


REUSE_KEY = ["user_id", "amount", "hour", "device_score", "country_risk"]  # what makes two requests the same


def daily_metric_series(logs: DataFrame, ts: str = "created_at") -> DataFrame:
    """Per day: latency quantiles, accuracy, positives, share of repeated requests, busiest hour's requests."""
    day = F.to_date(F.col(ts)).alias("day")
    base = logs.select(day, F.hour(ts).alias("_hour"), F.struct(*REUSE_KEY).alias("_key"), (F.col("processing_time_ms") / 1000).alias("latency_s"), "fraud_label", "is_fraud")
    q = exact_quantiles(base, "latency_s", [0.95, 0.99], by=["day"]).select(
        F.when(F.col("prob") == 0.95, F.lit("latency_p95_seconds")).otherwise(F.lit("latency_p99_seconds"))
        .alias("metric"), "day", F.col("quantile").alias("value"))
    agg = base.groupBy("day").agg(
        F.avg(F.when(F.col("fraud_label") == F.col("is_fraud"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.sum("fraud_label").cast("double").alias("fraud_predictions"),
        ((F.count(F.lit(1)) - F.count_distinct("_key")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("reuse_rate"))
    hourly = base.groupBy("day", "_hour").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(
        F.max("n").cast("double").alias("value")).select(F.lit("invocations_per_hour").alias("metric"), "day", "value")
    long = agg.unpivot(["day"], ["accuracy", "fraud_predictions", "reuse_rate"], "metric", "value")
    return q.unionByName(long.select("metric", "day", "value")).unionByName(hourly)


def threshold_alerts(series: DataFrame, rules: DataFrame) -> DataFrame:
    j = series.join(F.broadcast(rules), "metric")
    fire = ((F.col("op") == ">") & (F.col("value") > F.col("threshold"))) | \
           ((F.col("op") == "<") & (F.col("value") < F.col("threshold")))
    return j.where(fire).select(F.col("metric").alias("rule"), "day", "value", "severity")
