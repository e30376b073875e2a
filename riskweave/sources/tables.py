"""Driver tables and the two derived views every report runs on.

``transactions`` maps the ``events`` table to the fraud schema (amount, hour,
device_score, country_risk, is_fraud). ``prediction_logs`` adds a
deterministic rule score so log-shaped reports have an exact SQL twin.

Each Spark builder has a DuckDB CTE with identical column names and types;
``with_ctes`` assembles oracle SQL from them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Model families named in prediction logs, picked by transaction_id % 3.
MODEL_TYPES = ["logistic_regression", "random_forest", "xgboost"]
# Rule-score decision threshold used by the log view.
LOG_THRESHOLD = 0.15


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def transactions_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id"),
        F.col("event_type").alias("merchant_id"),
        F.col("value").alias("amount"),
        F.hour("ts").cast("int").alias("hour"),
        (k / F.lit(100)).alias("device_score"),
        (F.col("user_id") % 5 + 1).cast("int").alias("country_risk"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"),
        F.col("ts").alias("created_at"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(read_table(spark, sf_dir, "events"))


def risk_points(tx: DataFrame | None = None) -> Column:
    """Rule score in hundredths (integer) so Spark and SQL agree bit for bit."""
    pts = (
        F.lit(1)
        + F.when(F.col("amount") > 200, 5).otherwise(0)
        + F.when(F.col("country_risk") >= 4, 10).otherwise(0)
        + F.when(F.col("device_score") < 0.2, 15).otherwise(0)
        + F.when((F.col("hour") < 5) | (F.col("hour") > 23), 5).otherwise(0)
    )
    return F.least(F.lit(100), pts)


def prediction_logs_from_tx(tx: DataFrame) -> DataFrame:
    pts = risk_points()
    model_type = F.element_at(F.array(*[F.lit(m) for m in MODEL_TYPES]),
                              (F.col("transaction_id") % 3 + 1).cast("int"))
    return tx.select(
        F.concat(F.lit("pred-"), F.col("transaction_id").cast("string")).alias("prediction_id"),
        "transaction_id", "user_id", "merchant_id", "amount", "hour", "device_score",
        "country_risk", "is_fraud",
        model_type.alias("model_type"),
        F.when(F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz"), "v1")
        .otherwise("v2").alias("model_version"),
        (pts.cast("double") / F.lit(100)).alias("fraud_probability"),
        F.when(pts >= int(LOG_THRESHOLD * 100), 1).otherwise(0).alias("fraud_label"),
        F.lit(LOG_THRESHOLD).alias("threshold"),
        (F.col("amount") / F.lit(10)).alias("processing_time_ms"),
        F.when(F.col("device_score") < 0.02, 500).otherwise(200).alias("status_code"),
        F.when(F.col("transaction_id") % 4 == 0, "/v1/predict/batch")
        .otherwise("/v1/predict").alias("endpoint"),
        "created_at",
    )


def prediction_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_logs_from_tx(transactions(spark, sf_dir))


# ---------------------------------------------------------------- SQL twins

TX_CTE = """tx AS (
  SELECT event_id AS transaction_id, user_id, event_type AS merchant_id, value AS amount,
         CAST(hour(ts) AS INTEGER) AS hour,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS device_score,
         CAST(user_id % 5 + 1 AS INTEGER) AS country_risk,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
         ts AS created_at
  FROM events)"""

_PTS_SQL = """LEAST(100, 1 + CASE WHEN amount > 200 THEN 5 ELSE 0 END
                      + CASE WHEN country_risk >= 4 THEN 10 ELSE 0 END
                      + CASE WHEN device_score < 0.2 THEN 15 ELSE 0 END
                      + CASE WHEN hour < 5 OR hour > 23 THEN 5 ELSE 0 END)"""

LOGS_CTE = f"""logs AS (
  SELECT 'pred-' || CAST(transaction_id AS VARCHAR) AS prediction_id,
         transaction_id, user_id, merchant_id, amount, hour, device_score, country_risk, is_fraud,
         ['{MODEL_TYPES[0]}', '{MODEL_TYPES[1]}', '{MODEL_TYPES[2]}'][CAST(transaction_id % 3 + 1 AS INTEGER)] AS model_type,
         CASE WHEN created_at < TIMESTAMP '2024-01-16' THEN 'v1' ELSE 'v2' END AS model_version,
         CAST({_PTS_SQL} AS DOUBLE) / 100 AS fraud_probability,
         CASE WHEN {_PTS_SQL} >= {int(LOG_THRESHOLD * 100)} THEN 1 ELSE 0 END AS fraud_label,
         CAST({LOG_THRESHOLD} AS DOUBLE) AS threshold,
         amount / 10 AS processing_time_ms,
         CASE WHEN device_score < 0.02 THEN 500 ELSE 200 END AS status_code,
         CASE WHEN transaction_id % 4 = 0 THEN '/v1/predict/batch' ELSE '/v1/predict' END AS endpoint,
         created_at
  FROM tx)"""

CTES = {"tx": TX_CTE, "logs": LOGS_CTE}
_DEPENDS = {"logs": ["tx"]}


def with_ctes(body: str, *names: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the named CTEs (dependencies first) and extra CTE texts."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTES[n] for n in order] + list(extra or [])
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
