"""Dimension lookups with defaults (J01, F18-F20) and per-user history.

No broadcast hint is forced on per-entity tables: their size grows with the
number of users. Catalyst/AQE broadcast them only when the runtime size is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise the join shuffles
on the key, with AQE skew splitting for hot users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the history lookup.
DEFAULT_AVG_AMOUNT = 100.0
DEFAULT_FRAUD_RATE = 0.01


def lookup_with_default(df: DataFrame, dim: DataFrame, key: str,
                        columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Left join ``dim`` on ``key``; each dim column -> (output name, default)."""
    sel = [F.col(key)] + [F.col(src).alias(f"_lk_{src}") for src in columns]
    joined = df.join(dim.select(*sel), on=key, how="left")
    out = {dst: F.coalesce(F.col(f"_lk_{src}"), F.lit(default)) for src, (dst, default) in columns.items()}
    return joined.withColumns(out).drop(*[f"_lk_{src}" for src in columns])


def last_hour_counts(tx: DataFrame, ts: str = "created_at", key: str = "user_id") -> DataFrame:
    """Per-key count of rows in the final hour of the data, (max - 1h, max]."""
    latest = tx.agg(F.max(ts).alias("_max_ts"))
    recent = tx.crossJoin(F.broadcast(latest)).where(
        F.col(ts) > F.col("_max_ts") - F.expr("INTERVAL 1 HOUR"))
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def user_history(hist: DataFrame, key: str = "user_id") -> DataFrame:
    """Per-user average amount and fraud rate (partial aggregation map-side)."""
    return hist.groupBy(key).agg(F.avg("amount").alias("avg_amount"),
                                 F.avg("is_fraud").alias("fraud_rate"),
                                 F.lit(True).alias("_known"))


def user_history_features(cur: DataFrame, hist: DataFrame, key: str = "user_id") -> DataFrame:
    """avg amount (unknown user -> mean of ``cur``; entry without
    avg -> 100), amount_vs_avg, fraud rate (-> 0.01)."""
    frame_mean = cur.agg(F.avg("amount").alias("_frame_mean"))
    joined = cur.join(hist.select(key, "avg_amount", "fraud_rate", "_known"), on=key, how="left") \
        .crossJoin(F.broadcast(frame_mean))
    avg_amount = F.when(F.col("_known").isNull(), F.col("_frame_mean")) \
        .otherwise(F.coalesce(F.col("avg_amount"), F.lit(DEFAULT_AVG_AMOUNT)))
    out = joined.withColumn("user_avg_amount", avg_amount)
    out = out.withColumns({
        "amount_vs_avg": F.col("amount") / (F.col("user_avg_amount") + 1),
        "user_fraud_rate": F.coalesce(F.col("fraud_rate"), F.lit(DEFAULT_FRAUD_RATE)),
    })
    return out.drop("avg_amount", "fraud_rate", "_known", "_frame_mean")


def new_keys(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key is not in ``existing`` (left anti join), one row per key."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def predictions_with_transactions(logs: DataFrame, tx: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Both sides grow with traffic, so this is a sort-merge join on the key;
    tables written by ``write_bucketed`` join without a shuffle on either side."""
    return logs.hint("merge").join(tx, key, "inner")


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``key`` (files below ``path``), read back.

    Each bucket is written by one task; tables of one bucket count are joined bucket by bucket.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)
