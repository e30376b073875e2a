"""Traffic routing (R01-R04), bandit choice (W16) and experiment metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import md5_mod, md5_unit_bucket, weighted_variant


def route_weighted(df: DataFrame, user: Column, variants: dict[str, float], out: str = "variant") -> DataFrame:
    """Stable weighted A/B assignment from md5(user)."""
    return df.withColumn(out, weighted_variant(md5_unit_bucket(user), variants))


def route_canary(df: DataFrame, user: Column, share: float, new: str, current: str,
                 out: str = "variant") -> DataFrame:
    """md5('canary:' + user) bucket < share -> new model."""
    b = md5_unit_bucket(F.concat(F.lit("canary:"), user))
    return df.withColumn(out, F.when(b < F.lit(share), F.lit(new)).otherwise(F.lit(current)))


def route_percent(df: DataFrame, user: Column, session: Column, request: Column, split_a_pct: float,
                  out: str = "variant") -> DataFrame:
    """(md5 mod 100)/100 < split -> 'A'; user id, else session id, else a
    hash of the request id stands in for the random draw."""
    key = F.coalesce(user, session, F.concat(F.lit("request:"), request))
    val = md5_mod(key, 100) / F.lit(100.0)
    return df.withColumn(out, F.when(val < F.lit(split_a_pct / 100.0), F.lit("A")).otherwise(F.lit("B")))


def route_random_canary(df: DataFrame, request: Column, pct: int, new: str, current: str,
                        out: str = "version") -> DataFrame:
    """A draw in 1..100 (hash of the request id) <= pct -> new version."""
    draw = md5_mod(request, 100) + 1
    return df.withColumn(out, F.when(draw <= F.lit(pct), F.lit(new)).otherwise(F.lit(current)))


def variant_metrics(df: DataFrame, variant: str = "variant") -> DataFrame:
    """A10: requests, fraud/error rate (divided by max(1, n)), mean latency and probability."""
    n = F.count(F.lit(1))
    return df.groupBy(variant).agg(
        n.alias("total_requests"),
        (F.sum("fraud_label") / F.greatest(n, F.lit(1))).alias("fraud_rate"),
        (F.count_if(F.col("status_code") >= 500) / F.greatest(n, F.lit(1))).alias("error_rate"),
        F.avg("processing_time_ms").alias("avg_latency_ms"),
        F.avg("fraud_probability").alias("avg_fraud_probability"),
    )


def bandit_stats(df: DataFrame, arm: str, reward: Column) -> DataFrame:
    """Per arm count, reward sum, mean reward (divided by max(1, n))."""
    n = F.count(F.lit(1))
    return df.groupBy(arm).agg(n.alias("count"), F.sum(reward).alias("reward_sum"),
                               (F.sum(reward) / F.greatest(n, F.lit(1))).alias("avg_reward"))


def greedy_arm(stats: DataFrame, arm: str) -> DataFrame:
    """W16 (exploit step): the arm with the highest mean reward; ties -> smallest name."""
    return stats.agg(F.min_by(F.col(arm), F.struct(-F.col("avg_reward"), F.col(arm))).alias("chosen_arm"))


def ab_outcome_summary(df: DataFrame, variant: str, outcome: Column, min_sample_size: int) -> DataFrame:
    """Per variant n, conversions, rate and whether n reached the minimum sample."""
    n = F.count(F.lit(1))
    return df.groupBy(variant).agg(
        n.alias("n"), F.count_if(outcome).alias("conversions"),
        (F.count_if(outcome) / n).alias("conversion_rate"),
        (n >= F.lit(min_sample_size)).alias("reached_min_sample"))
