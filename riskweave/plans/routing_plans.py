"""Registered queries: routing (R01-R04), experiment metrics (A10-A12), bandit."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.hashing import (md5_mod, md5_mod_sql, md5_unit_bucket, md5_unit_bucket_sql,
                                         weighted_variant_sql)
from riskweave.operators import routing as ro
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.sources.tables import MODEL_TYPES, prediction_logs, transactions, with_ctes

# Experiment configuration used by the registered queries.
VARIANTS = {"model_a": 0.5, "model_b": 0.3, "model_c": 0.2}
CANARY_SHARE = 0.1
SPLIT_A_PCT = 50.0
CANARY_PCT = 10
MIN_SAMPLE = 1000
EPSILON = 0.1

_USER = "'user' || CAST(user_id AS VARCHAR)"


def _user():
    return F.concat(F.lit("user"), F.col("user_id").cast("string"))


@register("R01", with_ctes(f"""SELECT transaction_id, round({md5_unit_bucket_sql(_USER)}, 9) AS bucket,
    {weighted_variant_sql(md5_unit_bucket_sql(_USER), VARIANTS)} AS variant FROM tx""", "tx"))
def q_r01(spark, sf_dir):
    """Weighted md5 A/B routing of every transaction's user."""
    tx = transactions(spark, sf_dir)
    out = ro.route_weighted(tx, _user(), VARIANTS)
    return out.select("transaction_id", r9(md5_unit_bucket(_user()), "bucket"), "variant")


_CANARY_USER = "'canary:user' || CAST(user_id AS VARCHAR)"


@register("R02", with_ctes(f"""SELECT transaction_id, CASE WHEN {md5_unit_bucket_sql(_CANARY_USER)} < {CANARY_SHARE}
    THEN 'v2' ELSE 'v1' END AS variant FROM tx""", "tx"))
def q_r02(spark, sf_dir):
    """Canary routing: 10% of users (by md5 of 'canary:'+user) to the new model."""
    out = ro.route_canary(transactions(spark, sf_dir), _user(), CANARY_SHARE, "v2", "v1")
    return out.select("transaction_id", "variant")


_R03_KEY = "COALESCE('user' || CAST(user_id AS VARCHAR), 'request:' || CAST(transaction_id AS VARCHAR))"


@register("R03", with_ctes(f"""SELECT transaction_id, CAST({md5_mod_sql(_R03_KEY)} AS BIGINT) AS hash_mod,
    CASE WHEN {md5_mod_sql(_R03_KEY)} / 100.0 < {SPLIT_A_PCT / 100.0} THEN 'A' ELSE 'B' END AS variant
    FROM tx""", "tx"))
def q_r03(spark, sf_dir):
    """Percent routing on the full 128-bit md5 modulo 100."""
    tx = transactions(spark, sf_dir)
    out = ro.route_percent(tx, _user(), F.lit(None).cast("string"), F.col("transaction_id").cast("string"),
                           SPLIT_A_PCT)
    key = F.coalesce(_user(), F.concat(F.lit("request:"), F.col("transaction_id").cast("string")))
    return out.select("transaction_id", md5_mod(key, 100).alias("hash_mod"), "variant")


@register("R04", with_ctes(f"""SELECT prediction_id, CASE WHEN {md5_mod_sql('prediction_id')} + 1 <= {CANARY_PCT}
    THEN 'v2' ELSE 'v1' END AS version FROM logs""", "logs"))
def q_r04(spark, sf_dir):
    """Random-share canary: draw 1..100 from the request id hash."""
    out = ro.route_random_canary(prediction_logs(spark, sf_dir), F.col("prediction_id"), CANARY_PCT, "v2", "v1")
    return out.select("prediction_id", "version")


@register("A10", with_ctes(f"""SELECT variant, count(*) AS total_requests,
    round(sum(fraud_label) / greatest(count(*), 1), 9) AS fraud_rate,
    round(count(*) FILTER (WHERE status_code >= 500) / greatest(count(*), 1), 9) AS error_rate,
    round(avg(processing_time_ms), 9) AS avg_latency_ms,
    round(avg(fraud_probability), 9) AS avg_fraud_probability
    FROM (SELECT *, {weighted_variant_sql(md5_unit_bucket_sql(_USER), VARIANTS)} AS variant FROM logs)
    GROUP BY variant""", "logs"))
def q_a10(spark, sf_dir):
    """Per-variant request metrics of the weighted A/B test."""
    logs = ro.route_weighted(prediction_logs(spark, sf_dir), _user(), VARIANTS)
    m = ro.variant_metrics(logs)
    return m.select("variant", "total_requests", r9("fraud_rate"), r9("error_rate"),
                    r9("avg_latency_ms"), r9("avg_fraud_probability"))


_REWARD_SQL = "CASE WHEN fraud_label = is_fraud THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _reward():
    return F.when(F.col("fraud_label") == F.col("is_fraud"), F.lit(1.0)).otherwise(F.lit(0.0))


_STATS_SQL = f"""stats AS (SELECT model_type, count(*) AS count, sum({_REWARD_SQL}) AS reward_sum,
    sum({_REWARD_SQL}) / greatest(count(*), 1) AS avg_reward FROM logs GROUP BY model_type)"""


@register("A11", with_ctes("""SELECT model_type, count, round(reward_sum, 9) AS reward_sum,
    round(avg_reward, 9) AS avg_reward FROM stats""", "logs", extra=[_STATS_SQL]))
def q_a11(spark, sf_dir):
    """Bandit statistics per arm (reward = correct label)."""
    st = ro.bandit_stats(prediction_logs(spark, sf_dir), "model_type", _reward())
    return st.select("model_type", "count", r9("reward_sum"), r9("avg_reward"))


_R03_LOG_KEY = "'user' || CAST(user_id AS VARCHAR)"


@register("A12", with_ctes(f"""SELECT variant, count(*) AS n, count(*) FILTER (WHERE is_fraud = 1) AS conversions,
    round(count(*) FILTER (WHERE is_fraud = 1) / count(*), 9) AS conversion_rate,
    count(*) >= {MIN_SAMPLE} AS reached_min_sample
    FROM (SELECT *, CASE WHEN {md5_mod_sql(_R03_LOG_KEY)} / 100.0 < {SPLIT_A_PCT / 100.0}
                    THEN 'A' ELSE 'B' END AS variant FROM logs) GROUP BY variant""", "logs"))
def q_a12(spark, sf_dir):
    """A/B outcome summary: confirmed-fraud conversions per variant."""
    logs = prediction_logs(spark, sf_dir)
    routed = ro.route_percent(logs, _user(), F.lit(None).cast("string"), F.col("prediction_id"), SPLIT_A_PCT)
    out = ro.ab_outcome_summary(routed, "variant", F.col("is_fraud") == 1, MIN_SAMPLE)
    return out.select("variant", "n", "conversions", r9("conversion_rate"), "reached_min_sample")


_ARMS_SQL = "[" + ", ".join(f"'{m}'" for m in MODEL_TYPES) + "]"


@register("W16", with_ctes(f"""SELECT prediction_id,
    CASE WHEN {md5_unit_bucket_sql("'explore:' || prediction_id")} < {EPSILON}
         THEN {_ARMS_SQL}[CAST({md5_mod_sql('prediction_id', 3)} AS INTEGER) + 1]
         ELSE (SELECT arg_min(model_type, (-avg_reward, model_type)) FROM stats) END AS chosen_arm
    FROM logs""", "logs", extra=[_STATS_SQL]))
def q_w16(spark, sf_dir):
    """Epsilon-greedy arm per request: hashed exploration, else the best mean reward."""
    logs = prediction_logs(spark, sf_dir)
    best = ro.greedy_arm(ro.bandit_stats(logs, "model_type", _reward()), "model_type")
    explore = md5_unit_bucket(F.concat(F.lit("explore:"), F.col("prediction_id"))) < F.lit(EPSILON)
    hashed = F.element_at(F.array(*[F.lit(m) for m in MODEL_TYPES]), (md5_mod(F.col("prediction_id"), 3) + 1).cast("int"))
    return logs.crossJoin(F.broadcast(best)).select(
        "prediction_id", F.when(explore, hashed).otherwise(F.col("chosen_arm")).alias("chosen_arm"))
