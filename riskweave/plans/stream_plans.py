"""Registered queries: streaming operators T01-T09, each run to completion over
the staged table (trigger availableNow) and read back from its sink; the
SQL is the batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.functions.hashing import md5_unit_bucket_sql, weighted_variant_sql
from riskweave.operators import drift as dr
from riskweave.operators import reports as rp
from riskweave.operators import routing as ro
from riskweave.plans._sqlhelp import r9
from riskweave.plans.drift_plans import _D08_CTES, D08_ALERT, D08_REF_END, TX_NUM
from riskweave.plans.feature_plans import FEAT_CTE
from riskweave.plans.registry import register
from riskweave.plans.routing_plans import VARIANTS
from riskweave.plans.window_plans import _W10_CTE
from riskweave.session import kept, scratch_path
from riskweave.sources.tables import prediction_logs, transactions, with_ctes
from riskweave.streaming import jobs
from riskweave.streaming import runtime as rt

WATERMARK = "10 days"
CUT = "2024-01-21"


def _dirs(spark, tag):
    base = scratch_path(spark, f"{tag}-{uuid.uuid4().hex[:12]}")
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


def _staged_stream(spark, df, tag, extra=None):
    src, sink, ck = _dirs(spark, tag)
    rt.stage_files(df, src, "created_at", chunks=3)
    if extra is not None:
        extra.write.mode("append").parquet(src)
    return rt.event_time(rt.read_stream(spark, src, df.schema), "created_at"), sink, ck


def _append_run(spark, out, sink, ck):
    rt.run_available_now(out.writeStream.format("parquet").option("path", sink).outputMode("append"), ck)
    return spark.read.parquet(sink)


def _update_run(spark, out, sink, ck, keys):
    rt.run_available_now(out.writeStream.outputMode("update").foreachBatch(rt.append_batches(sink)), ck)
    return rt.final_updates(spark, sink, keys)


_T01_STATS = f"""st AS (
  SELECT avg(amount) AS amount_mean, stddev_samp(amount) AS amount_std,
         quantile_cont(amount, 0.75) AS amount_p75, quantile_cont(amount, 0.95) AS amount_p95
  FROM tx WHERE created_at < TIMESTAMP '{CUT}')"""


@register("T01", with_ctes("""SELECT transaction_id, high_amount, round(risk_score, 9) AS risk_score,
    CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM feat""", "tx", extra=[_T01_STATS, FEAT_CTE]))
def q_t01(spark, sf_dir):
    """Streaming scoring: validate, features with frozen stats, score, append to Parquet."""
    tx = transactions(spark, sf_dir)
    stats = fe.fit_feature_stats(tx.where(F.col("created_at") < F.lit(CUT).cast("timestamp_ntz")))
    # fitted once: every micro-batch reads the saved row, never the history
    frozen = scratch_path(spark, f"t01-stats-{uuid.uuid4().hex[:12]}")
    stats.write.parquet(frozen)
    stats = spark.read.schema(stats.schema).parquet(frozen)
    stream, sink, ck = _staged_stream(spark, tx, "t01")
    out = jobs.score_stream(stream.drop("event_time"), stats).select(
        "transaction_id", "high_amount", "risk_score", "predicted_label")
    back = _append_run(spark, out, sink, ck)
    return back.select("transaction_id", "high_amount", r9("risk_score"), "predicted_label")


def _audited_requests(spark, sf_dir):
    """Log rows with what the gateway adds: who asked, from where, admin calls and failed authentications."""
    tid = F.col("transaction_id")
    return prediction_logs(spark, sf_dir).withColumns({
        "auth_method": F.when(F.col("user_id") % 2 == 0, "api_key").otherwise("jwt"),
        "ip_address": F.concat_ws(".", F.lit("10"), (F.floor(F.col("user_id") / 65536) % 256).cast("string"),
                                  (F.floor(F.col("user_id") / 256) % 256).cast("string"), (F.col("user_id") % 256).cast("string")),
        "request_id": F.substring(F.md5("prediction_id"), 1, 16),
        "admin_action": F.when(tid % 50 == 7, "reload_model").when(tid % 50 == 8, "promote_model"),
        "auth_attempt": F.when(tid % 40 == 11, "api_key").when(tid % 40 == 12, "jwt")})


_T02_CTE = """au AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'api_key' ELSE 'jwt' END AS auth_method,
    '10.' || CAST(user_id // 65536 % 256 AS VARCHAR) || '.' || CAST(user_id // 256 % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip_address,
    substr(md5(prediction_id), 1, 16) AS request_id,
    CASE WHEN transaction_id % 50 = 7 THEN 'reload_model' WHEN transaction_id % 50 = 8 THEN 'promote_model' END AS admin_action,
    CASE WHEN transaction_id % 40 = 11 THEN 'api_key' WHEN transaction_id % 40 = 12 THEN 'jwt' END AS auth_attempt FROM logs),
ev AS (SELECT *, CASE WHEN auth_attempt IS NOT NULL THEN 'auth_failure' WHEN admin_action IS NOT NULL THEN 'admin_action'
    WHEN status_code >= 500 THEN 'error' ELSE 'prediction' END AS event_type FROM au)"""


@register("T02", with_ctes("""SELECT event_type, CASE WHEN event_type = 'auth_failure' THEN 'anonymous' ELSE 'user' || CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN event_type = 'prediction' THEN auth_method END AS auth_method,
    CASE WHEN event_type <> 'admin_action' THEN ip_address END AS ip_address,
    CASE WHEN event_type IN ('prediction', 'error') THEN endpoint END AS endpoint,
    CASE WHEN event_type IN ('prediction', 'error') THEN 'POST' END AS method,
    CASE WHEN event_type IN ('prediction', 'error') THEN request_id END AS request_id,
    CASE WHEN event_type = 'prediction' THEN prediction_id END AS prediction_id,
    CASE WHEN event_type = 'prediction' THEN amount END AS transaction_amount,
    CASE WHEN event_type = 'prediction' THEN fraud_probability END AS fraud_probability,
    CASE WHEN event_type = 'prediction' THEN fraud_label END AS fraud_label,
    CASE WHEN event_type = 'prediction' THEN processing_time_ms END AS processing_time_ms,
    CASE WHEN event_type = 'prediction' THEN 200 WHEN event_type = 'error' THEN status_code END AS status_code,
    CASE WHEN event_type = 'error' THEN 'Internal server error' END AS error_message,
    CASE WHEN event_type = 'auth_failure' THEN '{"attempt_type":"' || auth_attempt || '","details":"' || endpoint || '"}'
         WHEN event_type = 'admin_action' THEN '{"action":"' || admin_action || '","model_type":"' || model_type || '","model_version":"' || model_version || '"}'
    END AS metadata, created_at FROM ev""", "logs", extra=[_T02_CTE]))
def q_t02(spark, sf_dir):
    """Micro-batch audit sink: predictions, errors, admin actions and failed authentications, once per batch (batch id kept)."""
    stream, sink, ck = _staged_stream(spark, _audited_requests(spark, sf_dir), "t02")
    out = jobs.audit_records(stream)
    rt.run_available_now(out.writeStream.foreachBatch(rt.append_batches(sink)), ck)
    return spark.read.parquet(sink).drop("batch_id")


_T03_SQL = "SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, model_type, count(*) AS requests, " + \
    ", ".join(f"count(*) FILTER (WHERE processing_time_ms / 1000 <= {b!r}) AS le_{i}"
              for i, b in enumerate(rp.LATENCY_BUCKETS)) + " FROM logs GROUP BY 1, 2"


@register("T03", with_ctes(_T03_SQL, "logs"))
def q_t03(spark, sf_dir):
    """Live counters and latency buckets per hour and model (watermarked, update mode)."""
    stream, sink, ck = _staged_stream(spark, prediction_logs(spark, sf_dir), "t03")
    out = jobs.live_counters(stream, WATERMARK).withColumn(
        "window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")
    return _update_run(spark, out, sink, ck, ["window_start", "model_type"])


@register("T04", with_ctes("""SELECT model_type, ws AS window_start, count(*) AS n,
    round(avg(fraud_label), 9) AS fraud_rate
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, created_at) - to_minutes(5 * k) AS ws FROM logs, range(12) t(k))
    GROUP BY ALL""", "logs"))
def q_t04(spark, sf_dir):
    """Live rolling one-hour fraud rate per model (sliding windows, watermark)."""
    stream, sink, ck = _staged_stream(spark, prediction_logs(spark, sf_dir), "t04")
    out = jobs.live_rolling_rate(stream, WATERMARK).withColumn(
        "slide_start", F.col("w.start").cast("timestamp_ntz")).drop("w")
    slides = _update_run(spark, out, sink, ck, ["slide_start", "model_type"])
    fin = jobs.rolling_windows(slides, "slide_start", "model_type")
    return fin.select("model_type", "window_start", "n", r9(F.col("frauds") / F.col("n"), "fraud_rate"))


@register("T05", with_ctes("""SELECT transaction_id, count(*) OVER w AS requests_last_minute,
    count(*) OVER w > 100 AS rate_limited FROM tx
    WINDOW w AS (PARTITION BY user_id ORDER BY created_at
                 RANGE BETWEEN to_microseconds(59999999) PRECEDING AND CURRENT ROW)""", "tx"))
def q_t05(spark, sf_dir):
    """Live rate limiting over files out of time order: each micro-batch meets the
    state of its time, and rows that a late row comes to count for are told again."""
    tx = transactions(spark, sf_dir)
    src, sink, ck = _dirs(spark, "t05")
    # every fifth row arrives with the last file, up to the whole log late
    late = F.pmod(F.xxhash64("transaction_id"), F.lit(5)) == 0
    rt.stage_files(tx.where(~late), src, "created_at", chunks=3)
    tx.where(late).coalesce(1).write.mode("append").parquet(src)
    stream = rt.read_stream(spark, src, tx.schema)
    span = 400 * 86_400  # lateness that the log's shuffled files need
    rt.run_available_now(stream.writeStream.foreachBatch(jobs.rate_limit_sink(sink, sink + "-state", late_seconds=span)), ck)
    return rt.final_updates(spark, sink, ["transaction_id"])


def _reuse_requests(spark, sf_dir):
    """Requests, each third sent again after 200 s and each fifth after 2,000 s, and what an
    administrator's calls would add: a key is dropped 100 s after a failed request, all are cleared daily."""
    logs = prediction_logs(spark, sf_dir).select(
        "prediction_id", "transaction_id", "fraud_probability", "status_code", "created_at",
        fe.feature_key("amount", "country_risk", "device_score", "hour").alias("cache_key"))
    later = F.expr("""filter(array(struct('' AS tag, 0 AS s), if(transaction_id % 3 = 0, struct('-b' AS tag, 200 AS s), NULL),
                              if(transaction_id % 5 = 0, struct('-c' AS tag, 2000 AS s), NULL)), x -> x IS NOT NULL)""")
    at = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("x.s"))
    asked = logs.withColumn("x", F.explode(later)).select(
        F.lit("score").alias("kind"), "cache_key", F.concat("prediction_id", "x.tag").alias("prediction_id"), "fraud_probability",
        at.alias("created_at"))
    drops = logs.where(F.col("status_code") >= 500).select(
        F.lit("invalidate").alias("kind"), "cache_key", F.lit(None).cast("string").alias("prediction_id"),
        F.lit(None).cast("double").alias("fraud_probability"), (F.col("created_at") + F.expr("INTERVAL 100 SECONDS")).alias("created_at"))
    clears = logs.select(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("created_at")).distinct().select(
        F.lit("invalidate_all").alias("kind"), F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast("string").alias("prediction_id"),
        F.lit(None).cast("double").alias("fraud_probability"), "created_at")
    return asked.unionByName(drops).unionByName(clears)


_KEY_SQL = "md5(concat_ws('|', " + ", ".join(
    f"'{c}', CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)" for c in ("amount", "country_risk", "device_score", "hour")) + "))"

_REUSE_CTE = f"""lk AS (SELECT *, {_KEY_SQL} AS cache_key FROM logs),
clears AS (SELECT DISTINCT date_trunc('day', created_at)::TIMESTAMP AS c FROM lk),
ev AS (
  SELECT cache_key, created_at + to_seconds(s) AS t, 2 AS kind, prediction_id || tag AS prediction_id, fraud_probability AS p
  FROM lk, (VALUES ('', 0, 1), ('-b', 200, 3), ('-c', 2000, 5)) v(tag, s, every) WHERE transaction_id % every = 0
  UNION ALL SELECT cache_key, created_at + INTERVAL 100 SECONDS, 1, NULL, NULL FROM lk WHERE status_code >= 500),
seq AS (
  SELECT *, (SELECT count(*) FROM clears WHERE c <= t) AS epoch,
    row_number() OVER (PARTITION BY cache_key ORDER BY t, kind, prediction_id) AS rn,
    CASE WHEN p > 0.7 OR p < 0.1 THEN 300 WHEN p > 0.3 AND p < 0.7 THEN 1800 ELSE 3600 END AS ttl FROM ev),
replay AS (
  SELECT cache_key, rn, prediction_id, kind, false AS hit, ttl, CASE WHEN kind = 2 THEN t + to_seconds(ttl) END AS expires, epoch AS held FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.cache_key, s.rn, s.prediction_id, s.kind, s.kind = 2 AND coalesce(s.t < r.expires AND s.epoch = r.held, false), s.ttl,
    CASE WHEN s.kind = 1 THEN NULL WHEN s.t < r.expires AND s.epoch = r.held THEN r.expires ELSE s.t + to_seconds(s.ttl) END,
    CASE WHEN s.t < r.expires AND s.epoch = r.held THEN r.held ELSE s.epoch END
  FROM replay r JOIN seq s ON s.cache_key = r.cache_key AND s.rn = r.rn + 1)"""


@register("T06", with_ctes("""SELECT prediction_id, hit AS cache_hit, CASE WHEN NOT hit THEN ttl END AS ttl_seconds
    FROM replay WHERE kind = 2""", "logs", extra=[_REUSE_CTE]).replace("WITH ", "WITH RECURSIVE ", 1))
def q_t06(spark, sf_dir):
    """Live score reuse on the full canonical key: a request within the tiered time to live of a
    stored score is a hit, unless its key was dropped or all were cleared in between; files out of time order."""
    events = kept(_reuse_requests(spark, sf_dir), "t06-requests")
    src, sink, ck = _dirs(spark, "t06")
    late = (F.col("kind") == "score") & (F.pmod(F.xxhash64("prediction_id"), F.lit(5)) == 0)
    files = rt.files_per_chunk(spark)
    rt.stage_files(events.where(~late), src, "created_at", chunks=3, files=files)
    events.where(late).repartition(files).write.mode("append").parquet(src)
    step = jobs.score_reuse_sink(sink, sink + "-state", late_seconds=400 * 86_400)
    rt.run_available_now(rt.read_stream(spark, src, events.schema, files).writeStream.foreachBatch(step), ck)
    step(None, 1 << 40, spark)  # the log has ended: decide what still waits
    return spark.read.parquet(sink).select("prediction_id", "cache_hit", "ttl_seconds")


_USER = "'user' || CAST(user_id AS VARCHAR)"


_CANARY_CTE_T07 = f"""cv AS (SELECT *, CASE WHEN {md5_unit_bucket_sql("'canary:user' || CAST(user_id AS VARCHAR)")} < 0.1
    THEN 'v2' ELSE 'v1' END AS variant FROM logs)"""


@register("T07", with_ctes("""SELECT variant, count(*) AS total_requests,
    round(sum(fraud_label) / greatest(count(*), 1), 9) AS fraud_rate,
    round(count(*) FILTER (WHERE status_code >= 500) / greatest(count(*), 1), 9) AS error_rate,
    round(avg(processing_time_ms), 9) AS avg_latency_ms, round(avg(fraud_probability), 9) AS avg_fraud_probability,
    (SELECT COALESCE(max(decision), 'active') FROM (SELECT * FROM dec WHERE decision IS NOT NULL
       ORDER BY created_at, transaction_id LIMIT 1)) AS canary_status,
    (SELECT max(created_at) FROM (SELECT * FROM dec WHERE decision IS NOT NULL
       ORDER BY created_at, transaction_id LIMIT 1)) AS canary_decided_at
    FROM cv GROUP BY variant""", "logs", extra=[_CANARY_CTE_T07, _W10_CTE]))
def q_t07(spark, sf_dir):
    """Live canary experiment: per-variant running metrics (update mode) and the
    canary health state machine (foreachBatch with a carried state row)."""
    logs = prediction_logs(spark, sf_dir)
    start = logs.agg(F.min("created_at")).first()[0]  # experiment start: configuration, one value
    stream, sink, ck = _staged_stream(spark, logs, "t07")
    routed = ro.route_canary(stream, F.concat(F.lit("user"), F.col("user_id").cast("string")), 0.1, "v2", "v1")
    fin = _update_run(spark, jobs.live_variant_metrics(routed), sink, ck, ["variant"])
    state_path = sink + "-canary"
    rt.run_available_now(routed.writeStream.foreachBatch(
        jobs.canary_health_sink(state_path, F.lit(start).cast("timestamp_ntz"))), ck + "-canary")
    health = jobs.final_canary_state(spark, state_path)
    n = F.greatest(F.col("total_requests"), F.lit(1))
    metrics = fin.select("variant", "total_requests", r9(F.col("fraud_predictions") / n, "fraud_rate"),
                         r9(F.col("errors") / n, "error_rate"), r9(F.col("latency_sum") / n, "avg_latency_ms"),
                         r9(F.col("probability_sum") / n, "avg_fraud_probability"))
    return metrics.crossJoin(F.broadcast(health.select(F.col("status").alias("canary_status"),
                                                        F.col("decided_at").alias("canary_decided_at"))))


@register("T08", with_ctes("""SELECT model_type, count(*) AS count,
    round(sum(CASE WHEN fraud_label = is_fraud THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS reward_sum,
    round(sum(CASE WHEN fraud_label = is_fraud THEN 1.0 ELSE 0.0 END) / greatest(count(*), 1), 9) AS avg_reward
    FROM logs GROUP BY model_type""", "logs"))
def q_t08(spark, sf_dir):
    """Live bandit statistics per arm."""
    stream, sink, ck = _staged_stream(spark, prediction_logs(spark, sf_dir), "t08")
    fin = _update_run(spark, jobs.live_bandit(stream), sink, ck, ["model_type"])
    return fin.select("model_type", "count", r9("reward_sum"),
                      r9(F.col("reward_sum") / F.greatest(F.col("count"), F.lit(1)), "avg_reward"))


@register("T09", with_ctes("SELECT prediction_id, created_at FROM logs", "logs"))
def q_t09(spark, sf_dir):
    """Idempotent ingest: a re-delivered slice of the log is dropped within the watermark."""
    logs = prediction_logs(spark, sf_dir).select("prediction_id", "created_at", "fraud_probability")
    redelivered = logs.where(F.col("created_at") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    stream, sink, ck = _staged_stream(spark, logs, "t09", extra=redelivered)
    out = jobs.dedupe_ingest(stream, "prediction_id", WATERMARK).select("prediction_id", "created_at")
    return _append_run(spark, out, sink, ck)


@register("D08L", with_ctes(f"""SELECT window_start, feature, round(psi, 9) AS psi, psi > {D08_ALERT} AS drift_detected
    FROM psi""", "tx", extra=_D08_CTES))
def q_d08l(spark, sf_dir):
    """Live daily drift: per-window histograms over frozen first-week edges kept as stream state, PSI from their counts."""
    tx = transactions(spark, sf_dir)
    end = F.lit(D08_REF_END).cast("timestamp_ntz")
    reference = dr.reference_bins(dr.to_long(tx.where(F.col("created_at") < end), TX_NUM))
    frozen = scratch_path(spark, f"d08l-{uuid.uuid4().hex[:12]}")
    reference.write.parquet(frozen)  # every micro-batch reads the saved rows, never the history
    reference = spark.read.schema(reference.schema).parquet(frozen)
    stream, sink, ck = _staged_stream(spark, tx.where(F.col("created_at") >= end), "d08l")
    live = dr.live_bin_counts(stream, reference, TX_NUM, WATERMARK)
    counts = _update_run(spark, live.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w"), sink, ck,
                         ["window_start", "feature"])
    psi = dr.psi_of_counts(counts, reference, ["window_start"])
    return psi.select("window_start", "feature", r9("psi"), (F.col("psi") > F.lit(D08_ALERT)).alias("drift_detected"))
