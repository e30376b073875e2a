"""Registered queries: windows, sort/limit, top-k and alert series."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.hashing import md5_unit_bucket_sql
from riskweave.operators import curves as cv
from riskweave.operators import routing as ro
from riskweave.operators import reports as rp
from riskweave.operators import windows as wn
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.sources.tables import MODEL_TYPES, prediction_logs, transactions, with_ctes

# Alert rule thresholds (metric, comparison, threshold, severity).
ALERT_RULES = [
    ("latency_p95_seconds", ">", 0.5, "warning"),
    ("latency_p99_seconds", ">", 1.0, "critical"),
    ("reuse_rate", "<", 0.5, "warning"),
    ("accuracy", "<", 0.8, "critical"),
    ("fraud_predictions", ">", 100.0, "warning"),
    ("invocations_per_hour", ">", 10000.0, "info"),
]


@register("W01", with_ctes("""SELECT transaction_id, count(*) OVER w AS tx_count_last_hour,
    round(sum(amount) OVER w, 9) AS amount_last_hour FROM tx
    WINDOW w AS (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
                           "tx"))
def q_w01(spark, sf_dir):
    """Trailing-hour per-user velocity (count and amount) for every transaction."""
    out = wn.velocity(transactions(spark, sf_dir))
    return out.select("transaction_id", "tx_count_last_hour", r9("amount_last_hour"))


@register("W02", with_ctes("""SELECT transaction_id, count(*) OVER w AS prior_count,
    round(avg(amount) OVER w, 9) AS prior_avg_amount, round(avg(is_fraud) OVER w, 9) AS prior_fraud_rate
    FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY created_at, transaction_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "tx"))
def q_w02(spark, sf_dir):
    """Leak-free per-user history: stats of each user's earlier transactions."""
    out = wn.prior_user_stats(transactions(spark, sf_dir))
    return out.select("transaction_id", "prior_count", r9("prior_avg_amount"), r9("prior_fraud_rate"))


@register("W03", with_ctes("""SELECT transaction_id, count(*) OVER w AS requests_last_minute,
    count(*) OVER w > 100 AS rate_limited FROM tx
    WINDOW w AS (PARTITION BY user_id ORDER BY created_at
                 RANGE BETWEEN to_microseconds(59999999) PRECEDING AND CURRENT ROW)""", "tx"))
def q_w03(spark, sf_dir):
    """Sliding 60 s request count per user and the rate-limit flag."""
    return wn.rate_limit(transactions(spark, sf_dir)).select("transaction_id", "requests_last_minute", "rate_limited")


@register("W04", with_ctes("""SELECT model_type, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end,
    count(*) AS n, round(avg(fraud_label), 9) AS fraud_rate
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, created_at) - to_minutes(5 * k) AS ws FROM logs, range(12) t(k))
    GROUP BY ALL""", "logs"))
def q_w04(spark, sf_dir):
    """Rolling one-hour fraud rate per model, sliding every 5 minutes."""
    out = wn.sliding_rate(prediction_logs(spark, sf_dir), ["model_type"], "created_at", "fraud_label")
    return out.select("model_type", "window_start", "window_end", "n", r9("fraud_rate"))


@register("W05", with_ctes("""SELECT hour_start, round(rate, 9) AS rate,
    round(avg(rate) OVER (ORDER BY hour_start ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 9) AS mean_7d,
    abs(rate - avg(rate) OVER (ORDER BY hour_start ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)) > 0.1 AS deviation_alert
    FROM (SELECT unnest(generate_series((SELECT min(hour_start) FROM h), (SELECT max(hour_start) FROM h),
                                        INTERVAL 1 HOUR)) AS hour_start) sp LEFT JOIN h USING (hour_start)""",
                           "logs", extra=["h AS (SELECT date_trunc('hour', created_at) AS hour_start, "
                                          "avg(fraud_label) AS rate FROM logs GROUP BY 1)"]))
def q_w05(spark, sf_dir):
    """Hourly fraud-prediction rate vs its trailing 7-day mean."""
    out = wn.hourly_deviation(prediction_logs(spark, sf_dir), "created_at", "fraud_label")
    return out.select("hour_start", r9("rate"), r9("mean_7d"), "deviation_alert")


@register("W06", with_ctes("""SELECT day, requests, round(avg(requests) OVER w, 9) AS avg_7d,
    requests > 1.2 * avg(requests) OVER w AS spike
    FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS requests FROM logs GROUP BY 1)
    WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""", "logs"))
def q_w06(spark, sf_dir):
    """Daily request total vs the trailing 7-day average (spike flag)."""
    return wn.daily_spike(prediction_logs(spark, sf_dir), "created_at").select("day", "requests", r9("avg_7d"), "spike")


_W07_SQL = """SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, count(*) AS requests,
    count(*) FILTER (WHERE status_code >= 500) AS errors,
    count(*) FILTER (WHERE status_code >= 500) / count(*) AS error_rate,
    count(*) FILTER (WHERE status_code >= 500) / count(*) > 0.01 AS breach FROM logs GROUP BY 1"""


@register("W07", with_ctes(f"""SELECT window_start, requests, errors, round(error_rate, 9) AS error_rate, breach
    FROM ({_W07_SQL})""", "logs"))
def q_w07(spark, sf_dir):
    """5xx share per 5-minute window and the >1% breach flag."""
    out = wn.error_rate_series(prediction_logs(spark, sf_dir), "created_at", "status_code")
    return out.select("window_start", "requests", "errors", r9("error_rate"), "breach")


_HELD_CTE = f"""w5 AS (SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS stepped, * FROM logs),
hist5 AS (SELECT stepped, le, count(*) FILTER (WHERE processing_time_ms / 1000 <= le) AS cumulative_count
  FROM w5, (SELECT unnest([{', '.join(repr(b) for b in rp.LATENCY_BUCKETS)}, 'inf'::DOUBLE]) AS le) GROUP BY stepped, le),
hb5 AS (SELECT stepped, le, cumulative_count, COALESCE(lag(le) OVER w, 0.0) AS prev_le, COALESCE(lag(cumulative_count) OVER w, 0) AS prev_cnt,
    max(cumulative_count) OVER (PARTITION BY stepped) AS total FROM hist5 WINDOW w AS (PARTITION BY stepped ORDER BY le)),
q5 AS (SELECT stepped, q, lim, rule, CASE WHEN le = 'inf'::DOUBLE THEN {rp.LATENCY_BUCKETS[-1]!r} WHEN cumulative_count = prev_cnt THEN le
         ELSE prev_le + (le - prev_le) * (q * total - prev_cnt) / (cumulative_count - prev_cnt) END AS value
  FROM hb5, (VALUES (0.95::DOUBLE, 0.5, 'HighLatency'), (0.99::DOUBLE, 1.0, 'VeryHighLatency')) v(q, lim, rule)
  WHERE cumulative_count >= q * total QUALIFY row_number() OVER (PARTITION BY stepped, rule ORDER BY le) = 1),
h AS (SELECT date_trunc('hour', created_at) AS hour_start, avg(fraud_label) AS rate FROM logs GROUP BY 1),
dev AS (SELECT hour_start, abs(rate - avg(rate) OVER (ORDER BY hour_start ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)) > 0.1 AS breach
  FROM (SELECT unnest(generate_series((SELECT min(hour_start) FROM h), (SELECT max(hour_start) FROM h), INTERVAL 1 HOUR)) AS hour_start)
    sp LEFT JOIN h USING (hour_start)),
ser AS (
  SELECT 'HighErrorRate' AS rule, stepped, count(*) FILTER (WHERE status_code >= 500) / count(*) > 0.01 AS breach FROM w5 GROUP BY stepped
  UNION ALL SELECT 'ModelAccuracyDrop', stepped, avg(CASE WHEN fraud_label = is_fraud THEN 1.0::DOUBLE ELSE 0.0 END) < 0.8 FROM w5 GROUP BY stepped
  UNION ALL SELECT rule, stepped, value > lim FROM q5
  UNION ALL SELECT 'UnusualFraudRate', hour_start, breach FROM dev),
held(rule, step, dur, severity) AS (VALUES {', '.join(map(repr, wn.HELD_RULES))}),
runs AS (SELECT rule, step, dur, severity, min(stepped) AS started_at, max(stepped) AS last_at, (count(*) - 1) * step AS held_minutes FROM (
    SELECT rule, stepped, step, dur, severity, epoch(stepped) / 60 - row_number() OVER (PARTITION BY rule ORDER BY stepped) * step AS run
    FROM ser JOIN held USING (rule) WHERE breach) GROUP BY rule, step, dur, severity, run),
ends AS (SELECT rule, max(stepped) AS newest FROM ser GROUP BY rule)"""


@register("W08", with_ctes("""SELECT rule, severity, started_at, held_minutes::BIGINT AS held_minutes,
    CASE WHEN held_minutes < dur THEN 'pending' WHEN last_at < newest THEN 'resolved' ELSE 'firing' END AS state,
    CASE WHEN held_minutes >= dur THEN started_at + to_minutes((ceil(dur / step) * step)::INT) END AS fired_at,
    CASE WHEN held_minutes >= dur AND last_at < newest THEN last_at + to_minutes(step) END AS resolved_at
    FROM runs JOIN ends USING (rule)""", "logs", extra=[_HELD_CTE]))
def q_w08(spark, sf_dir):
    """Alerts that must hold for their rule's duration: pending, firing and resolved, for the error share,
    both latency quantiles, accuracy and the unusual fraud rate."""
    rules = spark.createDataFrame(wn.HELD_RULES, "rule string, step_minutes int, for_minutes int, severity string")
    return wn.persistent_alerts(wn.held_rule_series(prediction_logs(spark, sf_dir)), rules)


_W09_METRICS = """m AS (
  SELECT 'latency_p95_seconds' AS metric, CAST(created_at AS DATE) AS day,
         quantile_cont(processing_time_ms / 1000, 0.95) AS value FROM logs GROUP BY 2
  UNION ALL SELECT 'latency_p99_seconds', CAST(created_at AS DATE), quantile_cont(processing_time_ms / 1000, 0.99)
         FROM logs GROUP BY 2
  UNION ALL SELECT 'accuracy', CAST(created_at AS DATE), avg(CASE WHEN fraud_label = is_fraud THEN 1.0 ELSE 0.0 END)
         FROM logs GROUP BY 2
  UNION ALL SELECT 'fraud_predictions', CAST(created_at AS DATE), CAST(sum(fraud_label) AS DOUBLE) FROM logs GROUP BY 2
  UNION ALL SELECT 'reuse_rate', CAST(created_at AS DATE),
         (count(*) - count(DISTINCT (user_id, amount, hour, device_score, country_risk))) / greatest(count(*), 1) FROM logs GROUP BY 2
  UNION ALL SELECT 'invocations_per_hour', CAST(h AS DATE), CAST(max(n) AS DOUBLE)
         FROM (SELECT date_trunc('hour', created_at) AS h, count(*) AS n FROM logs GROUP BY 1) GROUP BY 2)"""


def _rules_sql() -> str:
    rows = ", ".join(f"('{m}', '{op}', {thr}, '{sev}')" for m, op, thr, sev in ALERT_RULES)
    return f"rules(metric, op, threshold, severity) AS (VALUES {rows})"


@register("W09", with_ctes("""SELECT m.metric AS rule, m.day, round(m.value, 9) AS value, r.severity FROM m JOIN rules r
    ON m.metric = r.metric WHERE (r.op = '>' AND m.value > r.threshold) OR (r.op = '<' AND m.value < r.threshold)""",
                           "logs", extra=[_W09_METRICS, _rules_sql()]))
def q_w09(spark, sf_dir):
    """Threshold alert table over daily metric series (latency quantiles, accuracy, volumes)."""
    from riskweave.operators.alerts import daily_metric_series, threshold_alerts
    series = daily_metric_series(prediction_logs(spark, sf_dir))
    rules = spark.createDataFrame(ALERT_RULES, "metric string, op string, threshold double, severity string")
    return threshold_alerts(series, rules).select("rule", "day", r9("value"), "severity")


_CANARY_USER = "'canary:user' || CAST(user_id AS VARCHAR)"
_W10_CTE = f"""cr AS (
  SELECT created_at, transaction_id,
    sum(CASE WHEN v = 'v2' THEN 1 ELSE 0 END) OVER w AS n,
    sum(CASE WHEN v = 'v2' AND status_code >= 500 THEN 1 ELSE 0 END) OVER w AS err,
    sum(CASE WHEN v = 'v2' THEN processing_time_ms ELSE 0.0 END) OVER w AS lat
  FROM (SELECT *, CASE WHEN {md5_unit_bucket_sql(_CANARY_USER)} < 0.1 THEN 'v2' ELSE 'v1' END AS v FROM logs)
  WINDOW w AS (ORDER BY created_at, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dec AS (
  SELECT created_at, transaction_id, n, err / greatest(n, 1) AS error_rate, lat / greatest(n, 1) AS avg_latency_ms,
    CASE WHEN n < 100 THEN NULL WHEN err / greatest(n, 1) > 0.05 THEN 'rolled_back'
         WHEN lat / greatest(n, 1) > 200 THEN 'rolled_back'
         WHEN created_at > (SELECT min(created_at) FROM logs) + INTERVAL 1 HOUR THEN 'promoted' END AS decision
  FROM cr)"""


@register("W10", with_ctes("""SELECT COALESCE(max(decision), 'active') AS status, max(created_at) AS decided_at,
    CAST(max(n) AS BIGINT) AS canary_requests, round(max(error_rate), 9) AS error_rate, round(max(avg_latency_ms), 9) AS avg_latency_ms
    FROM (SELECT * FROM dec WHERE decision IS NOT NULL ORDER BY created_at, transaction_id LIMIT 1)""",
                           "logs", extra=[_W10_CTE]))
def q_w10(spark, sf_dir):
    """Canary replay: first promote/rollback decision over time-ordered requests."""
    logs = prediction_logs(spark, sf_dir)
    routed = ro.route_canary(logs, F.concat(F.lit("user"), F.col("user_id").cast("string")), 0.1, "v2", "v1")
    start = routed.agg(F.min("created_at").alias("_start"))
    routed = routed.crossJoin(F.broadcast(start))
    out = wn.canary_decision(routed, "variant", "v2", "created_at", "transaction_id", F.col("_start"))
    return out.select("status", "decided_at", "canary_requests", r9("error_rate"), r9("avg_latency_ms"))


@register("W11", with_ctes("""SELECT transaction_id, user_id, amount, created_at FROM tx
    ORDER BY created_at DESC, transaction_id DESC LIMIT 100""", "tx"))
def q_w11(spark, sf_dir):
    """Latest 100 transactions."""
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "amount", "created_at")
    return wn.latest_n(tx, "created_at", "transaction_id", 100)


@register("W12", with_ctes("""SELECT prediction_id, fraud_probability, created_at FROM logs
    WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'
    ORDER BY created_at DESC, prediction_id DESC""", "logs"))
def q_w12(spark, sf_dir):
    """Predictions in an inclusive time range, newest first."""
    logs = prediction_logs(spark, sf_dir).select("prediction_id", "fraud_probability", "created_at")
    return wn.time_range(logs, "created_at", "prediction_id", "2024-01-10 00:00:00", "2024-01-12 00:00:00")


_AUDIT_FILTER = "user_id = 7 AND merchant_id = 'purchase'"


@register("W13", with_ctes(f"""SELECT prediction_id, user_id, merchant_id, created_at,
    (SELECT count(*) FROM logs WHERE {_AUDIT_FILTER}) AS total FROM
    (SELECT * FROM logs WHERE {_AUDIT_FILTER} ORDER BY created_at DESC, prediction_id DESC LIMIT 5)""", "logs"))
def q_w13(spark, sf_dir):
    """Audit query: one user's actions of one kind, last 5 in arrival order plus the total."""
    logs = prediction_logs(spark, sf_dir).select("prediction_id", "user_id", "merchant_id", "created_at")
    return wn.filtered_tail(logs, "created_at", "prediction_id", {"user_id": 7, "merchant_id": "purchase"}, limit=5)


@register("W14", with_ctes("""SELECT prediction_id, fraud_label, created_at,
    (SELECT count(*) FROM logs WHERE fraud_label = 1 AND created_at >= TIMESTAMP '2024-01-05'
       AND created_at <= TIMESTAMP '2024-01-06') AS total FROM
    (SELECT * FROM logs WHERE fraud_label = 1 AND created_at >= TIMESTAMP '2024-01-05'
       AND created_at <= TIMESTAMP '2024-01-06' ORDER BY created_at DESC, prediction_id DESC LIMIT 20)""", "logs"))
def q_w14(spark, sf_dir):
    """Log query by time range and label with a limit."""
    logs = prediction_logs(spark, sf_dir).select("prediction_id", "fraud_label", "created_at")
    return wn.filtered_tail(logs, "created_at", "prediction_id", {"fraud_label": 1},
                            start="2024-01-05", end="2024-01-06", limit=20)


_RUNS_CTE = """cg AS (SELECT model_type, fraud_probability AS s, CAST(sum(is_fraud) AS DOUBLE) AS pos,
                      CAST(count(*) AS DOUBLE) AS n FROM logs GROUP BY 1, 2),
cc AS (SELECT model_type, pos, n,
         sum(pos) OVER (PARTITION BY model_type ORDER BY s DESC) AS cum_pos,
         sum(n) OVER (PARTITION BY model_type ORDER BY s DESC) AS cum_n,
         sum(pos) OVER (PARTITION BY model_type) AS total_pos, sum(n) OVER (PARTITION BY model_type) AS total_n FROM cg),
runs AS (SELECT model_type,
   sum(pos * ((total_n - total_pos) - (cum_n - cum_pos) + 0.5 * (n - pos))) / (max(total_pos) * max(total_n - total_pos)) AS roc_auc,
   sum(pos / total_pos * (cum_pos / cum_n)) AS average_precision FROM cc GROUP BY model_type)"""


def runs_table(spark, sf_dir):
    """One row per model (as a training run): ROC-AUC and average precision on the log."""
    logs = prediction_logs(spark, sf_dir)
    auc = cv.roc_auc(logs, "fraud_probability", "is_fraud", by=["model_type"])
    ap = cv.average_precision(logs, "fraud_probability", "is_fraud", by=["model_type"])
    return auc.join(ap, "model_type")


@register("W15", with_ctes("""SELECT arg_min(model_type, (-round(roc_auc, 12), model_type)) AS best_model_type,
    round(max(roc_auc), 9) AS best_roc_auc FROM runs WHERE roc_auc IS NOT NULL""", "logs", extra=[_RUNS_CTE]))
def q_w15(spark, sf_dir):
    """Best model by ROC-AUC (ties -> first by name; failed runs skipped)."""
    runs = runs_table(spark, sf_dir).withColumn("roc_auc", F.round("roc_auc", 12))
    return wn.best_by(runs, "model_type", "roc_auc").select("best_model_type", r9("best_roc_auc"))


@register("W18", with_ctes("SELECT metric, " + ", ".join(
    f"round(max(value) FILTER (WHERE model_type = '{m}'), 9) AS {m}" for m in MODEL_TYPES) +
    """ FROM (SELECT model_type, 'roc_auc' AS metric, roc_auc AS value FROM runs
            UNION ALL SELECT model_type, 'average_precision', average_precision FROM runs) GROUP BY metric""",
    "logs", extra=[_RUNS_CTE]))
def q_w18(spark, sf_dir):
    """Comparison table: metrics as rows, models as columns."""
    t = wn.comparison_table(runs_table(spark, sf_dir), "model_type", ["roc_auc", "average_precision"], MODEL_TYPES)
    return t.select("metric", *[r9(m) for m in MODEL_TYPES])
