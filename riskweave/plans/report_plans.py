"""Registered queries: report aggregations A01-A22 over the log views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.operators import reports as rp
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.sources.tables import prediction_logs, with_ctes


@register("A01", with_ctes("""SELECT hour, count(*) AS total_transactions,
    CAST(sum(CASE WHEN fraud_label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_count,
    round(avg(fraud_probability), 9) AS avg_fraud_prob
    FROM logs GROUP BY hour ORDER BY hour""", "logs"))
def q_a01(spark, sf_dir):
    """Fraud rate by hour of day."""
    out = rp.fraud_rate_by_hour(prediction_logs(spark, sf_dir))
    return out.withColumn("avg_fraud_prob", r9("avg_fraud_prob"))


@register("A02", with_ctes("""SELECT model_type, count(*) AS total_predictions,
    round(avg(CASE WHEN fraud_label = 1 THEN fraud_probability END), 9) AS avg_prob_fraud,
    round(avg(CASE WHEN fraud_label = 0 THEN fraud_probability END), 9) AS avg_prob_legit,
    round(avg(processing_time_ms), 9) AS avg_processing_time
    FROM logs GROUP BY model_type""", "logs"))
def q_a02(spark, sf_dir):
    """Model performance summary per model type."""
    out = rp.model_performance_summary(prediction_logs(spark, sf_dir))
    return out.select("model_type", "total_predictions", r9("avg_prob_fraud"), r9("avg_prob_legit"),
                      r9("avg_processing_time"))


@register("A03", with_ctes("""SELECT count(*) AS total, CAST(sum(fraud_label) AS BIGINT) AS fraud_count,
    round(avg(fraud_label), 9) AS fraud_rate, round(avg(fraud_probability), 9) AS avg_probability
    FROM logs""", "logs"))
def q_a03(spark, sf_dir):
    """Batch prediction summary."""
    out = rp.prediction_summary(prediction_logs(spark, sf_dir))
    return out.select("total", "fraud_count", r9("fraud_rate"), r9("avg_probability"))


_CONF_SQL = """count(*) FILTER (WHERE is_fraud = 0 AND fraud_label = 0) AS tn,
    count(*) FILTER (WHERE is_fraud = 0 AND fraud_label = 1) AS fp,
    count(*) FILTER (WHERE is_fraud = 1 AND fraud_label = 0) AS fn,
    count(*) FILTER (WHERE is_fraud = 1 AND fraud_label = 1) AS tp"""


@register("A07", with_ctes(f"SELECT {_CONF_SQL} FROM logs", "logs"))
def q_a07(spark, sf_dir):
    """Confusion matrix of the rule label against the true label."""
    return rp.confusion_counts(prediction_logs(spark, sf_dir), "is_fraud", "fraud_label")


def _div(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


_P0, _R0 = _div("tn", "tn + fn"), _div("tn", "tn + fp")
_P1, _R1 = _div("tp", "tp + fp"), _div("tp", "tp + fn")
_F0, _F1 = _div(f"2 * {_P0} * {_R0}", f"{_P0} + {_R0}"), _div(f"2 * {_P1} * {_R1}", f"{_P1} + {_R1}")
_N = "(tn + fp + fn + tp)"
_ACC = _div("tp + tn", _N)


@register("A08", with_ctes(f"""SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall,
    round(f1_score, 9) AS f1_score, CAST(support AS BIGINT) AS support FROM (
    SELECT '0' AS label, {_P0} AS precision, {_R0} AS recall, {_F0} AS f1_score, tn + fp AS support FROM c
    UNION ALL SELECT '1', {_P1}, {_R1}, {_F1}, tp + fn FROM c
    UNION ALL SELECT 'accuracy', {_ACC}, {_ACC}, {_ACC}, {_N} FROM c
    UNION ALL SELECT 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2, {_N} FROM c
    UNION ALL SELECT 'weighted avg', {_div(f"{_P0} * (tn + fp) + {_P1} * (tp + fn)", _N)},
        {_div(f"{_R0} * (tn + fp) + {_R1} * (tp + fn)", _N)}, {_div(f"{_F0} * (tn + fp) + {_F1} * (tp + fn)", _N)},
        {_N} FROM c)""", "logs", extra=[f"c AS (SELECT {_CONF_SQL} FROM logs)"]))
def q_a08(spark, sf_dir):
    """Classification report (per class, accuracy, macro and weighted averages)."""
    conf = rp.confusion_counts(prediction_logs(spark, sf_dir), "is_fraud", "fraud_label")
    rep = rp.classification_report(conf)
    return rep.select("label", r9("precision"), r9("recall"), r9("f1_score"), "support")


@register("A09", with_ctes("""SELECT round(count(*) / (2 * count(*) FILTER (WHERE is_fraud = 0)), 9) AS weight_0,
    round(count(*) / (2 * count(*) FILTER (WHERE is_fraud = 1)), 9) AS weight_1,
    round(count(*) FILTER (WHERE is_fraud = 0) / greatest(count(*) FILTER (WHERE is_fraud = 1), 1), 9) AS scale_pos_weight
    FROM tx""", "tx"))
def q_a09(spark, sf_dir):
    """Balanced class weights and the positive-class ratio."""
    from riskweave.sources.tables import transactions
    w = rp.class_weights(transactions(spark, sf_dir), "is_fraud")
    return w.select(r9("weight_0"), r9("weight_1"), r9("scale_pos_weight"))


@register("A13", with_ctes("""SELECT 'requests_total' AS metric, endpoint AS label1, 'POST' AS label2,
      CAST(status_code AS VARCHAR) AS label3, count(*) AS value FROM logs GROUP BY endpoint, status_code
    UNION ALL SELECT 'predictions_total', model_type, CAST(fraud_label AS VARCHAR), '', count(*) FROM logs
      GROUP BY model_type, fraud_label
    UNION ALL SELECT 'fraud_positives_total', model_type, '', '', count(*) FROM logs WHERE fraud_label = 1
      GROUP BY model_type""", "logs"))
def q_a13(spark, sf_dir):
    """Request / prediction / positive counters."""
    return rp.request_counters(prediction_logs(spark, sf_dir))


_BOUNDS = rp.LATENCY_BUCKETS
_HIST_SQL = "hist AS (" + " UNION ALL ".join(
    [f"SELECT model_type, {b!r}::DOUBLE AS le, count(*) FILTER (WHERE processing_time_ms / 1000 <= {b!r}) AS cumulative_count, "
     f"count(*) AS count, sum(processing_time_ms / 1000) AS sum FROM logs GROUP BY model_type" for b in _BOUNDS] +
    ["SELECT model_type, 'inf'::DOUBLE, count(*), count(*), sum(processing_time_ms / 1000) FROM logs GROUP BY model_type"]) + ")"


@register("A14", with_ctes("""SELECT model_type, le, cumulative_count, count, round(sum, 9) AS sum FROM hist""",
                           "logs", extra=[_HIST_SQL]))
def q_a14(spark, sf_dir):
    """Cumulative latency histogram per model (fixed buckets, +Inf, sum, count)."""
    logs = prediction_logs(spark, sf_dir).withColumn("latency_s", F.col("processing_time_ms") / 1000)
    h = rp.latency_histogram(logs, "latency_s", by=["model_type"])
    return h.select("model_type", "le", "cumulative_count", "count", r9("sum"))


def _hq_sql(q: float) -> str:
    return f"""SELECT model_type, {q!r}::DOUBLE AS quantile, CASE
        WHEN total = 0 THEN NULL
        WHEN le = 'inf'::DOUBLE THEN {_BOUNDS[-1]!r}
        WHEN cumulative_count = prev_cnt THEN le
        ELSE prev_le + (le - prev_le) * ({q!r} * total - prev_cnt) / (cumulative_count - prev_cnt) END AS value
      FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY le) AS rn FROM hb
            WHERE cumulative_count >= {q!r} * total) WHERE rn = 1"""


_HB_SQL = """hb AS (SELECT model_type, le, cumulative_count,
    COALESCE(lag(le) OVER (PARTITION BY model_type ORDER BY le), 0.0) AS prev_le,
    COALESCE(lag(cumulative_count) OVER (PARTITION BY model_type ORDER BY le), 0) AS prev_cnt,
    max(cumulative_count) OVER (PARTITION BY model_type) AS total FROM hist)"""


@register("A15", with_ctes("SELECT model_type, quantile, round(value, 9) AS value FROM (" +
                           " UNION ALL ".join(_hq_sql(q) for q in (0.5, 0.95, 0.99)) + ")",
                           "logs", extra=[_HIST_SQL, _HB_SQL]))
def q_a15(spark, sf_dir):
    """Latency quantiles (.5/.95/.99) interpolated from the histogram buckets."""
    logs = prediction_logs(spark, sf_dir).withColumn("latency_s", F.col("processing_time_ms") / 1000)
    h = rp.latency_histogram(logs, "latency_s", by=["model_type"])
    out = rp.histogram_quantiles(h, (0.5, 0.95, 0.99), by=["model_type"])
    return out.select("model_type", "quantile", r9("value"))


_KEY_SQL = "md5(concat_ws('|', " + ", ".join(
    f"'{c}', CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)" for c in ("amount", "country_risk", "device_score", "hour")) + "))"


@register("A16", with_ctes(f"""SELECT model_type, count(*) - count(DISTINCT {_KEY_SQL}) AS hits,
    count(DISTINCT {_KEY_SQL}) AS misses,
    round((count(*) - count(DISTINCT {_KEY_SQL})) / greatest(count(*), 1), 9) AS hit_rate
    FROM logs GROUP BY model_type""", "logs"))
def q_a16(spark, sf_dir):
    """Score-reuse hit rate per model: repeated canonical feature keys are hits."""
    key = fe.feature_key("amount", "country_risk", "device_score", "hour")
    out = rp.reuse_rate(prediction_logs(spark, sf_dir), key, by=["model_type"])
    return out.select("model_type", "hits", "misses", r9("hit_rate"))


# Stand-in compute cost per millisecond of scoring.
COST_PER_MS = 0.00001


@register("A18", with_ctes(f"""SELECT CAST(created_at AS DATE) AS day, endpoint AS service, count(*) AS requests,
    round(sum(processing_time_ms * {COST_PER_MS}), 9) AS total_cost,
    round(sum(processing_time_ms * {COST_PER_MS}) / count(*) * 1000, 9) AS cost_per_1000
    FROM logs GROUP BY 1, 2""", "logs"))
def q_a18(spark, sf_dir):
    """Daily requests and cost per service, cost per 1000 predictions."""
    out = rp.daily_cost(prediction_logs(spark, sf_dir), "created_at", "endpoint",
                        F.col("processing_time_ms") * F.lit(COST_PER_MS))
    return out.select("day", "service", "requests", r9("total_cost"), r9("cost_per_1000"))


@register("A21", with_ctes("""SELECT CASE WHEN fraud_probability < 0 THEN 0 WHEN fraud_probability >= 1 THEN 11
      ELSE CAST(floor(fraud_probability * 10) AS INTEGER) + 1 END AS bucket, count(*) AS n FROM logs GROUP BY 1""",
                           "logs"))
def q_a21(spark, sf_dir):
    """Distribution of predicted probabilities in 10 equal-width buckets."""
    return rp.confidence_histogram(prediction_logs(spark, sf_dir), "fraud_probability")


@register("A22", with_ctes(f"""SELECT model_version, round({_ACC}, 9) AS accuracy, round({_P1}, 9) AS precision,
    round({_R1}, 9) AS recall, round({_F1}, 9) AS f1 FROM (SELECT model_version, {_CONF_SQL} FROM logs GROUP BY model_version)""",
                           "logs"))
def q_a22(spark, sf_dir):
    """Model quality by version: accuracy, precision, recall, f1."""
    q = rp.model_quality(prediction_logs(spark, sf_dir), "is_fraud", "fraud_label", ["model_version"])
    return q.select("model_version", r9("accuracy"), r9("precision"), r9("recall"), r9("f1"))
