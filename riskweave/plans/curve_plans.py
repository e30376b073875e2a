"""Registered queries: ranking metrics M01-M07 on the scored log (ties included)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import curves as cv
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.sources.tables import prediction_logs, with_ctes

SCORE, LABEL = "fraud_probability", "is_fraud"
TARGET_PRECISION = 0.95
TEST_TARGET_PRECISION = 0.25

_CURVE_CTE = """cg AS (SELECT fraud_probability AS threshold, CAST(sum(is_fraud) AS DOUBLE) AS pos,
                      CAST(count(*) AS DOUBLE) AS n FROM logs WHERE fraud_probability IS NOT NULL GROUP BY 1),
cc AS (SELECT threshold, pos, n, sum(pos) OVER (ORDER BY threshold DESC) AS cum_pos,
              sum(n) OVER (ORDER BY threshold DESC) AS cum_n,
              sum(pos) OVER () AS total_pos, sum(n) OVER () AS total_n FROM cg),
pr AS (SELECT threshold, cum_pos / cum_n AS precision, cum_pos / total_pos AS recall FROM cc)"""


def _sql(body: str) -> str:
    return with_ctes(body, "logs", extra=[_CURVE_CTE])


@register("M01", _sql("""SELECT round(sum(pos * ((total_n - total_pos) - (cum_n - cum_pos) + 0.5 * (n - pos)))
    / (max(total_pos) * max(total_n - total_pos)), 9) AS roc_auc FROM cc"""))
def q_m01(spark, sf_dir):
    """Tie-aware ROC-AUC of the log score against the true label."""
    return cv.roc_auc(prediction_logs(spark, sf_dir), SCORE, LABEL).select(r9("roc_auc"))


@register("M02", _sql("SELECT round(sum(pos / total_pos * (cum_pos / cum_n)), 9) AS average_precision FROM cc"))
def q_m02(spark, sf_dir):
    """PR-AUC as step-wise average precision."""
    return cv.average_precision(prediction_logs(spark, sf_dir), SCORE, LABEL).select(r9("average_precision"))


@register("M03", _sql("""SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr
    UNION ALL SELECT NULL, 1.0, 0.0"""))
def q_m03(spark, sf_dir):
    """Precision-recall curve table."""
    c = cv.pr_curve(prediction_logs(spark, sf_dir), SCORE, LABEL)
    return c.select("threshold", r9("precision"), r9("recall"))


@register("M04", _sql("""SELECT threshold, round((cum_n - cum_pos) / (total_n - total_pos), 9) AS fpr,
    round(cum_pos / total_pos, 9) AS tpr FROM cc UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0"""))
def q_m04(spark, sf_dir):
    """ROC curve table (every distinct threshold)."""
    c = cv.roc_curve(prediction_logs(spark, sf_dir), SCORE, LABEL)
    return c.select("threshold", r9("fpr"), r9("tpr"))


_BEST = f"(SELECT {{col}} FROM pr WHERE precision >= {{t}} ORDER BY recall DESC, threshold LIMIT 1)"
_FB = "(SELECT {col} FROM pr WHERE threshold >= 0.5 ORDER BY threshold LIMIT 1)"


@register("M05", _sql(f"""SELECT CASE WHEN q.n > 0 THEN {_BEST.format(col='threshold', t=TARGET_PRECISION)} ELSE 0.5 END AS threshold,
    round(CASE WHEN q.n > 0 THEN {_BEST.format(col='precision', t=TARGET_PRECISION)} ELSE {_FB.format(col='precision')} END, 9) AS precision,
    round(CASE WHEN q.n > 0 THEN {_BEST.format(col='recall', t=TARGET_PRECISION)} ELSE {_FB.format(col='recall')} END, 9) AS recall,
    q.n > 0 AS target_reached
    FROM (SELECT count(*) AS n FROM pr WHERE precision >= {TARGET_PRECISION}) q"""))
def q_m05(spark, sf_dir):
    """Threshold tuning for precision >= 0.95 with the 0.5 fallback."""
    t = cv.tune_threshold(prediction_logs(spark, sf_dir), SCORE, LABEL, TARGET_PRECISION)
    return t.select("threshold", r9("precision"), r9("recall"), "target_reached")


@register("M06", _sql(f"""SELECT {_BEST.format(col='threshold', t=TEST_TARGET_PRECISION)} AS threshold_at_target,
    round({_BEST.format(col='recall', t=TEST_TARGET_PRECISION)}, 9) AS recall_at_target"""))
def q_m06(spark, sf_dir):
    """Recall at a target precision (NULL when unreachable)."""
    r = cv.recall_at_precision(prediction_logs(spark, sf_dir), SCORE, LABEL, TEST_TARGET_PRECISION)
    return r.select("threshold_at_target", r9("recall_at_target"))


@register("M07", with_ctes("""SELECT prediction_id, CASE WHEN fraud_probability >= 0.2 THEN 1 ELSE 0 END
    AS predicted_label FROM logs""", "logs"))
def q_m07(spark, sf_dir):
    """Apply a decision threshold to every score."""
    out = cv.apply_threshold(prediction_logs(spark, sf_dir), SCORE, 0.2)
    return out.select("prediction_id", "predicted_label")
