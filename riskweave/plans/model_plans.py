"""Registered queries: model jobs (L01-L09), cross-validation (M08),
importance ranking (M09) and top-k contributions (W17)."""

from __future__ import annotations

import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.operators import curves as cv
from riskweave.operators import models as ml
from riskweave.operators import reports as rp
from riskweave.operators.registry import newest_model, save_model_run
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.plans.split_plans import split_tx
from riskweave.plans.window_plans import runs_table
from riskweave.session import kept, scratch_path
from riskweave.sources.tables import MODEL_TYPES, prediction_logs, with_ctes
from riskweave.streaming import jobs
from riskweave.streaming import runtime as rt

SEED = 42


def kept_split(spark, sf_dir):
    """The transactions with their split, worked out once and written."""
    return kept(split_tx(spark, sf_dir), "split")


def fitted_frames(spark, sf_dir, sp=None):
    """(stats, train, val, test): the split (given, or made) and the statistics, fitted on train only, are worked out once and written."""
    sp = kept_split(spark, sf_dir) if sp is None else sp
    stats = kept(fe.fit_feature_stats(sp.where(F.col("split") == "train")), "stats")
    eng = fe.engineer(sp, stats)
    return (stats, eng.where(F.col("split") == "train"), eng.where(F.col("split") == "val"),
            eng.where(F.col("split") == "test"))


def frames(spark, sf_dir):
    """Train/val/test of all transactions; features use statistics fitted on train only."""
    return fitted_frames(spark, sf_dir)[1:]


@register("L01")
def q_l01(spark, sf_dir):
    """Logistic regression (balanced weights, C=1, unscaled): coefficients per feature."""
    train, _, _ = frames(spark, sf_dir)
    model = ml.fit(train, "logistic_regression", seed=SEED)
    lr = model.stages[-1]
    rows = list(zip(fe.FEATURE_COLUMNS, lr.coefficients.toArray().tolist())) + [("intercept", lr.intercept)]
    # one row per model feature: a fixed, schema-sized table
    return spark.createDataFrame(rows, "feature string, coefficient double")


@register("L02")
def q_l02(spark, sf_dir):
    """Random forest (100 trees, depth 10, balanced): validation probabilities."""
    train, val, _ = frames(spark, sf_dir)
    model = ml.fit(train, "random_forest", seed=SEED)
    return ml.score(model, val).select("transaction_id", "fraud_probability")


@register("L03")
def q_l03(spark, sf_dir):
    """Second-order boosted trees (100 rounds, depth 6, lr 0.1, positive weight, L2 on leaves): validation probabilities."""
    train, val, _ = frames(spark, sf_dir)
    model = ml.fit(train, "xgboost", seed=SEED)
    return ml.score(model, val).select("transaction_id", "fraud_probability")


def train_job(spark, sf_dir, kind: str = "logistic_regression", fitted=None):
    """Split -> fit stats -> features -> fit -> val metrics -> tuned threshold -> save + metadata.

    ``fitted``: the ``fitted_frames`` of the dataset, where the caller has them."""
    stats, train, val, _ = fitted or fitted_frames(spark, sf_dir)
    began = time.perf_counter()
    model = ml.fit(train, kind, seed=SEED)
    seconds, train_rows = time.perf_counter() - began, train.count()
    metrics = ml.evaluate(ml.score(model, val))
    # one entry per model feature: schema-sized
    weights = [F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance"))
               for n, v in ml.feature_importances(model, fe.FEATURE_COLUMNS)]
    path = scratch_path(spark, f"model-{kind}-{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    meta = metrics.select(F.lit(kind).alias("model_type"), F.lit(path).alias("model_path"),
                          "roc_auc", "average_precision", "threshold", "precision", "recall", "target_reached",
                          F.lit(SEED).alias("seed"), F.lit(train_rows).alias("train_rows"),
                          F.lit(0.95).alias("target_precision"), F.array(*[F.lit(c) for c in fe.FEATURE_COLUMNS]).alias("features"),
                          F.array(*weights).alias("importances"), F.lit(seconds).alias("training_seconds"))
    meta.write.parquet(_meta_path(path))
    stats.write.parquet(_stats_path(path))
    save_model_run(spark, sf_dir, kind, path)
    return spark.read.schema(meta.schema).parquet(_meta_path(path))


def _meta_path(model_path: str) -> str:
    """The one-row metadata table saved beside a model."""
    return f"{model_path}.meta"


def _stats_path(model_path: str) -> str:
    """The one-row statistics that a model's features were made with."""
    return f"{model_path}.stats"


@register("L04")
def q_l04(spark, sf_dir):
    """Train job: one metadata row (metrics, tuned threshold, saved model path)."""
    return train_job(spark, sf_dir)


@register("L05")
def q_l05(spark, sf_dir):
    """Train every model family and compare, the best by each metric marked; a failing fit is recorded, not fatal."""
    rows, fitted = None, None
    for kind in MODEL_TYPES:
        try:
            fitted = fitted or fitted_frames(spark, sf_dir)  # of all families
            m = train_job(spark, sf_dir, kind, fitted).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:  # recorded as a failed run
            m = spark.createDataFrame([(kind, str(e))], "model_type string, error string")
        rows = m if rows is None else rows.unionByName(m, allowMissingColumns=True)
    best = lambda metric: F.row_number().over(  # noqa: E731  a row per model family
        Window.orderBy(F.col(metric).desc_nulls_last(), "model_type")) == 1
    return rows.withColumns({"best_by_roc_auc": best("roc_auc"), "best_by_average_precision": best("average_precision")})


def saved_path(spark, sf_dir, kind: str = "logistic_regression", fitted=None) -> str:
    """The newest saved model of the dataset, by the registry's table; trained first if there is none."""
    return newest_model(spark, sf_dir, kind) or train_job(spark, sf_dir, kind, fitted).first()["model_path"]


def _saved_model(spark, sf_dir, fitted=None):
    return load_saved(spark, saved_path(spark, sf_dir, fitted=fitted))


def load_saved(spark, path: str):
    """(model, threshold) of a saved model, from its folder and the metadata beside it."""
    return PipelineModel.load(path), spark.read.parquet(_meta_path(path)).first()["threshold"]


@register("L06")
def q_l06(spark, sf_dir):
    """Batch scoring of the test split with the saved model and its tuned threshold."""
    fitted = fitted_frames(spark, sf_dir)
    model, thr = _saved_model(spark, sf_dir, fitted)
    return ml.score(model, fitted[-1], thr).select("transaction_id", "fraud_probability", "fraud_label", "threshold_used")


@register("L07")
def q_l07(spark, sf_dir):
    """Evaluate job on the test split: metrics, tuned-threshold confusion counts."""
    fitted = fitted_frames(spark, sf_dir)
    model, thr = _saved_model(spark, sf_dir, fitted)
    scored = ml.score(model, fitted[-1], thr)
    conf = rp.confusion_counts(scored, "is_fraud", "fraud_label")
    return ml.evaluate_test(scored).crossJoin(conf)


def scored_test(spark, sf_dir):
    """The test split scored by the newest saved model with its tuned threshold, written once for the tables made of it."""
    fitted = fitted_frames(spark, sf_dir)
    model, thr = _saved_model(spark, sf_dir, fitted)
    return kept(ml.score(model, fitted[-1], thr).select("transaction_id", ml.LABEL, ml.PROB, "fraud_label"), "scored-test")


@register("L07R")
def q_l07r(spark, sf_dir):
    """Evaluate job: classification report of the saved model on the test split at its tuned threshold."""
    return rp.classification_report(rp.confusion_counts(scored_test(spark, sf_dir), ml.LABEL, "fraud_label"))


@register("L07P")
def q_l07p(spark, sf_dir):
    """Evaluate job: precision-recall curve of the saved model on the test split."""
    return cv.pr_curve(scored_test(spark, sf_dir), ml.PROB, ml.LABEL)


@register("L07C")
def q_l07c(spark, sf_dir):
    """Evaluate job: ROC curve of the saved model on the test split."""
    return cv.roc_curve(scored_test(spark, sf_dir), ml.PROB, ml.LABEL)


# Illustrative linear model for the contribution report.
COEFS = {"amount": 0.004, "hour": -0.02, "device_score": -2.0, "country_risk": 0.3}
INTERCEPT = -1.5


def _contrib_sql() -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in COEFS)
    base = " + ".join([repr(INTERCEPT)] + [f"{v!r} * m_{c}" for c, v in COEFS.items()])
    entries = " UNION ALL ".join(
        f"SELECT transaction_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {v!r} * ({c} - m_{c}) AS contribution, "
        f"{base} AS base_value FROM tx, mm" for c, v in COEFS.items())
    return f"""mm AS (SELECT {means} FROM tx), ce AS ({entries})"""


@register("L08", with_ctes("""SELECT transaction_id, CAST(rank AS INTEGER) AS rank, feature, value,
    round(contribution, 9) AS contribution, round(base_value, 9) AS base_value FROM (
      SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, feature) AS rank FROM ce)
    WHERE rank <= 10""", "tx", extra=[_contrib_sql()]))
def q_l08(spark, sf_dir):
    """Linear contributions coef*(x - mean) per transaction, ranked by magnitude (top 10)."""
    from riskweave.sources.tables import transactions
    out = ml.linear_contributions(transactions(spark, sf_dir), COEFS, INTERCEPT, "transaction_id", k=10)
    return out.select("transaction_id", "rank", "feature", "value", r9("contribution"), r9("base_value"))


@register("W17", with_ctes("""SELECT transaction_id, feature, round(contribution, 9) AS contribution FROM (
      SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, feature) AS rank FROM ce)
    WHERE rank <= 2""", "tx", extra=[_contrib_sql()]))
def q_w17(spark, sf_dir):
    """Top-k (k=2) contributions by absolute value per transaction."""
    from riskweave.sources.tables import transactions
    out = ml.linear_contributions(transactions(spark, sf_dir), COEFS, INTERCEPT, "transaction_id", k=2)
    return out.select("transaction_id", "feature", r9("contribution"))


@register("M08")
def q_m08(spark, sf_dir):
    """5-fold stratified cross-validation of logistic regression: per-fold AUC, mean and population std."""
    train, _, _ = frames(spark, sf_dir)
    scores = ml.cross_validate(train, "logistic_regression", k=5, seed=SEED)
    return scores.crossJoin(ml.summarize_cv(scores))


@register("M09")
def q_m09(spark, sf_dir):
    """Feature-importance ranking of the random forest."""
    train, _, _ = frames(spark, sf_dir)
    model = ml.fit(train, "random_forest", seed=SEED)
    ranked = ml.feature_importances(model, fe.FEATURE_COLUMNS)
    # one row per model feature: schema-sized
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(ranked)],
                                 "rank int, feature string, importance double")


_REG_RUNS = """cg2 AS (SELECT model_type, model_version, fraud_probability AS s, CAST(sum(is_fraud) AS DOUBLE) AS pos,
                       CAST(count(*) AS DOUBLE) AS n FROM logs GROUP BY 1, 2, 3),
cc2 AS (SELECT model_type, model_version, pos, n,
          sum(pos) OVER (PARTITION BY model_type, model_version ORDER BY s DESC) AS cum_pos,
          sum(n) OVER (PARTITION BY model_type, model_version ORDER BY s DESC) AS cum_n,
          sum(pos) OVER (PARTITION BY model_type, model_version) AS total_pos,
          sum(n) OVER (PARTITION BY model_type, model_version) AS total_n FROM cg2),
reg AS (SELECT model_type AS name, model_version AS version,
   round(sum(pos * ((total_n - total_pos) - (cum_n - cum_pos) + 0.5 * (n - pos))) / (max(total_pos) * max(total_n - total_pos)), 12) AS roc_auc
   FROM cc2 GROUP BY 1, 2),
ev AS (SELECT name, version, 'Staging' AS stage, TIMESTAMP '2024-02-01' AS event_at FROM reg
         WHERE version = (SELECT max(version) FROM reg r2 WHERE r2.name = reg.name)
       UNION ALL SELECT arg_min(name, (-roc_auc, name, version)), arg_min(version, (-roc_auc, name, version)),
         'Production', TIMESTAMP '2024-02-02' FROM reg)"""


@register("L09", with_ctes("""SELECT reg.name, reg.version, round(reg.roc_auc, 9) AS roc_auc,
    COALESCE((SELECT arg_max(stage, event_at) FROM ev WHERE ev.name = reg.name AND ev.version = reg.version), 'None')
      AS current_stage FROM reg""", "logs", extra=[_REG_RUNS]))
def q_l09(spark, sf_dir):
    """Run registry as tables: runs, stage events, current stage per version."""
    from riskweave.operators.registry import current_stages, promote_best, promote_newest
    logs = prediction_logs(spark, sf_dir)
    runs = cv.roc_auc(logs, "fraud_probability", "is_fraud", by=["model_type", "model_version"]).select(
        F.col("model_type").alias("name"), F.col("model_version").alias("version"),
        F.round("roc_auc", 12).alias("roc_auc"))
    events = promote_newest(runs, "Staging", "2024-02-01").unionByName(
        promote_best(runs, "roc_auc", "Production", "2024-02-02"))
    cur = current_stages(runs, events)
    return cur.select("name", "version", r9("roc_auc"), "current_stage")


@register("S11")
def q_s11(spark, sf_dir):
    """Model artifact save and load: the reloaded pipeline scores the validation split."""
    fitted = fitted_frames(spark, sf_dir)
    model, thr = _saved_model(spark, sf_dir, fitted)
    return ml.score(model, fitted[2], thr).select("transaction_id", "fraud_probability", "fraud_label")


@register("T01M")
def q_t01m(spark, sf_dir):
    """Streaming scoring with the trained model: the registry's newest pipeline, its own statistics
    and threshold; requests that fail validation go to a quarantine table with their reasons."""
    sp = kept_split(spark, sf_dir)
    path = newest_model(spark, sf_dir, "logistic_regression") or saved_path(spark, sf_dir, fitted=fitted_frames(spark, sf_dir, sp))
    model, threshold = load_saved(spark, path)
    stats = spark.read.schema(", ".join(f"{c} double" for c in fe.STAT_COLUMNS)).parquet(_stats_path(path))
    base = scratch_path(spark, f"t01m-{uuid.uuid4().hex[:12]}")
    tx = sp.where(F.col("split") == "test").drop("split")
    files = rt.files_per_chunk(spark)
    rt.stage_files(tx, f"{base}/source", "created_at", chunks=3, files=files)
    step = jobs.model_scoring_sink(model, stats, threshold, f"{base}/scored", f"{base}/quarantine")
    stream = rt.read_stream(spark, f"{base}/source", tx.schema, files)
    rt.run_available_now(stream.writeStream.foreachBatch(step), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/scored").select("transaction_id", "fraud_probability", "fraud_label", "threshold_used")
