"""Model jobs on MLlib and ``operators.boosting``.

Training data stays distributed: features are column expressions, the
vector is assembled by ``VectorAssembler``, class weights come from a
one-row aggregate, and every metric uses the exact tie-aware curve kernel on
the scored DataFrame (never a collected array). Loops over models or folds
are driver loops of distributed jobs, bounded by the number of models/folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.operators import curves as cv
from riskweave.operators.boosting import fit_boosted
from riskweave.operators import reports as rp

LABEL = "is_fraud"
WEIGHT = "class_weight"
PROB = "fraud_probability"


def with_balanced_weights(df: DataFrame, label: str = LABEL, scheme: str = "balanced") -> DataFrame:
    """A09 applied: per-row weight n/(2*n_c) (balanced) or neg/pos on positives (boosting)."""
    w = rp.class_weights(df, label)
    j = df.crossJoin(F.broadcast(w))
    if scheme == "balanced":
        weight = F.when(F.col(label) == 1, F.col("weight_1")).otherwise(F.col("weight_0"))
    else:
        weight = F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0))
    return j.withColumn(WEIGHT, weight).drop("weight_0", "weight_1", "scale_pos_weight")


def estimator(kind: str, n_rows: int | None = None, seed: int = 42):
    """L01 and L02 with the reference's settings mapped onto MLlib (L03 is ``operators.boosting``)."""
    if kind == "logistic_regression":
        # C=1 on a weighted sum of losses == regParam 1/sum(w) on MLlib's weighted mean loss;
        # balanced weights sum to n.
        return LogisticRegression(labelCol=LABEL, weightCol=WEIGHT, maxIter=1000, elasticNetParam=0.0,
                                  regParam=1.0 / max(1, n_rows or 1), standardization=False)
    if kind == "random_forest":
        # Each row keeps its node in every tree, so a level doesn't walk all trees from their roots again: the same trees
        # in less time. The nodes follow from cached rows by one map per level, so no checkpoint of them is written.
        return RandomForestClassifier(labelCol=LABEL, weightCol=WEIGHT, numTrees=100, maxDepth=10,
                                      featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, checkpointInterval=-1)
    raise ValueError(f"unknown model kind {kind}")


def weight_scheme(kind: str) -> str:
    return "boosting" if kind == "xgboost" else "balanced"


def fit(train: DataFrame, kind: str, feature_cols: Sequence[str] = fe.FEATURE_COLUMNS, seed: int = 42) -> PipelineModel:
    """Fit one model family. The weighted training frame is persisted for the
    duration of the (eager) fit: MLlib makes several passes over its input
    before and during optimisation, and each would otherwise recompute the
    split and feature lineage."""
    if kind == "xgboost":  # keeps binned rows of its own
        return PipelineModel(stages=[fit_boosted(with_balanced_weights(train, scheme=weight_scheme(kind)),
                                                 feature_cols, LABEL, WEIGHT)])
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    weighted = with_balanced_weights(train, scheme=weight_scheme(kind))
    data = assembler.transform(weighted).select("features", LABEL, WEIGHT).persist()
    try:
        n = data.count() if kind == "logistic_regression" else None
        return PipelineModel(stages=[assembler, estimator(kind, n, seed).fit(data)])
    finally:
        data.unpersist()


def score(model: PipelineModel, df: DataFrame, threshold: float | Column | None = None) -> DataFrame:
    """Probability of the positive class and, given a threshold, the label."""
    out = model.transform(df).withColumn(PROB, vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")
    if threshold is not None:
        thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        out = out.withColumn("fraud_label", (F.col(PROB) >= thr).cast("int")).withColumn("threshold_used", thr)
    return out


def evaluate(scored: DataFrame, target_precision: float = 0.95) -> DataFrame:
    """L04 metrics on validation rows: ROC-AUC, average precision, tuned threshold (one row)."""
    return _metrics(scored, lambda t: cv.tuned_on_curve(cv.pr_of_table(t), target_precision))


def evaluate_test(scored: DataFrame, target_precision: float = 0.95) -> DataFrame:
    """L07 metrics on test rows: ROC-AUC, average precision, and threshold and recall at the
    target precision, null where no threshold reaches it (nothing is tuned on test rows)."""
    return _metrics(scored, lambda t: cv.recall_on_curve(cv.pr_of_table(t), target_precision))


def _metrics(scored: DataFrame, at_threshold) -> DataFrame:
    """One row of metrics. The scored frame's one score table feeds all of them, so both are cached while they run and released after."""
    scored = scored.select(PROB, LABEL).persist()
    table = cv.score_table(scored, PROB, LABEL).persist()
    try:
        out = cv.auc_of_table(table).crossJoin(cv.precision_of_table(table)).crossJoin(at_threshold(table))
        return scored.sparkSession.createDataFrame(out.collect(), out.schema)  # one row
    finally:
        table.unpersist()
        scored.unpersist()


def cross_validate(df: DataFrame, kind: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fit on k-1 folds, AUC on the held-out fold; mean and population std."""
    from riskweave.operators.split import stratified_folds
    folds = stratified_folds(df, LABEL, "transaction_id", k=k, seed=seed).persist()
    aucs = []
    try:
        for f in range(k):
            model = fit(folds.where(F.col("fold") != f), kind, seed=seed)
            aucs.append((cv.roc_auc(score(model, folds.where(F.col("fold") == f)), PROB, LABEL).first()[0], f))
    finally:
        folds.unpersist()
    return df.sparkSession.createDataFrame(aucs, "roc_auc double, fold int")  # k rows


def summarize_cv(fold_scores: DataFrame) -> DataFrame:
    return fold_scores.agg(F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc"))


def feature_importances(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances (or |coefficients| for linear models), sorted descending."""
    stage = model.stages[-1]
    if hasattr(stage, "featureImportances"):
        vals = stage.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in stage.coefficients.toArray().tolist()]
    return sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))


def linear_contributions(df: DataFrame, coefs: dict[str, float], intercept: float, id_col: str,
                         k: int = 10) -> DataFrame:
    """L08 + W17: contribution = coef * (x - frame mean); base = intercept + sum(coef * mean);
    one row per (id, rank) for the k largest |contribution|."""
    from riskweave.operators.windows import top_k_by_abs
    names = list(coefs)
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    j = df.crossJoin(F.broadcast(means))
    base = F.lit(intercept)
    for c in names:
        base = base + F.lit(coefs[c]) * F.col(f"_m_{c}")
    entries = F.array(*[F.struct((F.lit(coefs[c]) * (F.col(c) - F.col(f"_m_{c}"))).alias("contribution"),
                                 F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                        for c in names])
    top = top_k_by_abs(entries, k, "contribution", tie="feature")
    out = j.select(id_col, base.alias("base_value"), F.posexplode(top).alias("pos", "c"))
    return out.select(id_col, (F.col("pos") + 1).alias("rank"), "c.feature", "c.value", "c.contribution",
                      "base_value")
