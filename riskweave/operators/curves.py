"""Tie-aware ranking metrics (M01-M07) over (score, label) rows.

Everything starts from one table: per distinct score, positives and rows,
plus running sums in descending score order (``prefix_sums``). Ties are
collapsed into one threshold exactly like the step curves of common ML
libraries. The final metrics are global aggregates over that table, which
Spark computes with partial aggregation (no single-task sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranking import prefix_sums


def score_table(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: pos, n, cum_pos (tp), cum_n (predicted positive), totals."""
    base = df.where(F.col(score).isNotNull())
    t = prefix_sums(base, score, {"pos": F.col(label).cast("long"), "n": F.lit(1).cast("long")},
                    by=by, descending=True)
    return t.withColumnRenamed(score, "threshold")


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact rank-sum AUC with half credit for ties."""
    return auc_of_table(score_table(df, score, label, by), by)


def auc_of_table(t: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC from a ``score_table``."""
    neg_total = F.col("total_n") - F.col("total_pos")
    neg_below = neg_total - (F.col("cum_n") - F.col("cum_pos"))
    # products of two counts pass a long on large tables: as doubles
    term = F.col("pos").cast("double") * (neg_below + 0.5 * (F.col("n") - F.col("pos")))
    pairs = F.max("total_pos").cast("double") * F.max(neg_total)
    # a single class has no AUC: NULL instead of a division error
    return t.groupBy(*by).agg(F.try_divide(F.sum(term), pairs).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision, sum over thresholds of dRecall * precision."""
    return precision_of_table(score_table(df, score, label, by), by)


def precision_of_table(t: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision from a ``score_table``."""
    term = F.try_divide(F.col("pos"), F.col("total_pos")) * (F.col("cum_pos") / F.col("cum_n"))
    return t.groupBy(*by).agg(F.sum(term).alias("average_precision"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall per threshold plus the (precision 1, recall 0) end point."""
    return pr_of_table(score_table(df, score, label))


def pr_of_table(t: DataFrame) -> DataFrame:
    """Precision-recall curve from a ``score_table``."""
    recall = F.when(F.col("total_pos") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("total_pos"))
    pts = t.select(F.col("threshold").cast("double"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                   recall.alias("recall"))
    end = pts.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Fpr, tpr per threshold (all distinct thresholds) plus the (0, 0) start point."""
    t = score_table(df, score, label)
    neg_total = F.col("total_n") - F.col("total_pos")
    pts = t.select(F.col("threshold").cast("double"),
                   F.try_divide(F.col("cum_n") - F.col("cum_pos"), neg_total).alias("fpr"),
                   F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    start = pts.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def _best_at_precision(curve: DataFrame, target: float) -> DataFrame:
    q = curve.where(F.col("threshold").isNotNull() & (F.col("precision") >= F.lit(target)))
    best = F.min_by(F.struct("threshold", "precision", "recall"),
                    F.struct(-F.col("recall"), F.col("threshold")))
    return q.agg(best.alias("b"), F.count(F.lit(1)).alias("n_qualifying"))


def tune_threshold(df: DataFrame, score: str, label: str, target_precision: float = 0.95,
                   fallback: float = 0.5) -> DataFrame:
    """Among thresholds with precision >= target, the highest recall
    (lowest threshold on ties). Without any, threshold = fallback and the
    metrics are those of the lowest curve threshold >= fallback."""
    return tuned_on_curve(pr_curve(df, score, label), target_precision, fallback)


def tuned_on_curve(curve: DataFrame, target_precision: float, fallback: float = 0.5) -> DataFrame:
    """``tune_threshold`` from a precision-recall curve."""
    best = _best_at_precision(curve, target_precision)
    at_fb = curve.where(F.col("threshold") >= F.lit(fallback)).agg(
        F.min_by(F.struct("precision", "recall"), F.col("threshold")).alias("fb"))
    j = best.crossJoin(at_fb)
    found = F.col("n_qualifying") > 0
    return j.select(
        F.when(found, F.col("b.threshold")).otherwise(F.lit(fallback)).alias("threshold"),
        F.when(found, F.col("b.precision")).otherwise(F.col("fb.precision")).alias("precision"),
        F.when(found, F.col("b.recall")).otherwise(F.col("fb.recall")).alias("recall"),
        found.alias("target_reached"))


def recall_at_precision(df: DataFrame, score: str, label: str, target_precision: float) -> DataFrame:
    """Threshold and recall at the target precision; NULL when unreachable."""
    return recall_on_curve(pr_curve(df, score, label), target_precision)


def recall_on_curve(curve: DataFrame, target_precision: float) -> DataFrame:
    """``recall_at_precision`` from a precision-recall curve."""
    best = _best_at_precision(curve, target_precision)
    return best.select(F.col("b.threshold").alias("threshold_at_target"),
                       F.col("b.recall").alias("recall_at_target"))


def apply_threshold(df: DataFrame, score: str, threshold, out: str = "predicted_label") -> DataFrame:
    """label = score >= threshold (threshold: number or column)."""
    thr = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    return df.withColumn(out, F.when(F.col(score) >= thr, 1).otherwise(0))
