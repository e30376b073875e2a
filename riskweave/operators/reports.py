"""Report aggregations over prediction/transaction logs.

All are ``groupBy``/``agg`` plans: partial aggregation runs map-side, so the
shuffle carries one row per (task, group) whatever the log size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latency histogram bucket upper bounds in seconds (+Inf implied).
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]


def fraud_rate_by_hour(logs: DataFrame) -> DataFrame:
    """A01."""
    return logs.groupBy("hour").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(F.when(F.col("fraud_label") == 1, 1).otherwise(0)).cast("bigint").alias("fraud_count"),
        F.avg("fraud_probability").alias("avg_fraud_prob"),
    ).orderBy("hour")


def model_performance_summary(logs: DataFrame) -> DataFrame:
    """A02."""
    return logs.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(F.when(F.col("fraud_label") == 1, F.col("fraud_probability"))).alias("avg_prob_fraud"),
        F.avg(F.when(F.col("fraud_label") == 0, F.col("fraud_probability"))).alias("avg_prob_legit"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
    )


def prediction_summary(scored: DataFrame, label: str = "fraud_label", prob: str = "fraud_probability") -> DataFrame:
    """Count, positives, positive rate, mean probability."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(label).cast("bigint").alias("fraud_count"),
        F.avg(label).alias("fraud_rate"),
        F.avg(prob).alias("avg_probability"),
    )


def confusion_counts(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp as four conditional counts."""
    y, p = F.col(label), F.col(pred)
    cnt = lambda c: F.count_if(c).cast("bigint")
    return df.groupBy(*by).agg(
        cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
        cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A08 from A07: per class precision/recall/f1/support plus accuracy,
    macro and weighted averages; zero division -> 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1 = lambda p, r: _safe_div(2 * p * r, p + r)
    s0, s1 = tn + fp, tp + fn
    rows = conf.select(*by, p0.alias("p0"), r0.alias("r0"), p1.alias("p1"), r1.alias("r1"),
                       s0.alias("s0"), s1.alias("s1"), n.alias("n"), (tp + tn).alias("correct"))
    rows = rows.withColumns({"f0": f1(F.col("p0"), F.col("r0")), "f1": f1(F.col("p1"), F.col("r1"))})
    entries = F.array(
        F.struct(F.lit("0").alias("label"), F.col("p0").alias("precision"), F.col("r0").alias("recall"),
                 F.col("f0").alias("f1_score"), F.col("s0").cast("long").alias("support")),
        F.struct(F.lit("1").alias("label"), F.col("p1").alias("precision"), F.col("r1").alias("recall"),
                 F.col("f1").alias("f1_score"), F.col("s1").cast("long").alias("support")),
        F.struct(F.lit("accuracy").alias("label"), _safe_div(F.col("correct"), F.col("n")).alias("precision"),
                 _safe_div(F.col("correct"), F.col("n")).alias("recall"),
                 _safe_div(F.col("correct"), F.col("n")).alias("f1_score"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((F.col("p0") + F.col("p1")) / 2).alias("precision"),
                 ((F.col("r0") + F.col("r1")) / 2).alias("recall"),
                 ((F.col("f0") + F.col("f1")) / 2).alias("f1_score"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 _safe_div(F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1"), F.col("n")).alias("precision"),
                 _safe_div(F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1"), F.col("n")).alias("recall"),
                 _safe_div(F.col("f0") * F.col("s0") + F.col("f1") * F.col("s1"), F.col("n")).alias("f1_score"),
                 F.col("n").cast("long").alias("support")),
    )
    return rows.select(*by, F.inline(entries))


def latency_histogram(df: DataFrame, seconds: str, by: Sequence[str] = (),
                      bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (le), +Inf = count, plus sum and count."""
    x = F.col(seconds)
    aggs = [F.count_if(x <= F.lit(b)).cast("bigint").alias(f"le_{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(x).alias("count"), F.sum(x).alias("sum")]
    wide = df.groupBy(*by).agg(*aggs)
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("cumulative_count"))
                        for i, b in enumerate(bounds)],
                      F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative_count")))
    return wide.select(*by, F.inline(buckets), "count", "sum")


def histogram_quantiles(hist: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles from cumulative buckets, all from one pass over the histogram.

    Rank = q * total; find the first bucket whose cumulative count >= rank;
    interpolate linearly inside it (lower bound 0 for the first bucket).
    If that bucket is +Inf, the answer is the last finite bound.
    """
    g = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "cumulative_count"))).alias("b"))
    # ``b`` holds len(LATENCY_BUCKETS)+1 entries per group: fixed size, not data-sized.
    total = F.element_at(F.col("b"), -1)["cumulative_count"]
    last_finite = F.element_at("b", -2)["le"]

    def value(q: float):
        rank = F.lit(float(q)) * total
        idx = F.array_position(F.transform("b", lambda e: e["cumulative_count"] >= rank), True)
        cur = F.element_at("b", idx.cast("int"))
        prev = F.when(idx > 1, F.element_at("b", (idx - 1).cast("int")))
        lower = F.coalesce(prev["le"], F.lit(0.0))
        prev_cnt = F.coalesce(prev["cumulative_count"], F.lit(0))
        inside = lower + (cur["le"] - lower) * (rank - prev_cnt) / (cur["cumulative_count"] - prev_cnt)
        return (F.when(total == 0, F.lit(None).cast("double"))
                .when(cur["le"] == float("inf"), last_finite)
                .when(cur["cumulative_count"] == prev_cnt, cur["le"])
                .otherwise(inside))

    rows = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), value(q).alias("value")) for q in probs])
    return g.select(*by, F.inline(rows))


def model_quality(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall, f1 per group (zero division -> 0)."""
    c = confusion_counts(df, label, pred, by)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    prec, rec = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    return c.select(*by, _safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def retrain_trigger(drift_report: DataFrame, logs: DataFrame, min_accuracy: float = 0.8,
                    version: str = "model_version") -> DataFrame:
    """Retrain when any feature drifted or the newest version's accuracy < min."""
    changed = drift_report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("data_changed"))
    acc = logs.groupBy(version).agg(
        F.avg(F.when(F.col("fraud_label") == F.col("is_fraud"), 1.0).otherwise(0.0)).alias("accuracy"))
    newest = acc.agg(F.max_by("accuracy", version).alias("accuracy"))
    return changed.crossJoin(newest).select(
        "data_changed", (F.col("accuracy") < F.lit(min_accuracy)).alias("metric_degraded"),
        (F.col("data_changed") | (F.col("accuracy") < F.lit(min_accuracy))).alias("trigger_retraining"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n/(2*n_c) and the boosting ratio neg/max(pos, 1)."""
    n = F.count(F.lit(1))
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(F.try_divide(n, 2 * neg).alias("weight_0"), F.try_divide(n, 2 * pos).alias("weight_1"),
                  (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def request_counters(logs: DataFrame) -> DataFrame:
    """Request, prediction and positive counters as one long table."""
    req = logs.groupBy(F.col("endpoint").alias("label1"), F.lit("POST").alias("label2"),
                       F.col("status_code").cast("string").alias("label3")).agg(F.count(F.lit(1)).alias("value"))
    pred = logs.groupBy(F.col("model_type").alias("label1"), F.col("fraud_label").cast("string").alias("label2"),
                        F.lit("").alias("label3")).agg(F.count(F.lit(1)).alias("value"))
    pos = logs.where(F.col("fraud_label") == 1).groupBy(
        F.col("model_type").alias("label1"), F.lit("").alias("label2"), F.lit("").alias("label3")
    ).agg(F.count(F.lit(1)).alias("value"))
    tag = lambda d, m: d.select(F.lit(m).alias("metric"), "label1", "label2", "label3", "value")
    return tag(req, "requests_total").unionByName(tag(pred, "predictions_total")).unionByName(
        tag(pos, "fraud_positives_total"))


def reuse_rate(df: DataFrame, key: Column, by: Sequence[str] = ()) -> DataFrame:
    """Repeated keys are hits, first sightings misses; hits / max(1, hits + misses)."""
    n = F.count(F.lit(1))
    misses = F.count_distinct(key)
    return df.groupBy(*by).agg((n - misses).alias("hits"), misses.alias("misses"),
                               ((n - misses) / F.greatest(n, F.lit(1))).alias("hit_rate"))


def daily_cost(logs: DataFrame, ts: str, service: str, cost: Column) -> DataFrame:
    """Requests and cost per day and service; cost per 1000 predictions."""
    g = logs.groupBy(F.to_date(F.col(ts)).alias("day"), F.col(service).alias("service")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(cost).alias("total_cost"))
    return g.withColumn("cost_per_1000", F.col("total_cost") / F.col("requests") * 1000)


def confidence_histogram(df: DataFrame, prob: str, buckets: int = 10) -> DataFrame:
    """Equal-width buckets over [0, 1); 0 below, buckets+1 at or above 1."""
    p = F.col(prob)
    b = F.when(p < 0, 0).when(p >= 1, buckets + 1).otherwise(F.floor(p * buckets).cast("int") + 1)
    return df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
