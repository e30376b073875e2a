"""Data drift.

All numeric features are unpivoted to ``(feature, value)`` so one grouped
job covers every feature, instead of a driver loop of per-column jobs.

* One table of counts by (feature, value) of both samples serves them all.
* KS (D01): running sums by ``prefix_sums`` partitioned by feature -> max |ECDF_ref - ECDF_cur|.
* PSI (D02): reference decile edges from exact distributed quantiles;
  each value's bin = number of edges <= value (last bin closed); values
  outside the reference range stay in the denominator only.
* Categorical PSI (D03): full outer join of two normalised value counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranking import exact_quantiles, prefix_sums

EPS = 0.0001
DEFAULT_THRESHOLD = 0.1
ROLLBACK_THRESHOLD = 0.2
PSI_PROBS = [i / 10 for i in range(11)]


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric ``cols`` to (keep..., feature, value double), nulls dropped."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    long = casted.unpivot(list(keep), list(cols), "feature", "value")
    return long.where(F.col("value").isNotNull())


def two_sample_counts(ref_long: DataFrame, cur_long: DataFrame) -> DataFrame:
    """Per (feature, value): rows of both samples (r, c). Everything about a feature derives from this table."""
    both = ref_long.select("feature", "value", F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        cur_long.select("feature", "value", F.lit(0).alias("_r"), F.lit(1).alias("_c")))
    return both.groupBy("feature", "value").agg(F.sum("_r").cast("long").alias("r"), F.sum("_c").cast("long").alias("c"))


def two_sample_prefix(ref_long: DataFrame, cur_long: DataFrame) -> DataFrame:
    """Per (feature, value): counts and running counts of both samples."""
    return _prefix(two_sample_counts(ref_long, cur_long))


def _prefix(counts: DataFrame) -> DataFrame:
    return prefix_sums(counts, "value", {"r": "r", "c": "c"}, by=["feature"], unique_keys=True)


def ks_from_prefix(cum: DataFrame) -> DataFrame:
    gap = F.abs(F.try_divide(F.col("cum_r"), F.col("total_r")) - F.try_divide(F.col("cum_c"), F.col("total_c")))
    return cum.groupBy("feature").agg(F.max(gap).alias("ks_statistic"))


def ks_statistics(ref_long: DataFrame, cur_long: DataFrame) -> DataFrame:
    """Two-sample KS statistic per feature."""
    return ks_from_prefix(two_sample_prefix(ref_long, cur_long))


def _edges(q: DataFrame) -> DataFrame:
    edges = q.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges"))
    return edges.withColumn("m", F.size("edges") - 1)


def psi_edges(ref_long: DataFrame, probs: Sequence[float] = PSI_PROBS) -> DataFrame:
    """Distinct reference quantile edges per feature (sorted array) and bin count m."""
    return _edges(exact_quantiles(ref_long, "value", probs, by=["feature"]))


MAX_BINS = len(PSI_PROBS) - 1


def _edge_count(value_col: str = "value"):
    """Number of edges <= value, as a fixed sum over the <= len(PSI_PROBS) edge slots."""
    v = F.col(value_col)
    return sum(F.when(F.try_element_at("edges", F.lit(i)) <= v, 1).otherwise(0) for i in range(1, len(PSI_PROBS) + 1))


def _bin_of(value_col: str = "value", k: str = "_k"):
    """0-based bin (last bin closed); NULL outside the reference range or without bins."""
    return (F.when(F.col("m") <= 0, F.lit(None))
            .when(F.col(value_col) == F.element_at("edges", -1), F.col("m") - 1)
            .when((F.col(k) >= 1) & (F.col(k) <= F.col("m")), F.col(k) - 1))


def _bin_counts(long: DataFrame, edges: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One pass: per (keys, feature) the total and the count of each bin."""
    edges = edges.select("feature", "edges", "m")  # one row per feature with at most len(PSI_PROBS) values
    b = long.join(F.broadcast(edges), "feature").withColumn("_k", _edge_count()).withColumn("_bin", _bin_of())
    return b.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias(f"{prefix}_tot"),
        *[F.count_if(F.col("_bin") == i).alias(f"{prefix}_{i}") for i in range(MAX_BINS)])


def psi_numeric(ref_long: DataFrame, cur_long: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """PSI per feature (and per ``group`` columns of the current side,
    e.g. a time window) against fixed reference edges.

    Without groups it comes from the two-sample counts (``numeric_profile``).

    Each side is one grouped pass producing a row per (group, feature) with its
    total and up to 10 bin counts; values outside the reference range count in
    the total only. PSI is then a fixed sum over the bin columns.
    """
    group = list(group)
    if not group:
        return numeric_profile(ref_long, cur_long).select("feature", "psi")
    reference = reference_bins(ref_long)
    return psi_of_counts(_bin_counts(cur_long, reference, group, "c"), reference, group)


def reference_bins(ref_long: DataFrame) -> DataFrame:
    """What later windows are held against, one row per feature: edges, bin count m, total and bins of the reference."""
    edges = psi_edges(ref_long)
    return edges.join(_bin_counts(ref_long, edges, [], "r"), "feature")


def psi_of_counts(counts: DataFrame, reference: DataFrame, group: Sequence[str]) -> DataFrame:
    """PSI per (group, feature) from the current side's bins."""
    j = counts.join(F.broadcast(reference.drop("edges")), "feature")  # bounded by the schema's width
    # a reference with a single edge has no bins: psi 0
    return j.select(*group, "feature", _psi_of_bins().alias("psi"))


def live_bin_counts(stream: DataFrame, reference: DataFrame, cols: Sequence[str], watermark: str, window: str = "1 day") -> DataFrame:
    """D08 on a stream with ``event_time``: bins per (window, feature) over the frozen reference's edges.

    The state is one row of a dozen counts per window and feature; windows leave it as the watermark passes them.
    """
    long = to_long(stream.withWatermark("event_time", watermark), cols, keep=["event_time"])
    return _bin_counts(long.withColumn("w", F.window("event_time", window)), reference, ["w"], "c")


def _psi_of_bins():
    """PSI from the columns r_i, c_i, r_tot, c_tot and the number of bins m."""
    terms = []
    for i in range(MAX_BINS):
        r, c = F.try_divide(F.col(f"r_{i}"), F.col("r_tot")), F.try_divide(F.col(f"c_{i}"), F.col("c_tot"))
        r = F.when(r == 0, F.lit(EPS)).otherwise(r)
        c = F.when(c == 0, F.lit(EPS)).otherwise(c)
        terms.append(F.when(F.lit(i) < F.col("m"), (c - r) * F.log(c / r)).otherwise(F.lit(0.0)))
    return sum(terms[1:], terms[0])


def numeric_profile(ref_long: DataFrame, cur_long: DataFrame) -> DataFrame:
    """Per feature of the reference: ref_n, curr_n, KS statistic, PSI, means and standard deviations.

    Each side is read once. The counts by (feature, value) feed two passes over
    the same exchange: running counts give KS, the reference's decile edges and
    the means; with those rows (one per feature) at hand, the counts give the
    bins and the squared deviations.
    """
    counts = two_sample_counts(ref_long, cur_long)
    cum = _prefix(counts)
    gap = F.abs(F.try_divide(F.col("cum_r"), F.col("total_r")) - F.try_divide(F.col("cum_c"), F.col("total_c")))
    last, upto = F.col("total_r") - 1, F.col("cum_r") - 1
    ends = []
    for i, p in enumerate(PSI_PROBS):  # the values at the two ranks around each decile of the reference
        for name, rank in (("lo", F.floor(F.lit(p) * last)), ("hi", F.ceil(F.lit(p) * last))):
            ends.append(F.max(F.when(rank.between(F.col("cum_r") - F.col("r"), upto), F.col("value"))).alias(f"_{name}{i}"))
    first = cum.groupBy("feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("total_r").alias("ref_n"), F.max("total_c").alias("curr_n"),
        F.try_divide(F.sum(F.col("value") * F.col("r")), F.max("total_r")).alias("ref_mean"),
        F.try_divide(F.sum(F.col("value") * F.col("c")), F.max("total_c")).alias("curr_mean"), *ends)
    n1 = F.col("ref_n") - 1
    edge = [F.when(F.floor(F.lit(p) * n1) == F.ceil(F.lit(p) * n1), F.col(f"_lo{i}")).otherwise(
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (F.lit(p) * n1 - F.floor(F.lit(p) * n1)))
        for i, p in enumerate(PSI_PROBS)]
    kept = ["ks_statistic", "ref_n", "curr_n", "ref_mean", "curr_mean"]
    stats = first.select("feature", *kept, F.array_compact(F.array_distinct(F.array(*edge))).alias("edges")).withColumn(
        "m", F.greatest(F.size("edges") - 1, F.lit(0)))
    # stats: one row per feature, bounded by the schema's width
    binned = counts.join(F.broadcast(stats), "feature").withColumn("_k", _edge_count()).withColumn("_bin", _bin_of())
    squares = [F.sum(F.col(n) * F.pow(F.col("value") - F.col(m), F.lit(2.0))).alias(f"_{n}2") for n, m in (("r", "ref_mean"), ("c", "curr_mean"))]
    wide = binned.groupBy("feature").agg(
        *[F.first(c).alias(c) for c in (*kept, "m")], F.sum("r").alias("r_tot"), F.sum("c").alias("c_tot"), *squares,
        *[F.sum(F.when(F.col("_bin") == i, F.col(n)).otherwise(0)).alias(f"{n}_{i}") for n in ("r", "c") for i in range(MAX_BINS)])
    return wide.where(F.col("ref_n") > 0).select(
        "feature", "ref_n", "curr_n", "ks_statistic", _psi_of_bins().alias("psi"), "ref_mean", "curr_mean",
        *[F.when(F.col(n) > 1, F.sqrt(F.col(s) / (F.col(n) - 1))).alias(o)
          for n, s, o in (("ref_n", "_r2", "ref_std"), ("curr_n", "_c2", "curr_std"))])


def category_distributions(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Normalised value counts of both sides, full outer joined, missing -> 0."""
    def freq(df, name):
        base = df.where(F.col(col).isNotNull())
        total = base.agg(F.count(F.lit(1)).alias("_t"))
        cnt = base.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
        return cnt.crossJoin(F.broadcast(total)).select(col, (F.col("_n") / F.col("_t")).alias(name))
    return freq(ref, "ref_freq").join(freq(cur, "cur_freq"), on=col, how="full_outer").select(
        F.col(col).alias("value"), F.coalesce("ref_freq", F.lit(0.0)).alias("ref_freq"),
        F.coalesce("cur_freq", F.lit(0.0)).alias("cur_freq"))


def category_frequencies(df: DataFrame, col: str) -> DataFrame:
    """Value counts normalised by the non-null total."""
    base = df.where(F.col(col).isNotNull())
    total = base.agg(F.count(F.lit(1)).alias("_t"))
    cnt = base.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return cnt.crossJoin(F.broadcast(total)).select(F.col(col).alias("value"), (F.col("_n") / F.col("_t")).alias("freq"))


def category_psi(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PSI per column over the union of its categories, empty frequency -> 0.0001.

    One grouped pass over both sides for all columns. A column without values
    on either side has not shifted: 0.
    """
    def long(df: DataFrame, r: int, c: int) -> DataFrame:
        text = df.select(*[F.col(x).cast("string").alias(x) for x in cols])
        return text.unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull()).select(
            "feature", "value", F.lit(r).alias("_r"), F.lit(c).alias("_c"))

    counts = long(ref, 1, 0).unionByName(long(cur, 0, 1)).groupBy("feature", "value").agg(
        F.sum("_r").alias("r"), F.sum("_c").alias("c"))
    # one row per column: bounded by the schema's width
    totals = counts.groupBy("feature").agg(F.sum("r").alias("_tr"), F.sum("c").alias("_tc"))
    r, c = F.try_divide(F.col("r"), F.col("_tr")), F.try_divide(F.col("c"), F.col("_tc"))
    r = F.when(F.coalesce(r, F.lit(0.0)) == 0, F.lit(EPS)).otherwise(r)
    c = F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(EPS)).otherwise(c)
    psi = counts.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    names = ref.sparkSession.createDataFrame([(x,) for x in cols], "feature string")
    return names.join(psi, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi_categorical(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """D03 of one column."""
    return category_psi(ref, cur, [col])


def drift_report(ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                 threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row per reference feature.

    numeric: score = max(ks, psi/10); categorical: score = psi;
    detected = score > threshold. A column missing from ``cur`` is
    detected with score 1.0; an empty side after dropping nulls is not
    detected, score 0.0.
    """
    spark = ref.sparkSession
    present = [c for c in numeric if c in cur.columns]
    missing = [c for c in list(numeric) + list(categorical) if c not in cur.columns]
    schema = ("feature string, kind string, ks_statistic double, psi double, drift_score double, "
              "drift_detected boolean, ref_mean double, curr_mean double, ref_std double, curr_std double")
    parts = []
    if present:
        rl, cl = to_long(ref, present), to_long(cur, present)
        feats = spark.createDataFrame([(c,) for c in present], "feature string")
        st = feats.join(numeric_profile(rl, cl), "feature", "left")
        empty = F.coalesce(F.col("ref_n"), F.lit(0)).eqNullSafe(0) | F.coalesce(F.col("curr_n"), F.lit(0)).eqNullSafe(0)
        score = F.greatest(F.col("ks_statistic"), F.col("psi") / 10)
        parts.append(st.select(
            "feature", F.lit("numeric").alias("kind"),
            F.when(~empty, F.col("ks_statistic")).alias("ks_statistic"),
            F.when(~empty, F.col("psi")).alias("psi"),
            F.when(empty, F.lit(0.0)).otherwise(score).alias("drift_score"),
            F.when(empty, F.lit(False)).otherwise(score > F.lit(threshold)).alias("drift_detected"),
            F.when(~empty, F.col("ref_mean")).alias("ref_mean"), F.when(~empty, F.col("curr_mean")).alias("curr_mean"),
            F.when(~empty, F.col("ref_std")).alias("ref_std"), F.when(~empty, F.col("curr_std")).alias("curr_std")))
    there = [c for c in categorical if c in cur.columns]
    if there:
        parts.append(category_psi(ref, cur, there).select(
            "feature", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("ks_statistic"),
            "psi", F.col("psi").alias("drift_score"), (F.col("psi") > F.lit(threshold)).alias("drift_detected"),
            *[F.lit(None).cast("double").alias(n) for n in ("ref_mean", "curr_mean", "ref_std", "curr_std")]))
    if missing:
        parts.append(spark.createDataFrame(
            [(m, "missing", None, None, 1.0, True, None, None, None, None) for m in missing], schema))
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def summary_drift(ref: DataFrame, cur: DataFrame, numeric: Sequence[str],
                  threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Drift against reference *means* only.

    The reference sample is its mean repeated, so KS = max(F_cur(mu-),
    1 - F_cur(mu)) and PSI has one edge, hence no bins and 0. A reference
    column that ``cur`` lacks is detected with score 1.0 and zeros.
    """
    present = [c for c in numeric if c in cur.columns]
    rl, cl = to_long(ref, present), to_long(cur, present)
    rs = rl.groupBy("feature").agg(F.avg("value").alias("reference_mean"),
                                   F.stddev_samp("value").alias("reference_std"))
    j = cl.join(F.broadcast(rs), "feature")  # rs: one row per feature
    agg = j.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("value") < F.col("reference_mean")).alias("_lt"),
        F.count_if(F.col("value") <= F.col("reference_mean")).alias("_le"),
        F.avg("value").alias("current_mean"), F.stddev_samp("value").alias("current_std"))
    out = rs.join(agg, "feature", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    ks = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.col("_lt") / n, 1 - F.col("_le") / n))
    checked = out.select(
        "feature", (ks > F.lit(threshold)).alias("drift_detected"), ks.alias("drift_score"),
        "reference_mean", F.coalesce("current_mean", F.lit(0.0)).alias("current_mean"),
        "reference_std", F.when(n == 0, F.lit(0.0)).otherwise(F.col("current_std")).alias("current_std"))
    missing = [(c, True, 1.0, 0.0, 0.0, 0.0, 0.0) for c in numeric if c not in cur.columns]
    return checked.unionByName(ref.sparkSession.createDataFrame(missing, checked.schema)) if missing else checked


# Alert titles and the length of the alert history.
WARNING_TITLE = ("Data drift detected in ", " features")
CRITICAL_TITLE = "High drift detected - model rollback recommended"
HISTORY_LENGTH = 100


def drift_alerts(report: DataFrame, rollback_threshold: float = ROLLBACK_THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """A warning row when any feature drifted, plus a critical row when any
    score exceeds the rollback threshold; both with their features' scores.

    With ``by``, a report per group (say a day) and alerts for each. One pass over the report: the two lists hold at most one entry per feature
    of the schema, and the alert rows are made from them."""
    entry = F.struct("feature", F.format_string("%s:%.9f", "feature", "drift_score").alias("score"))
    agg = report.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), entry))).alias("drifted"),
        F.array_sort(F.collect_list(F.when(F.col("drift_score") > F.lit(rollback_threshold), entry))).alias("high"))

    def alert(severity: str, title, entries: str):
        return F.struct(F.lit(severity).alias("severity"), title.alias("title"),
                        F.array_join(F.transform(entries, lambda e: e["feature"]), ",").alias("features"),
                        F.array_join(F.transform(entries, lambda e: e["score"]), ",").alias("scores"))

    first, last = WARNING_TITLE
    warn = alert("warning", F.concat(F.lit(first), F.size("drifted").cast("string"), F.lit(last)), "drifted")
    crit = alert("critical", F.lit(CRITICAL_TITLE), "high")
    rows = F.when(F.size("drifted") == 0, F.array().cast(
        "array<struct<severity:string,title:string,features:string,scores:string>>")).when(
        F.size("high") == 0, F.array(warn)).otherwise(F.array(warn, crit))
    return agg.select(*by, F.inline(rows))


def alert_history(alerts: DataFrame, ts: str, keep: int = HISTORY_LENGTH) -> DataFrame:
    """The newest ``keep`` alert rows (per-task top n, then merged)."""
    return alerts.orderBy(F.col(ts).desc(), F.col("severity")).limit(keep)


def overall_drift(report: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(any score > threshold, max score); no scores -> (false, 0)."""
    mx = F.coalesce(F.max("drift_score"), F.lit(0.0))
    return report.agg((mx > F.lit(threshold)).alias("drift_detected"), mx.alias("max_drift_score"))


def drift_history_summary(history: DataFrame, ts: str) -> DataFrame:
    """Counts over the check history; empty history -> status no_data."""
    n = F.count(F.lit(1))
    det = F.count_if(F.col("drift_detected"))
    return history.agg(
        F.when(n == 0, F.lit("no_data")).when(det > 0, F.lit("drift_detected")).otherwise(F.lit("stable")).alias("status"),
        det.alias("features_with_drift"), n.alias("total_features_checked"),
        (det / F.greatest(n, F.lit(1))).alias("drift_rate"), F.max(ts).alias("last_check"))


def reference_stats(long: DataFrame) -> DataFrame:
    """Per feature n, mean, std (ddof=1), min, q25, q50, q75, max (exact)."""
    m = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["feature"])
    qw = q.groupBy("feature").agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                                    for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return m.join(qw, "feature")
