"""Window, sort and top-k operators.

Trailing range windows per key (W01, W03) are computed per (key, time
chunk) instead of per key: every row also goes, as a context-only copy, to
the next chunk when it lies within one window length of that chunk's start.
A user holding a third of all rows is then spread over many tasks, and the
result is exact (each output row sees every row of its look-back window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ranking import prefix_sums

US_PER_SEC = 1_000_000


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ column, from its wall-clock
    fields, so the session time zone (and DST) never enters window lengths."""
    c = F.col(ts)
    day_us = F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
    sec_us = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")  # seconds with fraction
    return day_us + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + sec_us


def trailing_window(df: DataFrame, key: Sequence[str], ts: str, lookback_us: int,
                    aggs: dict[str, Column], chunk_us: int | None = None) -> DataFrame:
    """Per row: aggregates over rows of the same key with t in [t_row - lookback_us, t_row].

    ``aggs`` maps output name -> aggregate expression over the window. The
    window runs over (key, chunk) partitions with look-back copies, so a hot
    key is split into chunk-sized tasks. A chunk is 16 look-backs long unless
    given, so about one row in 16 is copied.
    """
    key, chunk_us = list(key), chunk_us or 16 * (lookback_us + 1)
    base = df.withColumn("_t", micros(ts)).withColumn("_c0", F.floor(F.col("_t") / F.lit(chunk_us)))
    spans = (lookback_us + chunk_us - 1) // chunk_us
    # one scan: every row yields its own (chunk, ctx=false) entry plus a context
    # copy for each later chunk whose look-back reaches it
    copies = [F.struct(F.col("_c0").alias("c"), F.lit(False).alias("x"))]
    for k in range(1, spans + 1):
        reach = F.col("_t") >= (F.col("_c0") + k) * F.lit(chunk_us) - F.lit(lookback_us)
        copies.append(F.when(reach, F.struct((F.col("_c0") + k).alias("c"), F.lit(True).alias("x"))))
    parts = base.withColumn("_e", F.explode(F.array_compact(F.array(*copies)))) \
        .select("*", F.col("_e.c").alias("_chunk"), F.col("_e.x").alias("_ctx")).drop("_e", "_c0")
    w = Window.partitionBy(*key, "_chunk").orderBy("_t").rangeBetween(-lookback_us, 0)
    out = parts.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.where(~F.col("_ctx")).drop("_t", "_chunk", "_ctx")


def velocity(df: DataFrame, user: str = "user_id", ts: str = "created_at", seconds: int = 3600) -> DataFrame:
    """Per-user count and amount sum over the trailing hour (current row included)."""
    return trailing_window(df, [user], ts, seconds * US_PER_SEC,
                           {"tx_count_last_hour": F.count(F.lit(1)), "amount_last_hour": F.sum("amount")})


def rate_limit(df: DataFrame, key: str = "user_id", ts: str = "created_at", seconds: int = 60,
               limit: int = 100) -> DataFrame:
    """Requests with now - t < 60 s (current included); violation if count > limit."""
    out = trailing_window(df, [key], ts, seconds * US_PER_SEC - 1, {"requests_last_minute": F.count(F.lit(1))})
    return out.withColumn("rate_limited", F.col("requests_last_minute") > F.lit(limit))


def prior_user_stats(df: DataFrame, user: str = "user_id", ts: str = "created_at",
                     row_id: str = "transaction_id") -> DataFrame:
    """W02 (leak-free): per row, average amount and fraud rate of the user's
    earlier rows, by distributed prefix sums (a hot user spans many buckets)."""
    keyed = df.withColumn("_key", F.struct(F.col(ts).alias("t"), F.col(row_id).alias("i")))
    carry = [c for c in df.columns if c != user]
    cum = prefix_sums(keyed, "_key", {"_a": F.col("amount"), "_f": F.col("is_fraud").cast("long"),
                                      "_n": F.lit(1).cast("long")}, by=[user], unique_keys=True, carry=carry,
                      bucket=F.to_date(F.col("_key.t")))
    prev_n = F.col("cum__n") - 1
    return cum.select(
        user, *carry, prev_n.alias("prior_count"),
        F.when(prev_n > 0, (F.col("cum__a") - F.col("_a")) / prev_n).alias("prior_avg_amount"),
        F.when(prev_n > 0, (F.col("cum__f") - F.col("_f")) / prev_n).alias("prior_fraud_rate"))


def sliding_rate(df: DataFrame, by: Sequence[str], ts: str, label: str, length: str = "1 hour",
                 slide: str = "5 minutes") -> DataFrame:
    """Count and positive rate per sliding event-time window.

    Rows are summed per slide first, so only those sums, not the rows, are
    repeated for the windows that hold them.
    """
    step = df.groupBy(*by, F.window(ts, slide)["start"].alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(label).alias("_known"), F.sum(label).alias("_sum"))
    g = step.groupBy(*by, F.window("_at", length, slide).alias("w")).agg(
        F.sum("_n").alias("n"), F.try_divide(F.sum("_sum"), F.sum("_known")).alias("fraud_rate"))
    return g.select(*by, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n", "fraud_rate")


def hourly_deviation(df: DataFrame, ts: str, label: str, hours: int = 168, limit: float = 0.1) -> DataFrame:
    """Hourly rate vs the mean of the trailing ``hours`` hourly rates on a
    dense hour spine. The series has one row per hour of the time span (not
    per event), so the global window over it is small."""
    hourly = df.groupBy(F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour_start")) \
        .agg(F.avg(label).alias("rate"))
    span = hourly.agg(F.min("hour_start").alias("lo"), F.max("hour_start").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour_start"))
    s = spine.join(hourly, "hour_start", "left")
    w = Window.orderBy("hour_start").rowsBetween(-(hours - 1), 0)
    s = s.withColumn("mean_7d", F.avg("rate").over(w))
    return s.withColumn("deviation_alert", F.abs(F.col("rate") - F.col("mean_7d")) > F.lit(limit))


def daily_spike(df: DataFrame, ts: str, days: int = 7, factor: float = 1.2) -> DataFrame:
    """Daily request total vs the average over the days that have requests
    among the trailing ``days`` calendar days (one row per day of the span)."""
    daily = df.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    daily = daily.withColumn("avg_7d", F.avg("requests").over(w))
    return daily.withColumn("spike", F.col("requests") > F.lit(factor) * F.col("avg_7d"))


def error_rate_series(df: DataFrame, ts: str, status: str, minutes: int = 5, limit: float = 0.01) -> DataFrame:
    """5xx share per tumbling window; breach when > limit."""
    w = F.window(ts, f"{minutes} minutes")
    g = df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("requests"),
                                     F.count_if(F.col(status) >= 500).alias("errors"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "errors",
                    (F.col("errors") / F.col("requests")).alias("error_rate"),
                    (F.col("errors") / F.col("requests") > F.lit(limit)).alias("breach"))


def persistent_alerts(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Pending, firing and resolved alerts of every rule over its own series.

    ``series`` has (rule, at, breach), a row per rule and evaluation step;
    ``rules`` (rule, step_minutes, for_minutes, severity). Breaches at consecutive
    steps are one alert (a missing step ends it): pending from its first step,
    fired at the first step that lies ``for_minutes`` beyond it, resolved at the
    step after its last one, unless that is the rule's newest. Alerts that never
    fire stay pending. A series has one row per step of the time span, not per event.
    """
    newest = series.groupBy("rule").agg(F.max("at").alias("_newest"))
    t = F.unix_seconds(F.col("at").cast("timestamp")) / 60
    steps = series.where(F.col("breach")).join(F.broadcast(rules), "rule")  # rules: a handful
    island = t - F.row_number().over(Window.partitionBy("rule").orderBy("at")) * F.col("step_minutes")
    runs = steps.withColumn("_run", island).groupBy("rule", "severity", "step_minutes", "for_minutes", "_run").agg(
        F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.count("*").alias("steps"))
    held = (F.col("steps") - 1) * F.col("step_minutes")
    wait = F.ceil(F.col("for_minutes") / F.col("step_minutes")) * F.col("step_minutes")

    def later(c: str, minutes: Column) -> Column:
        return F.col(c) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    fired, over = held >= F.col("for_minutes"), F.col("last_at") < F.col("_newest")
    return runs.join(F.broadcast(newest), "rule").select(  # newest: a row per rule
        "rule", "severity", "started_at", held.cast("long").alias("held_minutes"),
        F.when(~fired, "pending").when(over, "resolved").otherwise("firing").alias("state"),
        F.when(fired, later("started_at", wait)).alias("fired_at"), F.when(fired & over, later("last_at", F.col("step_minutes"))).alias("resolved_at"))


# Rules that must hold for a time: (rule, step of its series and duration in minutes, severity).
HELD_RULES = [("HighErrorRate", 5, 2, "critical"), ("HighLatency", 5, 5, "warning"), ("VeryHighLatency", 5, 3, "critical"),
              ("ModelAccuracyDrop", 5, 60, "critical"), ("UnusualFraudRate", 60, 30, "warning")]


def held_rule_series(logs: DataFrame, ts: str = "created_at") -> DataFrame:
    """(rule, at, breach) of ``HELD_RULES``: 5-minute error share, histogram latency quantiles and accuracy, hourly deviation."""
    from riskweave.operators import reports as rp
    w = F.window(ts, "5 minutes")["start"].cast("timestamp_ntz").alias("at")
    base = logs.select(w, "status_code", (F.col("processing_time_ms") / 1000).alias("_s"),
                       F.when(F.col("fraud_label") == F.col("is_fraud"), 1.0).otherwise(0.0).alias("_right"))
    rates = base.groupBy("at").agg((F.count_if(F.col("status_code") >= 500) / F.count("*") > 0.01).alias("HighErrorRate"),
                                   (F.avg("_right") < 0.8).alias("ModelAccuracyDrop"))
    latency = rp.histogram_quantiles(rp.latency_histogram(base, "_s", by=["at"]), [0.95, 0.99], by=["at"]).select(
        F.when(F.col("quantile") == 0.95, "HighLatency").otherwise("VeryHighLatency").alias("rule"), "at",
        (F.col("value") > F.when(F.col("quantile") == 0.95, 0.5).otherwise(1.0)).alias("breach"))
    unusual = hourly_deviation(logs, ts, "fraud_label").select(
        F.lit("UnusualFraudRate").alias("rule"), F.col("hour_start").alias("at"), F.col("deviation_alert").alias("breach"))
    return rates.unpivot(["at"], ["HighErrorRate", "ModelAccuracyDrop"], "rule", "breach").select("rule", "at", "breach").unionByName(
        latency).unionByName(unusual)


def canary_decision(logs: DataFrame, variant: str, new: str, ts: str, row_id: str, start: Column,
                    min_requests: int = 100, max_error_rate: float = 0.05, max_latency_ms: float = 200.0,
                    monitoring_hours: int = 1, auto_promote: bool = True,
                    base: tuple[int, int, float] = (0, 0, 0.0)) -> DataFrame:
    """Replay every request in time order; at each, evaluate the canary's
    running metrics; the first non-null decision is final.

    Running counts come from ``prefix_sums`` over (time, id), so the single
    experiment is not one task. Output: one row (status, decided_at, ...).
    """
    # ``base``: canary (requests, errors, latency sum) before these rows, for
    # incremental (micro-batch) evaluation
    is_new = (F.col(variant) == F.lit(new)).cast("long")
    keyed = logs.withColumn("_key", F.struct(F.col(ts).alias("t"), F.col(row_id).alias("i"))) \
        .withColumn("_expired", F.col(ts) > start + F.expr(f"INTERVAL {monitoring_hours} HOURS"))
    cum = prefix_sums(keyed, "_key", {
        "n": is_new, "err": is_new * (F.col("status_code") >= 500).cast("long"),
        "lat": is_new.cast("double") * F.col("processing_time_ms")}, unique_keys=True, carry=[ts, "_expired"],
        bucket=F.date_trunc("minute", F.col("_key.t")))
    n = F.col("cum_n") + F.lit(int(base[0]))
    err_rate = (F.col("cum_err") + F.lit(int(base[1]))) / F.greatest(n, F.lit(1))
    avg_lat = (F.col("cum_lat") + F.lit(float(base[2]))) / F.greatest(n, F.lit(1))
    expired = F.col("_expired")
    if auto_promote:
        decision = (F.when(n < min_requests, F.lit(None))
                    .when(err_rate > max_error_rate, F.lit("rolled_back"))
                    .when(avg_lat > max_latency_ms, F.lit("rolled_back"))
                    .when(expired, F.lit("promoted")))
    else:
        decision = F.lit(None).cast("string")
    d = cum.select(F.col("_key"), F.col(ts), n.alias("n"), err_rate.alias("error_rate"),
                   avg_lat.alias("avg_latency_ms"), decision.alias("decision"))
    first = d.where(F.col("decision").isNotNull()).agg(
        F.min_by(F.struct(ts, "decision", "n", "error_rate", "avg_latency_ms"), F.col("_key")).alias("f"))
    return first.select(F.coalesce(F.col("f.decision"), F.lit("active")).alias("status"),
                        F.col(f"f.{ts}").alias("decided_at"), F.col("f.n").alias("canary_requests"),
                        F.col("f.error_rate").alias("error_rate"), F.col("f.avg_latency_ms").alias("avg_latency_ms"))


def latest_n(df: DataFrame, ts: str, tiebreak: str, n: int) -> DataFrame:
    """Newest n rows (TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(n)


def time_range(df: DataFrame, ts: str, tiebreak: str, start=None, end=None, default_n: int = 1000) -> DataFrame:
    """Both bounds -> inclusive range, newest first; otherwise the latest ``default_n``."""
    if start is not None and end is not None:
        lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        return df.where(F.col(ts).between(lo, hi)).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    return latest_n(df, ts, tiebreak, default_n)


def filtered_tail(df: DataFrame, ts: str, tiebreak: str, filters: dict[str, object], start=None, end=None,
                  limit: int = 100) -> DataFrame:
    """Optional equality and time filters; the last ``limit`` matches
    in arrival order (ascending) with the total number of matches."""
    q = df
    for c, v in filters.items():
        if v is not None:
            q = q.where(F.col(c) == F.lit(v))
    if start is not None:
        q = q.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        q = q.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    total = q.agg(F.count(F.lit(1)).alias("total"))
    tail = q.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(limit)
    return tail.crossJoin(F.broadcast(total)).orderBy(F.col(ts), F.col(tiebreak))


def best_by(runs: DataFrame, name: str, metric: str, order: str | None = None) -> DataFrame:
    """Argmax of ``metric`` over runs with a value; ties -> earliest ``order``."""
    ok = runs.where(F.col(metric).isNotNull())
    tie = F.col(order) if order else F.col(name)
    return ok.agg(F.min_by(F.col(name), F.struct(-F.col(metric), tie)).alias(f"best_{name}"),
                  F.max(metric).alias(f"best_{metric}"))


def top_k_by_abs(arr: Column, k: int, field: str, tie: str | None = None) -> Column:
    """Sort an array of structs by |field| descending (then ``tie`` ascending) and keep k.

    The array has one entry per model feature: its size is fixed by the schema."""
    def cmp(a, b):
        c = F.when(F.abs(a[field]) > F.abs(b[field]), -1).when(F.abs(a[field]) < F.abs(b[field]), 1)
        if tie:
            c = c.when(a[tie] < b[tie], -1).when(a[tie] > b[tie], 1)
        return c.otherwise(0)
    return F.slice(F.array_sort(arr, cmp), 1, k)


def comparison_table(runs: DataFrame, name: str, metrics: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metrics x models (rows per metric, one column per model)."""
    long = runs.select(name, *[F.col(m).cast("double") for m in metrics]).unpivot(
        [name], list(metrics), "metric", "value")
    return long.groupBy("metric").pivot(name, list(names)).agg(F.first("value"))
