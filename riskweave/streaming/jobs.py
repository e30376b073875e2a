"""Structured Streaming operators.

Stateless work (validation, features with frozen statistics, scoring,
projection) is a plain streaming projection. Counters and rates are
watermarked window aggregations in ``update`` mode. Jobs that need the rows
around a row (rate limit, score reuse) are ``foreachBatch`` steps over
``TimedState``: late rows are met by the state of their time, and state that no
row can reach any more is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.functions import validate as va
from riskweave.operators import reports as rp
from riskweave.streaming.state import TimedState, drop_before, partitions, path_exists

# Score-reuse expiry tiers in seconds.
TTL_SHORT, TTL_MEDIUM, TTL_LONG = 300, 1800, 3600


def score_stream(stream: DataFrame, stats: DataFrame) -> DataFrame:
    """Validate, engineer with frozen (batch-fitted) stats, rule-score, label."""
    valid = va.validate_strict(stream.withColumn("transaction_count_last_hour", F.lit(0))) \
        .where(F.col("is_valid")).drop("transaction_count_last_hour", "reject_reasons", "is_valid")
    eng = fe.engineer(valid, stats)
    return eng.withColumn("predicted_label", (F.col("risk_score") >= 0.5).cast("int"))


def model_scoring_sink(model, stats: DataFrame, threshold: float, out_path: str, quarantine_path: str):
    """T01 with a trained pipeline: valid requests are scored with the model's own statistics and threshold,
    the others kept with their reasons. A batch writes below its id, so it may run again."""
    from riskweave.operators import models as ml

    def step(batch: DataFrame, batch_id: int) -> None:
        checked = va.validate_strict(batch.withColumn("transaction_count_last_hour", F.lit(0))).drop("transaction_count_last_hour")
        checked.where(~F.col("is_valid")).drop("is_valid").write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
        valid = checked.where(F.col("is_valid")).drop("reject_reasons", "is_valid")
        ml.score(model, fe.engineer(valid, stats), threshold).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return step


# Event types of the audit log.
AUDIT_EVENTS = ("prediction", "error", "admin_action", "auth_failure")


def audit_records(stream: DataFrame) -> DataFrame:
    """An audit row per request, of one of ``AUDIT_EVENTS``.

    ``stream`` has the log's columns and ``auth_method``, ``ip_address``, ``request_id``,
    ``admin_action`` (null: no admin call) and ``auth_attempt`` (null: authenticated).
    A failed authentication is told by an anonymous user and its attempt, an
    admin call by its action and model, both as JSON ``metadata``; a 5xx answer is an error.
    """
    failed, admin = F.col("auth_attempt").isNotNull(), F.col("admin_action").isNotNull()
    error = F.col("status_code") >= 500
    kind = F.when(failed, "auth_failure").when(admin, "admin_action").when(error, "error").otherwise("prediction")

    def of(kinds: str | tuple, value) -> Column:
        return F.when(F.col("event_type").isin(*([kinds] if isinstance(kinds, str) else kinds)), value)
    call = ("prediction", "error")
    return stream.withColumn("event_type", kind).select(
        "event_type", F.when(failed, "anonymous").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("user_id"),
        of("prediction", F.col("auth_method")).alias("auth_method"), of((*call, "auth_failure"), F.col("ip_address")).alias("ip_address"),
        of(call, F.col("endpoint")).alias("endpoint"), of(call, F.lit("POST")).alias("method"), of(call, F.col("request_id")).alias("request_id"),
        of("prediction", F.col("prediction_id")).alias("prediction_id"), of("prediction", F.col("amount")).alias("transaction_amount"),
        of("prediction", F.col("fraud_probability")).alias("fraud_probability"), of("prediction", F.col("fraud_label")).alias("fraud_label"),
        of("prediction", F.col("processing_time_ms")).alias("processing_time_ms"),
        of("prediction", F.lit(200)).when(F.col("event_type") == "error", F.col("status_code")).alias("status_code"),
        of("error", F.lit("Internal server error")).alias("error_message"),
        of("auth_failure", F.to_json(F.struct(F.col("auth_attempt").alias("attempt_type"), F.col("endpoint").alias("details")))).when(
            F.col("event_type") == "admin_action", F.to_json(F.struct(F.col("admin_action").alias("action"), "model_type", "model_version"))
        ).alias("metadata"), "created_at")


def live_counters(stream: DataFrame, watermark: str, window: str = "1 hour") -> DataFrame:
    """Per (window, model): requests and cumulative latency buckets."""
    s = stream.withWatermark("event_time", watermark)
    lat = F.col("processing_time_ms") / 1000
    aggs = [F.count(F.lit(1)).alias("requests")]
    aggs += [F.count_if(lat <= F.lit(b)).cast("bigint").alias(f"le_{i}") for i, b in enumerate(rp.LATENCY_BUCKETS)]
    return s.groupBy(F.window("event_time", window).alias("w"), "model_type").agg(*aggs)


def live_rolling_rate(stream: DataFrame, watermark: str, slide: str = "5 minutes") -> DataFrame:
    """Requests and fraud predictions per slide and model, one state row each (``rolling_windows`` adds them up)."""
    s = stream.withWatermark("event_time", watermark)
    return s.groupBy(F.window("event_time", slide).alias("w"), "model_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fraud_label").alias("frauds"))


def rolling_windows(slides: DataFrame, at: str, by: str, length: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Sums of the slides (column ``at``: their start) in every window that holds them."""
    w = F.window(F.col(at).cast("timestamp"), length, slide)
    return slides.groupBy(by, w.alias("w")).agg(F.sum("n").alias("n"), F.sum("frauds").alias("frauds")).select(
        by, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "frauds")


def ttl_for(p: float) -> int:
    if p > 0.7 or p < 0.1:
        return TTL_SHORT
    if 0.3 < p < 0.7:
        return TTL_MEDIUM
    return TTL_LONG


def _ttl_us(p: np.ndarray) -> np.ndarray:
    short, medium = (p > 0.7) | (p < 0.1), (p > 0.3) & (p < 0.7)
    return np.where(short, TTL_SHORT, np.where(medium, TTL_MEDIUM, TTL_LONG)).astype(np.int64) * 1_000_000


REUSE_EVENT = "cache_key string, t long, kind int, prediction_id string, fraud_probability double, epoch long, expires long"
REUSE_OUT = "cache_key string, kind int, prediction_id string, cache_hit boolean, ttl_seconds int, t long, expires long, epoch long"
_STORED, _DROP, _ASK = 0, 1, 2  # a carried entry, an invalidation of the key, a request; in this order at equal times


def _with_epochs(batches: Iterator[pa.RecordBatch], clears: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
    """Sets the epoch of requests and drops: ``base`` and the clearings up to their time. Carried entries keep theirs."""
    at = [c.split()[0] for c in REUSE_EVENT.split(", ")].index("epoch")
    for batch in batches:
        own = np.nan_to_num(batch.column("epoch").to_numpy(zero_copy_only=False).astype(float))
        now = base + np.searchsorted(clears, batch.column("t").to_numpy(), "right")
        yield batch.set_column(at, "epoch", pa.array(np.where(batch.column("kind").to_numpy() == _STORED, own, now).astype(np.int64)))


def _reuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay rows that arrive in order of key, time and kind; a key's entry is all that is held between batches.

    An entry answers from when it is stored until it expires, its key is
    dropped or everything is cleared (the epoch changes). Between two stores
    all requests of a key are hits, so the loop runs per store, not per row.
    """
    names = [c.split()[0] for c in REUSE_OUT.split(", ")]
    key, expires, epoch = None, None, None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column("cache_key")
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        t, kind, own = (batch.column(c).to_numpy() for c in ("t", "kind", "epoch"))
        p, ends = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fraud_probability", "expires"))
        ttl = _ttl_us(np.nan_to_num(p, nan=0.5))
        hit, stored = np.zeros(len(t), bool), np.zeros(len(t), np.int64)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a].as_py() != key:
                key, expires, epoch = keys[a].as_py(), None, None
            stops = a + np.flatnonzero(kind[a:b] != _ASK)
            i = a
            while i < b:
                if kind[i] == _STORED:
                    expires, epoch = int(ends[i]), int(own[i])
                    i += 1
                elif kind[i] == _DROP:
                    expires = None
                    i += 1
                elif expires is not None and t[i] < expires and own[i] == epoch:
                    # hits up to the entry's end, a clearing or the key's next event
                    stop = stops[np.searchsorted(stops, i)] if len(stops) and stops[-1] > i else b
                    stop = min(stop, i + np.searchsorted(t[i:stop], expires), i + np.searchsorted(own[i:stop], epoch, "right"))
                    hit[i:stop] = True
                    i = int(stop)
                else:
                    expires, epoch = int(t[i] + ttl[i]), int(own[i])
                    stored[i] = expires
                    i += 1
        ask = kind == _ASK
        miss = ask & ~hit
        yield pa.RecordBatch.from_arrays([
            batch.column("cache_key"), batch.column("kind"), batch.column("prediction_id"), pa.array(hit, mask=~ask),
            pa.array((ttl // 1_000_000).astype(np.int32), mask=~miss), batch.column("t"), pa.array(stored, mask=~miss), batch.column("epoch")], names)


def score_reuse_sink(out_path: str, state_path: str, late_seconds: int = 10 * 86_400, ts: str = "created_at"):
    """A request whose canonical feature key holds a live stored score reuses it.

    Rows have ``kind`` (``score``, ``invalidate`` one key, ``invalidate_all``),
    ``cache_key``, ``prediction_id``, ``fraud_probability`` and ``ts``. Requests are
    decided in event-time order: rows wait until the newest event time is
    ``late_seconds`` past them, so a late row is decided as if it had come in
    time, and a score never answers a request from before it was stored. Rows
    later than that are dropped, as a watermark drops them. A batch writes its
    decisions, the waiting rows and the entries that are still live under its
    id; ``step(None, last + 1)`` decides what still waits when a stream has ended.

    Clearings are few (an administrator's act): their times are one sorted
    array. Rows of one key are decided by one task, which holds one entry.
    """
    from riskweave.operators.windows import micros
    columns = "kind string, cache_key string, prediction_id string, fraud_probability double, _t long"

    def step(batch: DataFrame | None, batch_id: int, spark=None) -> None:
        spark = batch.sparkSession if batch is not None else spark
        state = TimedState(state_path, late_seconds * 1_000_000, 0)
        before = state.horizon(spark, batch_id)
        last = max((i for i in partitions(spark, f"{state_path}/waiting", "_batch") if i < batch_id), default=None)
        rows, newest = None, None
        if batch is not None:
            fresh = batch.select("kind", "cache_key", "prediction_id", "fraud_probability", micros(ts).alias("_t")).where(F.col("_t").isNotNull())
            rows = fresh if before is None else fresh.where(F.col("_t") >= before)
        if last is not None:
            waiting = spark.read.schema(columns).parquet(f"{state_path}/waiting/_batch={last}")
            rows = waiting if rows is None else rows.unionByName(waiting)
        if rows is None:
            return
        rows = rows.persist()  # read by the decisions, the waiting rows and the clearings
        if batch is not None:
            newest = rows.agg(F.max("_t")).first()[0]
        known = [x for x in (newest, state.newest(spark, batch_id)) if x is not None]
        horizon = max(known) - state.late_us if known and batch is not None else None  # none: decide everything
        due = F.lit(True) if horizon is None else F.col("_t") < horizon
        rows.where(~due).write.mode("overwrite").parquet(f"{state_path}/waiting/_batch={batch_id}")
        ready = rows.where(due)
        clears = np.array(ready.where(F.col("kind") == "invalidate_all").agg(F.sort_array(F.collect_set("_t"))).first()[0], np.int64)  # few
        entry = f"{state_path}/entries/_batch={last}"
        base, entries = 0, None
        if last is not None and path_exists(spark, entry):
            entries = spark.read.schema(REUSE_EVENT).parquet(entry)
            base = spark.read.schema("epoch long").parquet(f"{state_path}/epoch/_batch={last}").first()[0]
        kind = F.when(F.col("kind") == "invalidate", _DROP).otherwise(_ASK)
        events = ready.where(F.col("kind") != "invalidate_all").select(
            "cache_key", F.col("_t").alias("t"), kind.alias("kind"), "prediction_id", "fraud_probability",
            F.lit(None).cast("long").alias("epoch"), F.lit(None).cast("long").alias("expires"))
        if entries is not None:
            events = events.unionByName(entries)
        order = ["cache_key", F.col("kind") != _STORED, "t", "kind", "prediction_id"]
        decided = events.repartition("cache_key").sortWithinPartitions(*order).select(
            *[c.split()[0] for c in REUSE_EVENT.split(", ")]).mapInArrow(
            lambda batches: _reuse(_with_epochs(batches, clears, base)), REUSE_OUT)
        log = f"{state_path}/decided/_batch={batch_id}"
        decided.write.mode("overwrite").parquet(log)
        decided = spark.read.schema(REUSE_OUT).parquet(log)
        decided.where(F.col("kind") == _ASK).select("prediction_id", "cache_hit", "ttl_seconds").write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}")
        _write_entries(spark, decided, entries, f"{state_path}", batch_id, horizon)
        spark.createDataFrame([(base + len(clears),)], "epoch long").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/epoch/_batch={batch_id}")
        state.commit(spark, batch_id, newest)
        rows.unpersist()
        # the batch before may still run again: what came before that is not read any more
        drop_before(spark, state_path, ("waiting", "entries", "epoch", "decided", "progress"), batch_id - 1)
    return step


def _write_entries(spark, decided: DataFrame, entries: DataFrame | None, path: str, batch_id: int, horizon: int | None) -> None:
    """The newest entry of every key that is not dropped and can still answer a request after the horizon."""
    held = decided.where(F.col("expires").isNotNull() | (F.col("kind") == _DROP)).select(
        "cache_key", "t", (F.col("kind") == _DROP).alias("gone"), "expires", "epoch")
    if entries is not None:
        held = held.unionByName(entries.select("cache_key", "t", F.lit(False).alias("gone"), "expires", "epoch"))
    newest = held.groupBy("cache_key").agg(F.max_by(F.struct("t", "gone", "expires", "epoch"), F.struct("t", ~F.col("gone"))).alias("e"))
    live = newest.where(~F.col("e.gone"))
    if horizon is not None:
        live = live.where(F.col("e.expires") > horizon)
    live.select("cache_key", F.col("e.t").alias("t"), F.lit(_STORED).alias("kind"), F.lit(None).cast("string").alias("prediction_id"),
                F.lit(None).cast("double").alias("fraud_probability"), F.col("e.epoch").alias("epoch"), F.col("e.expires").alias("expires")).write.mode("overwrite").parquet(
        f"{path}/entries/_batch={batch_id}")


def live_variant_metrics(stream: DataFrame) -> DataFrame:
    """Per-variant running sums (update mode); rates derive from them."""
    return stream.groupBy("variant").agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum("fraud_label").alias("fraud_predictions"),
        F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.sum("processing_time_ms").alias("latency_sum"), F.sum("fraud_probability").alias("probability_sum"))


def live_bandit(stream: DataFrame) -> DataFrame:
    """Per-arm pulls and reward sums (update mode)."""
    reward = F.when(F.col("fraud_label") == F.col("is_fraud"), 1.0).otherwise(0.0)
    return stream.groupBy("model_type").agg(F.count(F.lit(1)).alias("count"), F.sum(reward).alias("reward_sum"))


def dedupe_ingest(stream: DataFrame, key: str, watermark: str) -> DataFrame:
    """Drop repeated ids seen within the watermark delay."""
    return stream.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([key])


CANARY_STATE = ("batch_id long, n long, err long, lat double, status string, decided_at timestamp_ntz, "
                "canary_requests long, error_rate double, avg_latency_ms double")


def canary_health_sink(state_path: str, start, new: str = "v2", **criteria):
    """T07 (health): foreachBatch step of the canary state machine.

    The state is a small table with one row per micro-batch (running canary
    totals and the status). Each batch continues from the latest row of an
    earlier batch, evaluates every request in time order on top of it, and
    appends its row; a replayed batch id replaces nothing and is read back by
    batch id, so the sink is idempotent. Once promoted or rolled back the
    status is final.
    """
    from riskweave.operators.windows import canary_decision

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # no folder yet: first batch. A state that exists but can't be read is an error.
        prev_rows = spark.read.schema(CANARY_STATE).parquet(state_path).where(F.col("batch_id") < batch_id) \
            .orderBy(F.col("batch_id").desc()).limit(1).collect() if path_exists(spark, state_path) else []
        prev = prev_rows[0].asDict() if prev_rows else {"n": 0, "err": 0, "lat": 0.0, "status": "active",
                                                        "decided_at": None, "canary_requests": None,
                                                        "error_rate": None, "avg_latency_ms": None}
        new_rows = batch.where(F.col("variant") == new)
        tot = new_rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 500).alias("err"),
                           F.coalesce(F.sum("processing_time_ms"), F.lit(0.0)).alias("lat")).first()
        row = dict(prev)
        row.update(batch_id=batch_id, n=prev["n"] + tot["n"], err=prev["err"] + tot["err"],
                   lat=prev["lat"] + tot["lat"])
        if prev["status"] == "active":
            d = canary_decision(batch, "variant", new, "created_at", "transaction_id", start,
                                base=(prev["n"], prev["err"], prev["lat"]), **criteria).first()
            if d["status"] != "active":
                row.update(status=d["status"], decided_at=d["decided_at"], canary_requests=d["canary_requests"],
                           error_rate=d["error_rate"], avg_latency_ms=d["avg_latency_ms"])
        spark.createDataFrame([row], CANARY_STATE).write.mode("append").parquet(state_path)
    return step


def final_canary_state(spark, state_path: str) -> DataFrame:
    rows = spark.read.schema(CANARY_STATE).parquet(state_path)
    last = rows.agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch_id"]), "batch_id").alias("s"))
    return last.select("s.status", "s.decided_at", "s.canary_requests", "s.error_rate", "s.avg_latency_ms")


def rate_limit_sink(out_path: str, state_path: str, seconds: int = 60, limit: int = 100, late_seconds: int = 10 * 86_400,
                    key: str = "user_id", ts: str = "created_at", row_id: str = "transaction_id"):
    """T05 without per-key Python: a foreachBatch step over DataFrame windows, right for late rows.

    A batch meets the state rows of the stretches of time that its rows can
    see or be seen from, and counts with the skew-safe chunked trailing window.
    It writes its own rows and every earlier row that one of them comes to
    count for: the row of the highest batch id is the last word on a row
    (``runtime.final_updates``). Rows more than ``late_seconds`` behind the newest
    of the batches before are dropped, and state behind that is deleted.
    """
    from riskweave.operators.windows import micros, trailing_window
    window_us = seconds * 1_000_000

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = TimedState(state_path, late_seconds * 1_000_000, window_us)
        state.forget(spark, batch_id)
        horizon = state.horizon(spark, batch_id)
        rows = batch.select(key, row_id, ts).withColumn("_t", micros(ts)).where(F.col("_t").isNotNull())
        if horizon is not None:
            rows = rows.where(F.col("_t") >= horizon)
        state.write(rows, batch_id)
        # the written rows, not the source again
        rows = spark.read.schema(rows.schema).parquet(f"{state_path}/rows/_batch={batch_id}").select(*rows.columns)
        earlier = state.read(spark, batch_id, rows.schema, state.touched(rows)) if horizon is not None else None
        both = rows.withColumn("_new", F.lit(True))
        if earlier is not None:
            both = both.unionByName(earlier.withColumn("_new", F.lit(False)))
        counted = trailing_window(both, [key], ts, window_us - 1, {
            "requests_last_minute": F.count(F.lit(1)), "_fresh": F.count_if(F.col("_new"))})
        counted.where(F.col("_fresh") > 0).select(
            row_id, "requests_last_minute", (F.col("requests_last_minute") > F.lit(limit)).alias("rate_limited")
        ).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        state.commit(spark, batch_id, rows.agg(F.max("_t")).first()[0])
    return step
