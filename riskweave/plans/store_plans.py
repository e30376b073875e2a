"""Registered queries: feature store (K01-K09) and its statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.operators import featurestore as fs
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.session import scratch_path, shuffle_partitions
from riskweave.sources.tables import prediction_logs, with_ctes

RAW = ["amount", "hour", "device_score", "country_risk"]
AT = "2024-01-20 12:00:00"
AT_VERSIONS = "2024-01-16 06:00:00"
STORE_FEATURES = ["amount", "amount_log", "hour", "is_night", "is_evening", "device_score", "low_device",
                  "country_risk", "high_risk_country", "risk_score"]


def _at(ts: str):
    return F.lit(ts).cast("timestamp_ntz")


def _entity():
    return F.concat(F.lit("user"), F.col("user_id").cast("string"))


def raw_store(spark, sf_dir):
    """Store rows: every log row puts the raw features of its user (default TTL, version by model)."""
    logs = prediction_logs(spark, sf_dir)
    return fs.put_wide(logs, _entity(), RAW, F.col("created_at"), ttl_seconds=0, version=F.col("model_version"))


_STORE_SQL = "store AS (" + " UNION ALL ".join(
    f"""SELECT 'user' || CAST(user_id AS VARCHAR) AS entity_id, '{c}' AS feature_name, model_version AS version,
        CAST({c} AS VARCHAR) AS value_json, created_at AS written_at, created_at + INTERVAL 86400 SECOND AS expires_at,
        false AS deleted FROM logs""" for c in RAW) + ")"


def _latest_sql(at: str, where: str = "") -> str:
    return f"""lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name, version
        ORDER BY written_at DESC, deleted DESC) AS rn FROM store WHERE written_at <= TIMESTAMP '{at}' {where}) WHERE rn = 1),
live AS (SELECT entity_id, feature_name, version, value_json FROM lt
        WHERE expires_at > TIMESTAMP '{at}' AND NOT deleted)"""


@register("K01", with_ctes("""SELECT entity_id, feature_name, version, round(CAST(value_json AS DOUBLE), 9) AS value,
    written_at, expires_at, deleted FROM store""", "logs", extra=[_STORE_SQL]))
def q_k01(spark, sf_dir):
    """Put: wide log rows -> long store rows with written_at / expires_at."""
    st = raw_store(spark, sf_dir)
    return st.select("entity_id", "feature_name", "version", r9(F.col("value_json").cast("double"), "value"),
                     "written_at", "expires_at", "deleted")


@register("K02", with_ctes("""SELECT entity_id, feature_name, round(CAST(value_json AS DOUBLE), 9) AS value
    FROM live WHERE version = 'v2'""", "logs", extra=[_STORE_SQL, _latest_sql(AT)]))
def q_k02(spark, sf_dir):
    """Get latest live value per (entity, feature) as of a time (last write wins, expiry applied)."""
    live = fs.get_live(raw_store(spark, sf_dir), _at(AT)).where(F.col("version") == "v2")
    return live.select("entity_id", "feature_name", r9(F.col("value_json").cast("double"), "value"))


@register("K03", with_ctes("SELECT entity_id, " + ", ".join(
    f"round(CAST(max(value_json) FILTER (WHERE feature_name = '{c}') AS DOUBLE), 9) AS {c}" for c in RAW) +
    " FROM live WHERE version = 'v2' GROUP BY entity_id", "logs", extra=[_STORE_SQL, _latest_sql(AT)]))
def q_k03(spark, sf_dir):
    """Get all features of every entity as one wide row."""
    wide = fs.get_wide(raw_store(spark, sf_dir), _at(AT), RAW, version="v2")
    return wide.select("entity_id", *[r9(F.col(c).cast("double"), c) for c in RAW])


_DEL_KEYS_SQL = """dk AS (SELECT DISTINCT 'user' || CAST(user_id AS VARCHAR) AS entity_id, f.feature_name, 'v2' AS version
    FROM logs, (VALUES ('amount'), ('hour'), ('device_score'), ('country_risk')) f(feature_name)
    WHERE country_risk = 5)"""


def _delete_keys(spark, sf_dir):
    logs = prediction_logs(spark, sf_dir).where(F.col("country_risk") == 5)
    feats = F.explode(F.array(*[F.lit(c) for c in RAW]))
    return logs.select(_entity().alias("entity_id"), feats.alias("feature_name"),
                       F.lit("v2").alias("version")).distinct()


@register("K04", with_ctes("""SELECT dk.entity_id, dk.feature_name, dk.version, live.entity_id IS NOT NULL AS existed, false AS live_after
    FROM dk LEFT JOIN live USING (entity_id, feature_name, version)""", "logs",
                           extra=[_STORE_SQL, _latest_sql(AT), _DEL_KEYS_SQL]))
def q_k04(spark, sf_dir):
    """Delete the keys of every highest-risk user: did a live value exist, and does the store still answer them?"""
    path = scratch_path(spark, f"k04-{uuid.uuid4().hex[:12]}")
    raw_store(spark, sf_dir).select(*fs.STORE_COLUMNS).write.parquet(path)
    store = spark.read.parquet(path)
    keys = _delete_keys(spark, sf_dir)
    told = scratch_path(spark, f"k04-told-{uuid.uuid4().hex[:12]}")
    fs.delete_existing(store, keys, _at(AT)).write.parquet(told)  # before the tombstones are there
    fs.tombstones(keys, _at(AT)).select(*fs.STORE_COLUMNS).write.mode("append").parquet(path)
    after = fs.delete_existing(spark.read.parquet(path), keys, _at(AT)).withColumnRenamed("existed", "live_after")
    return spark.read.parquet(told).join(after, ["entity_id", "feature_name", "version"])


_AFTER_DELETE_SQL = f"""gone AS (SELECT DISTINCT 'user' || CAST(user_id AS VARCHAR) AS entity_id FROM logs WHERE country_risk = 5)"""


@register("K02C", with_ctes("""SELECT entity_id, feature_name, round(CAST(value_json AS DOUBLE), 9) AS value
    FROM lt WHERE version = 'v2' AND expires_at > TIMESTAMP '2024-01-20 12:00:00'
      AND NOT (entity_id IN (SELECT entity_id FROM gone) AND written_at <= TIMESTAMP '2024-01-20 06:00:00')""",
                            "logs", extra=[_STORE_SQL, _latest_sql(AT), _AFTER_DELETE_SQL]))
def q_k02c(spark, sf_dir):
    """Latest live values from the compacted store: a snapshot of 19 January, and the tail since with deletes of the 20th."""
    tag, at = uuid.uuid4().hex[:12], _at("2024-01-19 12:00:00")
    store = raw_store(spark, sf_dir).select(*fs.STORE_COLUMNS)
    snapshot = fs.write_snapshot(store, at, f"rw_store_{tag}", scratch_path(spark, f"k02c-{tag}"), shuffle_partitions(spark))
    tail = scratch_path(spark, f"k02c-tail-{tag}")
    store.where(F.col("written_at") > at).write.parquet(tail)
    fs.tombstones(_delete_keys(spark, sf_dir), _at("2024-01-20 06:00:00")).select(*fs.STORE_COLUMNS).write.mode("append").parquet(tail)
    live = fs.get_live_compacted(snapshot, spark.read.parquet(tail), _at(AT), "v2")
    return live.select("entity_id", "feature_name", r9(F.col("value_json").cast("double"), "value"))


@register("A17", with_ctes("SELECT version, count(*) AS live_keys FROM live GROUP BY version", "logs",
                           extra=[_STORE_SQL, _latest_sql(AT_VERSIONS)]))
def q_a17(spark, sf_dir):
    """Feature-store statistics: live keys per version namespace."""
    return fs.live_key_stats(raw_store(spark, sf_dir), _at(AT_VERSIONS))


@register("K05", with_ctes("""SELECT entity_id, feature_name, version, round(CAST(value_json AS DOUBLE), 9) AS value
    FROM live""", "logs", extra=[_STORE_SQL, _latest_sql(AT_VERSIONS)]))
def q_k05(spark, sf_dir):
    """Versioned namespaces: live values of both model versions side by side."""
    live = fs.get_live(raw_store(spark, sf_dir), _at(AT_VERSIONS))
    return live.select("entity_id", "feature_name", "version", r9(F.col("value_json").cast("double"), "value"))


@register("K06", with_ctes("""SELECT feature_name AS name, version, min(created_at) AS created_at,
    max(updated_at) AS updated_at, arg_max(dtype, updated_at) AS dtype, arg_max(rows, updated_at) AS rows
    FROM (SELECT feature_name, version, min(written_at) AS created_at, max(written_at) AS updated_at,
                 CASE WHEN feature_name IN ('hour', 'country_risk') THEN 'int' ELSE 'double' END AS dtype,
                 CAST(count(*) AS VARCHAR) AS rows
          FROM store GROUP BY feature_name, version, CAST(written_at AS DATE)) GROUP BY 1, 2""",
                           "logs", extra=[_STORE_SQL]))
def q_k06(spark, sf_dir):
    """Metadata merge: daily metadata writes merged (created kept, updated latest, later keys win)."""
    st = raw_store(spark, sf_dir)
    meta = st.groupBy(F.col("feature_name").alias("name"), "version", F.to_date("written_at").alias("_day")).agg(
        F.min("written_at").alias("created_at"), F.max("written_at").alias("updated_at"),
        F.count(F.lit(1)).cast("string").alias("rows"))
    meta = meta.withColumn("dtype", F.when(F.col("name").isin("hour", "country_risk"), "int").otherwise("double"))
    return fs.merge_metadata(meta, ["dtype", "rows"])


# DuckDB's JSON reader accepts bare inf; a strict JSON parser (the reference's) does not.
_K07_SQL = """kinds AS (SELECT feature_name, CASE WHEN json_valid(value_json)
             AND lower(value_json) NOT IN ('inf', '-inf', '+inf') THEN 'json'
        WHEN TRY_CAST(value_json AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind FROM (
    SELECT 'amount' AS feature_name, CAST(amount AS VARCHAR) AS value_json FROM logs
    UNION ALL SELECT 'merchant', merchant_id FROM logs
    UNION ALL SELECT 'profile', '{"hour":' || CAST(hour AS VARCHAR) || ',"country_risk":' || CAST(country_risk AS VARCHAR) || '}' FROM logs
    UNION ALL SELECT 'limit', CASE WHEN amount > 300 THEN 'inf' ELSE CAST(hour AS VARCHAR) END FROM logs))"""


@register("K07", with_ctes("SELECT feature_name, kind, count(*) AS n FROM kinds GROUP BY ALL", "logs", extra=[_K07_SQL]))
def q_k07(spark, sf_dir):
    """Value typing of stored texts: JSON, else float, else string."""
    logs = prediction_logs(spark, sf_dir).withColumns({
        "merchant": F.col("merchant_id"),
        "profile": F.to_json(F.struct("hour", "country_risk")),
        "limit": F.when(F.col("amount") > 300, F.lit("inf")).otherwise(F.col("hour").cast("string"))})
    st = fs.put_wide(logs, _entity(), ["amount", "merchant", "profile", "limit"], F.col("created_at"))
    return st.groupBy("feature_name", fs.value_kind(F.col("value_json")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


_K08_SQL = "feat_store AS (" + " UNION ALL ".join(
    f"""SELECT 'user' || CAST(user_id AS VARCHAR) AS entity_id, '{c}' AS feature_name, 'v1' AS version, {expr} AS value,
        created_at AS written_at, created_at + INTERVAL 3600 SECOND AS expires_at, false AS deleted FROM logs"""
    for c, expr in [
        ("amount", "amount"), ("amount_log", "ln(1 + amount)"), ("hour", "hour"),
        ("is_night", "CASE WHEN hour BETWEEN 0 AND 5 THEN 1 ELSE 0 END"),
        ("is_evening", "CASE WHEN hour BETWEEN 18 AND 23 THEN 1 ELSE 0 END"), ("device_score", "device_score"),
        ("low_device", "CASE WHEN device_score < 0.3 THEN 1 ELSE 0 END"), ("country_risk", "country_risk"),
        ("high_risk_country", "CASE WHEN country_risk >= 4 THEN 1 ELSE 0 END"),
        ("risk_score", "(CASE WHEN device_score < 0.3 THEN 1 ELSE 0 END) * 0.3::DOUBLE + "
                       "(CASE WHEN country_risk >= 4 THEN 1 ELSE 0 END) * 0.2::DOUBLE + "
                       "(CASE WHEN hour BETWEEN 0 AND 5 THEN 1 ELSE 0 END) * 0.2::DOUBLE")]) + ")"


@register("K08", with_ctes(f"""SELECT entity_id, feature_name, round(CAST(value AS DOUBLE), 9) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY written_at DESC) AS rn
    FROM feat_store WHERE written_at <= TIMESTAMP '{AT}') WHERE rn = 1 AND expires_at > TIMESTAMP '{AT}'""",
                           "logs", extra=[_K08_SQL]))
def q_k08(spark, sf_dir):
    """Compute the store features and put them (TTL 1 h); read back what is live."""
    logs = prediction_logs(spark, sf_dir)
    feats = fe.store_features(logs)
    st = fs.put_wide(feats, _entity(), STORE_FEATURES, F.col("created_at"), ttl_seconds=3600)
    live = fs.get_live(st, _at(AT))
    return live.select("entity_id", "feature_name", r9(F.col("value_json").cast("double"), "value"))


_CACHED_SQL = " UNION ALL ".join(
    f"""SELECT {e} AS entity_id, '{c}' AS feature_name, CAST({c} AS VARCHAR) AS value_json, created_at AS written_at FROM logs"""
    for e in ("'user' || CAST(user_id AS VARCHAR) || ':' || merchant_id", "'user' || CAST(user_id AS VARCHAR)") for c in RAW)


@register("K09", with_ctes(f"""SELECT entity_id, feature_name, round(CAST(value_json AS DOUBLE), 9) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY written_at DESC, value_json DESC) AS rn
    FROM ({_CACHED_SQL}) WHERE written_at <= TIMESTAMP '{AT}')
    WHERE rn = 1 AND written_at + INTERVAL 3600 SECOND > TIMESTAMP '{AT}'""", "logs"))
def q_k09(spark, sf_dir):
    """Cached features by user and by user:merchant with a 1 h TTL: all live entries at a time."""
    logs = prediction_logs(spark, sf_dir)
    st = None
    for entity in (F.concat(_entity(), F.lit(":"), F.col("merchant_id")), _entity()):
        rows = fs.put_wide(logs, entity, RAW, F.col("created_at"), ttl_seconds=3600)
        st = rows if st is None else st.unionByName(rows)
    live = fs.get_live(st, _at(AT))
    return live.select("entity_id", "feature_name", r9(F.col("value_json").cast("double"), "value"))


_REQ_SQL = """rq AS (SELECT DISTINCT 'user' || CAST(user_id AS VARCHAR) AS entity_id, f.feature_name, 'v2' AS version
    FROM logs, (VALUES ('amount'), ('hour'), ('risk'), ('device_score')) f(feature_name) WHERE country_risk >= 4)"""


@register("J03", with_ctes("""SELECT rq.entity_id, rq.feature_name, round(CAST(live.value_json AS DOUBLE), 9) AS value
    FROM rq JOIN live USING (entity_id, feature_name, version)""", "logs",
                           extra=[_STORE_SQL, _latest_sql(AT), _REQ_SQL]))
def q_j03(spark, sf_dir):
    """Multi-key feature lookup: named features per entity, missing ones omitted."""
    logs = prediction_logs(spark, sf_dir).where(F.col("country_risk") >= 4)
    names = F.explode(F.array(*[F.lit(c) for c in ["amount", "hour", "risk", "device_score"]]))
    req = logs.select(_entity().alias("entity_id"), names.alias("feature_name"), F.lit("v2").alias("version")).distinct()
    out = fs.get_many(raw_store(spark, sf_dir), req, _at(AT))
    return out.select("entity_id", "feature_name", r9(F.col("value_json").cast("double"), "value"))
