"""Versioned feature table with expiry.

The store is an append-only long table

    entity_id string, feature_name string, version string, value_json string,
    written_at timestamp_ntz, expires_at timestamp_ntz, deleted boolean

Puts and deletes append rows; reads resolve "last write wins" with a
grouped ``max_by`` per (entity, feature, version) as of a time ``t`` and keep
it when it is live (not expired, not a tombstone). Every operation is a
grouped aggregation or a join: no per-key round trips, and a hot entity is
just one more group in a partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TTL_SECONDS = 86_400
DEFAULT_VERSION = "v1"

STORE_COLUMNS = ["entity_id", "feature_name", "version", "value_json", "written_at", "expires_at", "deleted"]


def _ttl(ttl_seconds: int | Column) -> Column:
    t = ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(int(ttl_seconds))
    return F.when(t <= 0, F.lit(DEFAULT_TTL_SECONDS)).otherwise(t)  # a ttl of 0 means the default


def put_wide(df: DataFrame, entity: Column, features: Sequence[str], written_at: Column,
             ttl_seconds: int | Column = DEFAULT_TTL_SECONDS, version: Column | str = DEFAULT_VERSION) -> DataFrame:
    """Turn a wide frame into store rows (one per entity x feature)."""
    ver = version if isinstance(version, Column) else F.lit(version)
    base = df.select(entity.alias("entity_id"), ver.alias("version"), written_at.alias("written_at"),
                     _ttl(ttl_seconds).alias("_ttl"),
                     *[F.col(f).cast("string").alias(f) for f in features])
    long = base.unpivot(["entity_id", "version", "written_at", "_ttl"], list(features), "feature_name", "value_json")
    return long.select(
        "entity_id", "feature_name", "version", "value_json", "written_at",
        (F.col("written_at") + F.make_dt_interval(secs=F.col("_ttl"))).alias("expires_at"),
        F.lit(False).alias("deleted"))


def tombstones(keys: DataFrame, at: Column) -> DataFrame:
    """Delete rows for (entity_id, feature_name, version) keys at time ``at``."""
    return keys.select("entity_id", "feature_name", "version", F.lit(None).cast("string").alias("value_json"),
                       at.alias("written_at"), at.alias("expires_at"), F.lit(True).alias("deleted"))


def latest(store: DataFrame, at: Column) -> DataFrame:
    """Last write per (entity, feature, version) with written_at <= at."""
    visible = store.where(F.col("written_at") <= at)
    last = F.max_by(F.struct("value_json", "expires_at", "deleted", "written_at"),
                    F.struct("written_at", F.col("deleted").cast("int"), "value_json"))
    return visible.groupBy("entity_id", "feature_name", "version").agg(last.alias("l")).select(
        "entity_id", "feature_name", "version", "l.value_json", "l.expires_at", "l.deleted", "l.written_at")


def get_live(store: DataFrame, at: Column) -> DataFrame:
    """Live values as of ``at`` (expired or deleted keys are absent; callers default them)."""
    lt = latest(store, at)
    return lt.where((F.col("expires_at") > at) & ~F.col("deleted")).select(
        "entity_id", "feature_name", "version", "value_json")


def get_with_default(store: DataFrame, keys: DataFrame, at: Column, default: str | None = None) -> DataFrame:
    """K02 for requested keys: missing, expired or deleted -> ``default``."""
    live = get_live(store, at)
    return keys.join(live, ["entity_id", "feature_name", "version"], "left").select(
        "entity_id", "feature_name", "version", F.coalesce("value_json", F.lit(default)).alias("value_json"))


def get_many(store: DataFrame, requests: DataFrame, at: Column, as_map: bool = False) -> DataFrame:
    """Requested (entity_id, feature_name, version) keys joined with live
    values; keys without a live value are omitted. ``as_map`` folds each
    entity's values into one ``map<feature, value>`` (bounded by the number
    of requested feature names)."""
    live = get_live(store, at)
    found = requests.join(live, ["entity_id", "feature_name", "version"], "inner")
    if not as_map:
        return found
    return found.groupBy("entity_id", "version").agg(
        F.map_from_entries(F.collect_list(F.struct("feature_name", "value_json"))).alias("features"))


def get_wide(store: DataFrame, at: Column, features: Sequence[str], version: str = DEFAULT_VERSION) -> DataFrame:
    """One row per entity, one column per feature (missing -> null)."""
    live = get_live(store, at).where(F.col("version") == version)
    return live.groupBy("entity_id").pivot("feature_name", list(features)).agg(F.first("value_json"))


def delete_existing(store: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """For each key to delete, whether a live value existed (the delete's result)."""
    live = get_live(store, at).select("entity_id", "feature_name", "version", F.lit(True).alias("_live"))
    return keys.join(live, ["entity_id", "feature_name", "version"], "left").select(
        "entity_id", "feature_name", "version", F.coalesce("_live", F.lit(False)).alias("existed"))


def merge_metadata(meta: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Per (name, version): first created_at, last updated_at, and per
    attribute the latest non-null value (later writes win)."""
    aggs = [F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")]
    for a in attrs:
        aggs.append(F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("updated_at"))).alias(a))
    return meta.groupBy("name", "version").agg(*aggs)


def value_kind(value_json: Column) -> Column:
    """K07: 'json' when the text parses as JSON, else 'float' when it is a number, else 'string'."""
    return (F.when(F.try_parse_json(value_json).isNotNull(), F.lit("json"))
            .when(value_json.try_cast("double").isNotNull(), F.lit("float"))
            .otherwise(F.lit("string")))


def live_key_stats(store: DataFrame, at: Column) -> DataFrame:
    """Number of live keys per version."""
    return get_live(store, at).groupBy("version").agg(F.count(F.lit(1)).alias("live_keys"))


def write_snapshot(store: DataFrame, at: Column, name: str, path: str, buckets: int) -> DataFrame:
    """K05 compacted: the values that are live at ``at``, as a table by version, bucketed by entity and feature.

    Expired and deleted keys, and all writes but the last, are left behind.
    With the log after ``at`` (the tail) it answers every read from then on.
    """
    live = latest(store, at).where((F.col("expires_at") > at) & ~F.col("deleted")).drop("deleted")
    keys = ["entity_id", "feature_name"]
    live.repartition(buckets, *keys).write.partitionBy("version").bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", path).mode("overwrite").saveAsTable(name)
    return store.sparkSession.table(name)


def get_live_compacted(snapshot: DataFrame, tail: DataFrame, at: Column, version: str) -> DataFrame:
    """K02 from a snapshot and the rows written after it, for one version, at any time after the snapshot.

    The tail's last writes are shuffled to the snapshot's buckets; the snapshot is read where it lies.
    """
    keys = ["entity_id", "feature_name"]
    old = snapshot.where(F.col("version") == version).select(*keys, F.col("value_json").alias("_old"), F.col("expires_at").alias("_old_until"))
    new = latest(tail.where(F.col("version") == version), at).select(*keys, "value_json", "expires_at", "deleted", F.lit(True).alias("_new"))
    both = old.hint("merge").join(new, keys, "full_outer")
    until = F.when(F.col("_new"), F.col("expires_at")).otherwise(F.col("_old_until"))
    return both.where((until > at) & ~F.coalesce("deleted", F.lit(False))).select(
        *keys, F.lit(version).alias("version"), F.when(F.col("_new"), F.col("value_json")).otherwise(F.col("_old")).alias("value_json"))
