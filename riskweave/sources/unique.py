"""Tables whose rows have unique keys (S06, S07), kept so by key filters instead of reading history.

A table is a folder of appends. Append N has its rows (``data/append=N``), its
keys by hash bucket (``keys/append=N/bucket=B``) and a Bloom filter per bucket
(``filters/append=N``: bitmaps of 32,768 bits by bucket and slot, from Spark's
bitmap aggregates). A batch probes the filters; only keys that may be known are
looked up, in the key files of their buckets, by an exact join. An append of
new keys therefore opens no old data file, and no key file but for the filter's
false alarms. An append counts once ``commits/append=N`` is there; one that
failed before is written over by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.streaming.state import partitions

BUCKETS = 32
SLOTS = 16  # bitmaps per bucket: BUCKETS * SLOTS * 32768 / 10 keys at about 2 % false alarms; more keys cost reads, not results
HASHES = 4
_BITS = 32_768


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def _positions(rows: DataFrame, key: str, slots: int) -> DataFrame:
    """(key, bucket, slot, bit): a key's places in the filter of its bucket."""
    places = F.explode(F.array(*[F.struct(F.pmod(F.xxhash64(F.col(key), F.lit(j)), F.lit(slots * _BITS)).alias("at")) for j in range(1, HASHES + 1)]))
    return rows.select(key, _bucket(key).alias("bucket"), places.alias("p")).select(
        key, "bucket", F.floor(F.col("p.at") / _BITS).cast("int").alias("slot"), (F.col("p.at") % _BITS).alias("bit"))


def key_filters(rows: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """(bucket, slot, bits) of the rows' keys."""
    return _positions(rows, key, slots).groupBy("bucket", "slot").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def may_be_known(rows: DataFrame, key: str, filters: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, bucket) of the rows that every place of the filters has a bit for."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    whole = filters.groupBy("bucket", "slot").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    hits = _positions(rows, key, slots).distinct().join(whole, ["bucket", "slot"]).where(is_set)
    needed = _positions(rows, key, slots).distinct().groupBy(key, "bucket").agg(F.count("*").alias("need"))
    return hits.groupBy(key, "bucket").agg(F.count("*").alias("have")).join(needed, [key, "bucket"]).where("have = need").select(key, "bucket")


def appends(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the appends that count."""
    return partitions(spark, f"{path}/commits", "append")


def read_unique(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the table, in ``schema``."""
    done = appends(spark, path)
    rows = spark.read.schema(schema)
    return rows.parquet(*[f"{path}/data/append={n}" for n in done]) if done else spark.createDataFrame([], schema)


def append_unique(spark: SparkSession, path: str, batch: DataFrame, key: str, order: str, slots: int = SLOTS) -> dict:
    """Append the rows whose ``key`` is new; of rows of the batch that share a key the first by ``order`` stays, ties to the least row.

    Rows without a key are rejected. Returns the counts of appended and rejected
    rows and of the key buckets that had to be read.
    """
    done = appends(spark, path)
    number = (done[-1] + 1) if done else 0
    rest = [c for c in batch.columns if c != key]
    row = F.struct(order, *[c for c in rest if c != order])  # the order column leads, so the least struct is the first row
    staged = f"{path}/staging/append={number}"  # the batch is computed once
    batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("_r"), F.count("*").alias("_n")).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    given = rows.agg(F.sum("_n")).first()[0] or 0
    new, buckets = rows, []
    if done:
        filters = spark.read.schema("bucket int, slot int, bits binary").parquet(*[f"{path}/filters/append={n}" for n in done])
        suspects = may_be_known(rows.select(key), key, filters, slots).checkpoint(eager=True)
        buckets = sorted(r[0] for r in suspects.select("bucket").distinct().collect())  # at most BUCKETS
        if buckets:
            known = spark.read.option("basePath", f"{path}/keys").parquet(*[f"{path}/keys/append={n}" for n in done]).where(
                F.col("bucket").isin(buckets)).join(
                suspects.select(key), key, "left_semi").select(key)
            new = rows.join(known, key, "left_anti")
    folder = f"append={number}"
    new.select(key, "_r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/data/{folder}")
    keys = spark.read.schema(batch.schema).parquet(f"{path}/data/{folder}").select(key)
    keys.withColumn("bucket", _bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/{folder}")
    key_filters(keys, key, slots).write.mode("overwrite").parquet(f"{path}/filters/{folder}")
    appended = keys.count()
    spark.createDataFrame([(appended,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{folder}")
    return {"appended": appended, "rejected": int(given) - appended, "buckets_read": len(buckets)}
