"""Feature store: put, expiry, last write wins, delete, versions, typing."""

from pyspark.sql import functions as F

from riskweave.operators import featurestore as fs


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


def _store(spark):
    rows = [("u1", 1.0, "2024-01-01 00:00:00", 0, "v1"), ("u1", 2.0, "2024-01-01 01:00:00", 60, "v1"),
            ("u2", 5.0, "2024-01-01 00:00:00", 86400, "v1"), ("u2", 7.0, "2024-01-01 00:30:00", 0, "v2")]
    df = spark.createDataFrame(rows, "e string, x double, t string, ttl int, v string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    return fs.put_wide(df, F.col("e"), ["x"], F.col("t"), ttl_seconds=F.col("ttl"), version=F.col("v"))


def test_ttl_zero_means_default(spark):
    st = _store(spark)
    first = st.where((F.col("entity_id") == "u1") & (F.col("value_json") == "1.0")).first()
    assert (first.expires_at - first.written_at).total_seconds() == fs.DEFAULT_TTL_SECONDS


def test_last_write_wins_and_expiry(spark):
    st = _store(spark)
    live = {(r.entity_id, r.version): r.value_json for r in fs.get_live(st, _ts("2024-01-01 01:00:30")).collect()}
    assert live[("u1", "v1")] == "2.0"
    assert live[("u2", "v1")] == "5.0" and live[("u2", "v2")] == "7.0"
    later = {(r.entity_id, r.version) for r in fs.get_live(st, _ts("2024-01-01 01:02:00")).collect()}
    assert ("u1", "v1") not in later  # newest write expired after 60 s; an older write does not come back


def test_delete_and_default(spark):
    st = _store(spark)
    keys = spark.createDataFrame([("u2", "x", "v1"), ("u9", "x", "v1")], "entity_id string, feature_name string, version string")
    existed = {r.entity_id: r.existed for r in fs.delete_existing(st, keys, _ts("2024-01-01 02:00:00")).collect()}
    assert existed == {"u2": True, "u9": False}
    st2 = st.unionByName(fs.tombstones(keys, _ts("2024-01-01 02:00:00")))
    got = {r.entity_id: r.value_json for r in fs.get_with_default(st2, keys, _ts("2024-01-01 03:00:00"), "none").collect()}
    assert got == {"u2": "none", "u9": "none"}


def test_value_kind(spark):
    df = spark.createDataFrame([("0.5",), ('{"a": 1}',), ("inf",), ("click",)], "v string")
    kinds = [r.k for r in df.select(fs.value_kind(F.col("v")).alias("k")).collect()]
    assert kinds == ["json", "json", "float", "string"]


def test_metadata_merge(spark):
    meta = spark.createDataFrame([
        ("f", "v1", "2024-01-01", "2024-01-01", "double", "x"),
        ("f", "v1", "2024-01-02", "2024-01-03", None, "y")],
        "name string, version string, created_at string, updated_at string, dtype string, source string")
    r = fs.merge_metadata(meta, ["dtype", "source"]).first()
    assert (r.created_at, r.updated_at, r.dtype, r.source) == ("2024-01-01", "2024-01-03", "double", "y")
