"""Routing hashes against Python's hashlib (FIXTURES.md: users user0..user99, user123)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from riskweave.functions.hashing import md5_mod, md5_unit_bucket, normalise_weights
from riskweave.operators import routing as ro


def _py_route(user, variants):
    variants = normalise_weights(variants)
    b = int.from_bytes(hashlib.md5(user.encode()).digest()[:4], "big") / 2 ** 32
    cum = 0.0
    for k, w in variants.items():
        cum += w
        if b < cum:
            return k
    return list(variants)[0]


@pytest.mark.parametrize("variants", [{"a": .5, "b": .5}, {"a": .8, "b": .2}, {"a": 2, "b": 1, "c": 1}])
def test_weighted_routing_matches_python(spark, variants):
    users = [f"user{i}" for i in range(100)] + ["user123"]
    df = spark.createDataFrame([(u,) for u in users], "u string")
    got = {r.u: r.variant for r in ro.route_weighted(df, F.col("u"), variants).collect()}
    assert got == {u: _py_route(u, variants) for u in users}


def test_percent_routing_and_bucket(spark):
    users = [f"user{i}" for i in range(100)]
    df = spark.createDataFrame([(u,) for u in users], "u string")
    rows = df.select("u", md5_mod(F.col("u"), 100).alias("m"), md5_unit_bucket(F.col("u")).alias("b")).collect()
    for r in rows:
        assert r.m == int(hashlib.md5(r.u.encode()).hexdigest(), 16) % 100
        assert r.b == int.from_bytes(hashlib.md5(r.u.encode()).digest()[:4], "big") / 2 ** 32
    routed = ro.route_percent(df, F.col("u"), F.lit(None).cast("string"), F.lit("r"), 50.0).collect()
    for r in routed:
        want = "A" if (int(hashlib.md5(r.u.encode()).hexdigest(), 16) % 100) / 100 < 0.5 else "B"
        assert r.variant == want


def test_canary_routing(spark):
    df = spark.createDataFrame([(f"user{i}",) for i in range(100)], "u string")
    got = {r.u: r.variant for r in ro.route_canary(df, F.col("u"), 0.1, "new", "cur").collect()}
    for u, v in got.items():
        b = int.from_bytes(hashlib.md5(f"canary:{u}".encode()).digest()[:4], "big") / 2 ** 32
        assert v == ("new" if b < 0.1 else "cur")
