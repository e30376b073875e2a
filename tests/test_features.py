"""Feature expressions on the small frames of the reference's tests (FIXTURES.md section 2)."""

import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions import features as fe

SCHEMA = "amount double, hour int, device_score double, country_risk int"


def _eng(spark, rows, stats=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r.asDict() for r in fe.engineer(df, stats).collect()]


def test_mixed_frame(spark):
    rows = [(100.0, 10, .9, 1), (500.0, 14, .8, 2), (2000.0, 3, .2, 5), (5000.0, 22, .1, 4), (100.0, 12, .95, 1)]
    out = _eng(spark, rows)
    assert [r["is_night"] for r in out] == [0, 0, 1, 0, 0]
    assert [r["is_evening"] for r in out] == [0, 0, 0, 1, 0]
    assert [r["low_device"] for r in out] == [0, 0, 1, 1, 0]
    assert [r["high_risk_country"] for r in out] == [0, 0, 1, 1, 0]
    # p75 of (100,100,500,2000,5000) = 2000 (linear) -> strictly greater only 5000
    assert [r["high_amount"] for r in out] == [0, 0, 0, 1, 0]
    mean = sum(r[0] for r in rows) / 5
    std = math.sqrt(sum((r[0] - mean) ** 2 for r in rows) / 4)  # ddof = 1
    assert out[3]["amount_zscore"] == pytest.approx((5000 - mean) / std)
    assert out[3]["risk_score"] == pytest.approx(0.3 + 0.3 + 0.2)
    assert list(out[0].keys())[:4] == ["amount", "hour", "device_score", "country_risk"]


def test_zero_amount_log(spark):
    out = _eng(spark, [(0.0, 12, .5, 2), (10.0, 1, .5, 2)])
    assert out[0]["amount_log"] == 0.0


def test_boundary_hours_follow_code(spark):
    out = _eng(spark, [(10.0, 0, .5, 2), (10.0, 23, .5, 2)])
    assert out[0]["is_night"] == 1 and out[1]["is_night"] == 0  # code says 0-5; 23 is evening
    assert out[1]["is_evening"] == 1
    assert out[0]["hour_sin"] == pytest.approx(0.0)
    assert out[0]["hour_cos"] == pytest.approx(1.0)


def test_interactions(spark):
    out = _eng(spark, [(1000.0, 12, .5, 3), (10.0, 12, .5, 3)])
    assert out[0]["amount_device_interaction"] == pytest.approx(500.0)
    assert out[0]["amount_country_interaction"] == pytest.approx(600.0)


def test_single_row_refit_matches_reference(spark):
    # one row: sample std is undefined and the row is never above its own p75
    out = _eng(spark, [(5000.0, 3, .1, 5)])
    assert out[0]["high_amount"] == 0
    assert out[0]["amount_zscore"] is None or math.isnan(out[0]["amount_zscore"])


def test_frozen_stats_apply(spark):
    train = spark.createDataFrame([(100.0, 1, .5, 1), (200.0, 1, .5, 1), (300.0, 1, .5, 1)], SCHEMA)
    stats = fe.fit_feature_stats(train)
    out = _eng(spark, [(5000.0, 3, .1, 5)], stats)
    assert out[0]["high_amount"] == 1 and out[0]["very_high_amount"] == 1
    assert out[0]["amount_zscore"] == pytest.approx((5000 - 200) / 100)


def test_fixed_threshold_variant(spark):
    df = spark.createDataFrame([(5000.0, 3, .1, 5), (400.0, 12, .9, 1)], SCHEMA)
    out = [r.asDict() for r in fe.engineer_fixed(df).collect()]
    assert out[0]["high_amount"] == 1 and out[0]["very_high_amount"] == 1
    assert out[1]["high_amount"] == 0 and out[0]["amount_zscore"] == 0.0


def test_scaling_population_std(spark):
    train = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "amount double")
    val = spark.createDataFrame([(150.0,)], "amount double")
    sc = fe.fit_scaler(train, ["amount"])
    tr = [r.amount for r in fe.apply_scaler(train, sc, ["amount"]).collect()]
    assert sum(tr) == pytest.approx(0.0)
    assert tr[2] == pytest.approx(100 / math.sqrt(20000 / 3))  # ddof = 0
    v = fe.apply_scaler(val, sc, ["amount"]).first().amount
    assert v == pytest.approx(-50 / math.sqrt(20000 / 3))
    const = spark.createDataFrame([(7.0,), (7.0,)], "amount double")
    assert fe.apply_scaler(const, fe.fit_scaler(const, ["amount"]), ["amount"]).first().amount == 0.0


def test_rule_reasons(spark):
    df = spark.createDataFrame([(5000.0, 3, .1, 5, 1), (100.0, 12, .9, 1, 1), (100.0, 12, .9, 1, 0)],
                               SCHEMA + ", fraud_label int")
    out = [r.reasons for r in fe.rule_reasons(df).collect()]
    assert out[0] == ("Large Transaction Amount; Low Device Trust Score; High Risk Country; "
                      "Unusual Transaction Hour")
    assert out[1] == "Complex pattern detected by model logic."
    assert out[2] is None


def test_store_features_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    r = fe.store_features(df).first().asDict()
    assert r["amount"] == 0.0 and r["hour"] == 0 and r["is_night"] == 0  # flags use hour 12
    assert r["device_score"] == 0.5 and r["country_risk"] == 1 and r["risk_score"] == 0.0


def test_feature_key_stable(spark):
    df = spark.createDataFrame([(1.5, 3, .25, 2), (1.5, 3, .25, 2), (1.5, 4, .25, 2)], SCHEMA)
    keys = [r.k for r in df.select(fe.feature_key("amount", "hour", "device_score", "country_risk").alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]
