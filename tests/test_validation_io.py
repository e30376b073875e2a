"""Validation on the reference's request fixtures, and the CSV source's corrupt-line handling."""

import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from riskweave.functions import validate as va
from riskweave.sources import files as fl

REQ = ("amount double, hour int, device_score double, country_risk int, user_id string, merchant_id string, "
       "transaction_count_last_hour int")


def test_strict_validation_fixture_requests(spark):
    rows = [(100.0, 14, .8, 2, "u1", None, None),        # valid
            (5000.0, 3, .1, 5, "u2", "m", 10),           # valid high risk
            (-100.0, 14, .8, 2, None, None, None),       # negative amount
            (100.0, 25, .8, 2, None, None, None),        # hour out of range
            (100.0, None, None, None, None, None, None),  # only amount
            (100.0, 1, .5, 1, "x" * 101, None, 1001)]    # id too long, count too high
    out = [(r.is_valid, r.reject_reasons) for r in va.validate_strict(spark.createDataFrame(rows, REQ)).collect()]
    assert out[0] == (True, None) and out[1] == (True, None)
    assert out[2] == (False, "amount")
    assert out[3] == (False, "hour")
    assert out[4] == (False, "hour,device_score,country_risk")
    assert out[5] == (False, "user_id,transaction_count_last_hour")


def test_lenient_validation_first_failure(spark):
    df = spark.createDataFrame([(0.0, 12, .5, 2), (-1.0, 30, 2.0, 9), (1.0, 30, .5, 2), (None, 1, .5, 2)],
                               "amount double, hour int, device_score double, country_risk int")
    got = [r.e for r in df.select(va.lenient_reason(df.columns).alias("e")).collect()]
    assert got == [None, "Amount must be non-negative", "Hour must be between 0 and 23",
                   "Missing required fields: amount"]
    only_amount = spark.createDataFrame([(1.0,)], "amount double")
    msg = only_amount.select(va.lenient_reason(only_amount.columns).alias("e")).first().e
    assert msg.startswith("Missing required fields")


def test_sanitize_and_defaults(spark):
    df = spark.createDataFrame([("  a  " + "b" * 2000, 1.0, None)], "s string, x double, n int")
    r = va.with_defaults(va.sanitize_strings(df), {"n": 0}).first()
    assert r.s.startswith("a") and len(r.s) == 1000 and r.x == 1.0 and r.n == 0


def test_csv_source_isolates_corrupt_lines(spark):
    d = tempfile.mkdtemp(prefix="rw-csv-")
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write("amount,hour\n10.5,3\nnot-a-number,4\n7.0,5\n")
    schema = StructType([StructField("amount", DoubleType()), StructField("hour", IntegerType())])
    df = fl.read_csv(spark, d, schema)
    good = df.where(F.col(fl.CORRUPT).isNull()).collect()
    bad = df.where(F.col(fl.CORRUPT).isNotNull()).collect()
    assert [(r.amount, r.hour) for r in good] == [(10.5, 3), (7.0, 5)]
    assert len(bad) == 1 and bad[0][fl.CORRUPT].startswith("not-a-number")
