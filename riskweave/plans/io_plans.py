"""Registered queries: sources and sinks (S01-S13) and retention.

Each writes into a fresh folder under the shared checkpoint directory and
returns what Spark reads back, so the round trip itself is what is checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

from riskweave.operators import retention as rt
from riskweave.plans._sqlhelp import r9
from riskweave.plans.drift_plans import _LI_REPORT, _REPORT_COLS, _round_report, li_report
from riskweave.plans.registry import register
from riskweave.plans.split_plans import _RANK_CTE, split_tx
from riskweave.session import scratch_path
from riskweave.sources import files as fl
from riskweave.sources import unique as un
from riskweave.sources import generator as gen
from riskweave.sources.tables import prediction_logs, read_table, transactions, with_ctes

TX_SCHEMA = StructType([
    StructField("transaction_id", LongType()), StructField("user_id", LongType()),
    StructField("merchant_id", StringType()), StructField("amount", DoubleType()),
    StructField("hour", IntegerType()), StructField("device_score", DoubleType()),
    StructField("country_risk", IntegerType()), StructField("is_fraud", IntegerType()),
    StructField("created_at", TimestampNTZType()),
])


def _scratch(spark, tag: str) -> str:
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex[:12]}")


@register("S01", with_ctes("SELECT * FROM tx", "tx"))
def q_s01(spark, sf_dir):
    """CSV round trip: write transactions, read back with an explicit schema (PERMISSIVE)."""
    path = _scratch(spark, "s01")
    fl.write_csv(transactions(spark, sf_dir), path)
    back = fl.read_csv(spark, path, TX_SCHEMA)
    return back.where(F.col(fl.CORRUPT).isNull()).drop(fl.CORRUPT)


@register("S02", with_ctes("SELECT transaction_id, user_id, merchant_id, amount, hour, device_score, country_risk, is_fraud, created_at, split FROM sp",
                           "tx", extra=[_RANK_CTE]))
def q_s02(spark, sf_dir):
    """CSV sink of the three splits (one folder per split): every row and column as read back."""
    path = _scratch(spark, "s02")
    fl.write_csv(split_tx(spark, sf_dir).select(*TX_SCHEMA.names, "split"), path, partition_by=["split"])
    back = fl.read_csv(spark, path, TX_SCHEMA)  # the folder's name gives the split
    return back.where(F.col(fl.CORRUPT).isNull()).drop(fl.CORRUPT)


@register("S03", with_ctes("""SELECT row_number() OVER (ORDER BY transaction_id) - 1 AS row_id, transaction_id, amount,
    hour, transaction_id AS label_transaction_id, is_fraud FROM tx""", "tx"))
def q_s03(spark, sf_dir):
    """Pair separately written feature and label files by row position."""
    x_path, y_path = _scratch(spark, "s03x"), _scratch(spark, "s03y")
    tx = transactions(spark, sf_dir).repartitionByRange("transaction_id").sortWithinPartitions("transaction_id")
    fl.write_csv(tx.select("transaction_id", "amount", "hour"), x_path)
    fl.write_csv(tx.select("transaction_id", "is_fraud"), y_path)
    xs = StructType([StructField("transaction_id", LongType()), StructField("amount", DoubleType()),
                     StructField("hour", IntegerType())])
    ys = StructType([StructField("label_transaction_id", LongType()), StructField("is_fraud", IntegerType())])
    return fl.pair_by_position(spark, x_path, y_path, xs, ys)


@register("S04")
def q_s04(spark, sf_dir):
    """Synthetic transactions generated for every event id (seeded hash columns)."""
    ids = read_table(spark, sf_dir, "events").select("event_id")
    return gen.synthetic_transactions(ids, "event_id", seed=42)


def _drawn_sql(stream: int) -> str:
    key = f"md5((l_orderkey * 10 + l_linenumber)::VARCHAR || '/42/{stream}')"
    return f"('0x' || substr({key}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@register("S05", f"""SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey * 60.0::DOUBLE + l_linenumber AS time_elapsed,
    l_discount AS feature_1, l_tax AS feature_2, l_extendedprice AS amount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_fraud,
    CAST(floor((l_partkey * 60.0 + l_linenumber) / 3600) % 24 AS INTEGER) AS hour,
    round(0.5::DOUBLE + 0.5::DOUBLE * {_drawn_sql(20)}, 9) AS device_score,
    CASE WHEN {_drawn_sql(21)} < 0.4::DOUBLE THEN 1 WHEN {_drawn_sql(21)} < 0.4::DOUBLE + 0.3::DOUBLE THEN 2
      WHEN {_drawn_sql(21)} < 0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE THEN 3
      WHEN {_drawn_sql(21)} < 0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE + 0.08::DOUBLE THEN 4 ELSE 5 END AS country_risk FROM lineitem""")
def q_s05(spark, sf_dir):
    """External card-style data (built from lineitem) standardised to the transaction schema, all columns."""
    li = read_table(spark, sf_dir, "lineitem")
    card = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
                     (F.col("l_partkey") * 60.0 + F.col("l_linenumber")).alias("Time"),
                     F.col("l_discount").alias("V1"), F.col("l_tax").alias("V2"),
                     F.col("l_extendedprice").alias("Amount"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("Class"))
    std = gen.standardize_card_data(card, "row_id")
    return std.withColumn("device_score", r9("device_score"))


def _append_twice(spark, sf_dir, key: str, df_builder):
    path = _scratch(spark, f"append-{key}")
    df = df_builder(spark, sf_dir)
    first = df.where(F.col("created_at") < F.lit("2024-01-21").cast("timestamp_ntz"))
    second = df.where(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    un.append_unique(spark, path, first, key, "created_at")
    un.append_unique(spark, path, second.unionByName(second), key, "created_at")  # overlap and in-batch duplicates
    return un.read_unique(spark, path, df.schema)


@register("S06", with_ctes("SELECT transaction_id, amount FROM tx", "tx"))
def q_s06(spark, sf_dir):
    """Transaction append with unique ids (overlapping, duplicated batches), told by key filters."""
    return _append_twice(spark, sf_dir, "transaction_id", transactions).select("transaction_id", "amount")


@register("S07", with_ctes("SELECT prediction_id, fraud_probability FROM logs", "logs"))
def q_s07(spark, sf_dir):
    """Prediction-log append with unique prediction ids, told by key filters."""
    return _append_twice(spark, sf_dir, "prediction_id", prediction_logs).select("prediction_id", "fraud_probability")


@register("S08", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_s08(spark, sf_dir):
    """Relational table source: pruned, filtered scan (the filter reaches the Parquet reader)."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@register("S09", with_ctes(f"SELECT {_REPORT_COLS} FROM rep", extra=_LI_REPORT))
def q_s09(spark, sf_dir):
    """JSON report sink: the drift report written as JSON and read back."""
    path = _scratch(spark, "s09")
    rep = _round_report(li_report(spark, sf_dir))
    fl.write_json(rep, path)
    return spark.read.schema(rep.schema).json(path)


@register("S10", with_ctes("""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(sum(amount), 6) AS amount,
    round(sum(fraud_probability), 6) AS fraud_probability, min(prediction_id) AS first_id, max(created_at) AS last_at
    FROM logs GROUP BY 1""", "logs"))
def q_s10(spark, sf_dir):
    """Compressed archive sink: gzip JSON partitioned by ISO day, read back and summed per day."""
    path = _scratch(spark, "s10")
    logs = prediction_logs(spark, sf_dir)
    fl.write_archive(logs, path, "created_at")
    back = fl.read_archive(spark, path, logs.schema)
    return back.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 6).alias("amount"),
        F.round(F.sum("fraud_probability"), 6).alias("fraud_probability"), F.min("prediction_id").alias("first_id"),
        F.max("created_at").alias("last_at"))


_LOG_DOUBLES = ("amount", "device_score", "fraud_probability", "threshold", "processing_time_ms")


@register("S12", with_ctes("SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in _LOG_DOUBLES) + ") FROM logs", "logs"))
def q_s12(spark, sf_dir):
    """Audit export: each log row, all columns, as a JSON text line, parsed back."""
    path = _scratch(spark, "s12")
    logs = prediction_logs(spark, sf_dir)
    fl.export_json_lines(logs, path)
    parsed = spark.read.text(path).select(F.from_json("value", logs.schema, fl.TS_OPTS).alias("r")).select("r.*")
    return parsed.select(*[r9(c) if c in _LOG_DOUBLES else c for c in logs.columns])


_ITEM = "amount double, _d double, _t double, hour int, device_score double, country_risk int"


@register("S13", """SELECT l_orderkey AS order_id, l_linenumber AS batch_no,
    CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_discount, l_tax)
         - 1 AS INTEGER) AS pos,
    l_extendedprice AS amount, CAST(l_linenumber * 3 AS INTEGER) AS hour,
    l_discount * 10 AS device_score, CAST(round(l_tax * 50) AS INTEGER) + 1 AS country_risk FROM lineitem""")
def q_s13(spark, sf_dir):
    """Batch-request unnest: JSON bodies of line items (one body per order and line
    number, so no body grows with a hot order) parsed back to rows with positions."""
    li = read_table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("_d"),
                    F.col("l_tax").alias("_t"), (F.col("l_linenumber") * 3).cast("int").alias("hour"),
                    (F.col("l_discount") * 10).alias("device_score"),
                    (F.round(F.col("l_tax") * 50).cast("int") + 1).alias("country_risk"))
    bodies = li.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("batch_no")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("transactions"))).alias("body"))
    out = fl.unnest_batch(bodies, "body", _ITEM, ["order_id", "batch_no"])
    return out.select("order_id", "batch_no", "pos", "amount", "hour", "device_score", "country_risk")


@register("C01", with_ctes("""SELECT step, archived, kept, verified FROM (
      SELECT count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-10 12:00:00') AS archived,
        count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-10 12:00:00') AS k FROM logs),
      (VALUES ('dry run', false), ('run', true), ('run again', true)) v(step, verified), LATERAL (SELECT CASE WHEN verified THEN k END AS kept)""", "logs"))
def q_c01(spark, sf_dir):
    """Archive rows older than a cutoff out of a day-partitioned table: dry run, the run, and the run again."""
    logs = prediction_logs(spark, sf_dir)
    table, archive, out = _scratch(spark, "c01t"), _scratch(spark, "c01a"), None
    rt.write_by_day(logs, table, "created_at")
    for step in ("dry run", "run", "run again"):
        told = rt.archive_in_place(spark, table, logs.schema, "created_at", "2024-01-10 12:00:00", archive, "first", step == "dry run")
        rows = spark.createDataFrame(told.collect(), told.schema).select(F.lit(step).alias("step"), "*")  # one row
        out = rows if out is None else out.unionByName(rows)
    return out


@register("C02", with_ctes("""SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS day FROM logs
    WHERE CAST(created_at AS DATE) >= (SELECT max(CAST(created_at AS DATE)) FROM logs) - INTERVAL 14 DAY""", "logs"))
def q_c02(spark, sf_dir):
    """Archive retention: drop day partitions older than 14 days before the newest day."""
    path = _scratch(spark, "c02")
    logs = prediction_logs(spark, sf_dir)
    fl.write_archive(logs, path, "created_at")
    newest = logs.agg(F.date_format(F.date_sub(F.max(F.to_date("created_at")), 14), "yyyy-MM-dd")).first()[0]
    rt.drop_partitions_before(spark, path, "day", newest)
    # only the partition column is read
    return fl.read_archive(spark, path, logs.schema).select("day").distinct()
