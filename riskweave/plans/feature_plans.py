"""Registered queries: validation (V), features (F), lookups (J01) over driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import features as fe
from riskweave.functions import validate as va
from riskweave.operators import lookups
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.session import scratch_path, shuffle_partitions
from riskweave.sources.tables import prediction_logs, read_table, transactions, with_ctes

# ---------------------------------------------------------------- request view

def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request-shaped records from ``lineitem``: a large table with both valid
    and out-of-range values, so validation has something to reject."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.concat(F.lit("user"), F.col("l_suppkey").cast("string")).alias("user_id"),
        F.concat(F.lit(" m"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("merchant_id"),
        (F.col("l_quantity") * 10 - 20).alias("amount"),
        (F.col("l_linenumber") * 4 - 1).alias("hour"),
        (F.col("l_discount") * 11).alias("device_score"),
        F.round(F.col("l_tax") * 100).cast("int").alias("country_risk"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("int"))
        .otherwise((F.col("l_quantity") * 25).cast("int")).alias("transaction_count_last_hour"),
        F.col("l_shipdate").alias("created_at"),
    )


REQ_CTE = """req AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id,
         'user' || CAST(l_suppkey AS VARCHAR) AS user_id,
         ' m' || CAST(l_partkey AS VARCHAR) || ' ' AS merchant_id,
         l_quantity * 10 - 20 AS amount,
         l_linenumber * 4 - 1 AS hour,
         l_discount * 11 AS device_score,
         CAST(round(l_tax * 100) AS INTEGER) AS country_risk,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity * 25 AS INTEGER) END AS transaction_count_last_hour,
         l_shipdate AS created_at
  FROM lineitem)"""

# ---------------------------------------------------------------- validation

_STRICT_SQL = """CASE WHEN concat_ws(',',
    CASE WHEN amount IS NULL OR amount <= 0 OR amount > 1000000 THEN 'amount' END,
    CASE WHEN hour IS NULL OR hour < 0 OR hour > 23 THEN 'hour' END,
    CASE WHEN device_score IS NULL OR device_score < 0 OR device_score > 1 THEN 'device_score' END,
    CASE WHEN country_risk IS NULL OR country_risk < 1 OR country_risk > 5 THEN 'country_risk' END,
    CASE WHEN length(user_id) > 100 THEN 'user_id' END,
    CASE WHEN length(merchant_id) > 100 THEN 'merchant_id' END,
    CASE WHEN transaction_count_last_hour < 0 OR transaction_count_last_hour > 1000
         THEN 'transaction_count_last_hour' END) = '' THEN NULL ELSE concat_ws(',',
    CASE WHEN amount IS NULL OR amount <= 0 OR amount > 1000000 THEN 'amount' END,
    CASE WHEN hour IS NULL OR hour < 0 OR hour > 23 THEN 'hour' END,
    CASE WHEN device_score IS NULL OR device_score < 0 OR device_score > 1 THEN 'device_score' END,
    CASE WHEN country_risk IS NULL OR country_risk < 1 OR country_risk > 5 THEN 'country_risk' END,
    CASE WHEN length(user_id) > 100 THEN 'user_id' END,
    CASE WHEN length(merchant_id) > 100 THEN 'merchant_id' END,
    CASE WHEN transaction_count_last_hour < 0 OR transaction_count_last_hour > 1000
         THEN 'transaction_count_last_hour' END) END"""


@register("V01", with_ctes(f"SELECT transaction_id, {_STRICT_SQL} AS reject_reasons, "
                          f"({_STRICT_SQL}) IS NULL AS is_valid FROM req", extra=[REQ_CTE]))
def q_v01(spark, sf_dir):
    """Strict validation of every request: reasons list and valid flag."""
    return va.validate_strict(requests(spark, sf_dir)).select("transaction_id", "reject_reasons", "is_valid")


@register("V02", with_ctes("""SELECT transaction_id, COALESCE(
    CASE WHEN amount IS NULL OR hour IS NULL OR device_score IS NULL OR country_risk IS NULL
         THEN 'Missing required fields: ' || concat_ws(',',
              CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN hour IS NULL THEN 'hour' END,
              CASE WHEN device_score IS NULL THEN 'device_score' END,
              CASE WHEN country_risk IS NULL THEN 'country_risk' END) END,
    CASE WHEN amount < 0 THEN 'Amount must be non-negative' END,
    CASE WHEN NOT (hour BETWEEN 0 AND 23) THEN 'Hour must be between 0 and 23' END,
    CASE WHEN NOT (device_score BETWEEN 0 AND 1) THEN 'Device score must be between 0 and 1' END,
    CASE WHEN NOT (country_risk BETWEEN 1 AND 5) THEN 'Country risk must be between 1 and 5' END)
    AS error FROM req""", extra=[REQ_CTE]))
def q_v02(spark, sf_dir):
    """Lenient validation: first failing rule per request."""
    req = requests(spark, sf_dir)
    return req.select("transaction_id", va.lenient_reason(req.columns).alias("error"))


@register("V03", with_ctes("SELECT transaction_id, substring(trim(user_id), 1, 1000) AS user_id, "
                          "substring(trim(merchant_id), 1, 1000) AS merchant_id, amount FROM req",
                          extra=[REQ_CTE]))
def q_v03(spark, sf_dir):
    """Sanitise all string columns (trim, truncate to 1000 chars)."""
    req = requests(spark, sf_dir).select("transaction_id", "user_id", "merchant_id", "amount")
    return va.sanitize_strings(req)


@register("V04", with_ctes("SELECT transaction_id, COALESCE(transaction_count_last_hour, 0) "
                          "AS transaction_count_last_hour FROM req", extra=[REQ_CTE]))
def q_v04(spark, sf_dir):
    """Optional defaults: missing transaction count -> 0."""
    req = requests(spark, sf_dir).select("transaction_id", "transaction_count_last_hour")
    return va.with_defaults(req, {"transaction_count_last_hour": 0})


# ---------------------------------------------------------------- F01-F14

STATS_CTE = """st AS (
  SELECT avg(amount) AS amount_mean, stddev_samp(amount) AS amount_std,
         quantile_cont(amount, 0.75) AS amount_p75, quantile_cont(amount, 0.95) AS amount_p95
  FROM tx)"""

FEAT_CTE = """feat AS (
  SELECT tx.*,
    ln(1 + amount) AS amount_log,
    (amount - amount_mean) / amount_std AS amount_zscore,
    CASE WHEN hour BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN hour BETWEEN 18 AND 23 THEN 1 ELSE 0 END AS is_evening,
    0 AS is_weekend,
    CASE WHEN amount > amount_p75 THEN 1 ELSE 0 END AS high_amount,
    CASE WHEN amount > amount_p95 THEN 1 ELSE 0 END AS very_high_amount,
    CASE WHEN device_score < 0.3 THEN 1 ELSE 0 END AS low_device,
    CASE WHEN device_score >= 0.3 AND device_score < 0.7 THEN 1 ELSE 0 END AS medium_device,
    CASE WHEN country_risk >= 4 THEN 1 ELSE 0 END AS high_risk_country,
    (CASE WHEN amount > amount_p75 THEN 1 ELSE 0 END) * 0.3::DOUBLE
      + (CASE WHEN device_score < 0.3 THEN 1 ELSE 0 END) * 0.3::DOUBLE
      + (CASE WHEN country_risk >= 4 THEN 1 ELSE 0 END) * 0.2::DOUBLE
      + (CASE WHEN hour BETWEEN 0 AND 5 THEN 1 ELSE 0 END) * 0.2::DOUBLE AS risk_score,
    sin(2 * pi() * hour / 24) AS hour_sin,
    cos(2 * pi() * hour / 24) AS hour_cos,
    amount * (1 - device_score) AS amount_device_interaction,
    amount * country_risk / 5 AS amount_country_interaction
  FROM tx, st)"""

# ID -> (columns, float columns needing rounding)
_FEATURE_IDS = {
    "F01": (["amount_log"], True),
    "F02": (["amount_zscore"], True),
    "F03": (["is_night"], False),
    "F04": (["is_evening"], False),
    "F05": (["is_weekend"], False),
    "F06": (["high_amount"], False),
    "F07": (["very_high_amount"], False),
    "F08": (["low_device"], False),
    "F09": (["medium_device"], False),
    "F10": (["high_risk_country"], False),
    "F11": (["risk_score"], True),
    "F12": (["hour_sin", "hour_cos"], True),
    "F13": (["amount_device_interaction"], True),
    "F14": (["amount_country_interaction"], True),
}


def _feature_query(cols: list[str], rounded: bool):
    def build(spark, sf_dir):
        tx = transactions(spark, sf_dir)
        eng = fe.engineer(tx) if set(cols) & set(fe.STAT_FEATURES) else fe.stateless_features(tx)
        out = [r9(c) if rounded else F.col(c) for c in cols]
        return eng.select("transaction_id", *out)
    return build


for _qid, (_cols, _rounded) in _FEATURE_IDS.items():
    # "+ 0.0" folds DuckDB's -0.0 (round of a tiny negative) into 0.0, as Spark's decimal round does
    _sel = ", ".join(f"round({c}, 9) + 0.0 AS {c}" if _rounded else c for c in _cols)
    _fn = _feature_query(_cols, _rounded)
    _fn.__doc__ = f"Feature column(s) {', '.join(_cols)} over all transactions (stats fitted on the frame)."
    register(_qid, with_ctes(f"SELECT transaction_id, {_sel} FROM feat", "tx",
                             extra=[STATS_CTE, FEAT_CTE]))(_fn)

_V05_FLOATS = {"amount", "device_score", "amount_log", "amount_zscore", "risk_score", "hour_sin",
               "hour_cos", "amount_device_interaction", "amount_country_interaction"}


@register("V05", with_ctes("SELECT transaction_id, " + ", ".join(
    f"round({c}, 9) + 0.0 AS {c}" if c in _V05_FLOATS else c for c in fe.FEATURE_COLUMNS) + " FROM feat",
    "tx", extra=[STATS_CTE, FEAT_CTE]))
def q_v05(spark, sf_dir):
    """Projection to the fixed 19-column model order."""
    eng = fe.engineer(transactions(spark, sf_dir))
    return eng.select("transaction_id", *[r9(c) if c in _V05_FLOATS else F.col(c) for c in fe.FEATURE_COLUMNS])


@register("V06", with_ctes("SELECT transaction_id, is_fraud FROM tx", "tx"))
def q_v06(spark, sf_dir):
    """Label split: the target column keyed by row id (features are V05)."""
    return transactions(spark, sf_dir).select("transaction_id", "is_fraud")


_F15_SQL = FEAT_CTE.replace("amount_p75", "500").replace("amount_p95", "2000").replace(
    "(amount - amount_mean) / amount_std", "0.0::DOUBLE").replace("ln(1 + amount)", "CASE WHEN amount > -1 THEN ln(1 + amount) END").replace("tx.*", "req.*").replace("FROM tx, st", "FROM req").replace("feat AS", "fixed AS")
_F15_COLS = [c for c in fe.FEATURE_COLUMNS if c not in fe.RAW_COLUMNS]
_F15_FLOATS = ("amount_log", "risk_score", "hour_sin", "hour_cos", "amount_device_interaction", "amount_country_interaction")


@register("F15", with_ctes("SELECT transaction_id, amount, hour, device_score, country_risk, " + ", ".join(
    f"round({c}, 9) AS {c}" if c in _F15_FLOATS else c for c in _F15_COLS) + " FROM fixed", extra=[REQ_CTE, _F15_SQL]))
def q_f15(spark, sf_dir):
    """Fixed-threshold (per-request) feature variant over request records: all columns (no logarithm of amounts up to -1)."""
    eng = fe.engineer_fixed(requests(spark, sf_dir))
    return eng.select("transaction_id", *fe.RAW_COLUMNS, *[r9(c) if c in _F15_FLOATS else c for c in _F15_COLS])


@register("F16", with_ctes("""SELECT transaction_id, user_id, COALESCE(amount, 0.0) AS amount,
    round(ln(1 + COALESCE(amount, 0.0)), 9) AS amount_log, COALESCE(hour, 0) AS hour,
    CASE WHEN COALESCE(hour, 12) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN COALESCE(hour, 12) BETWEEN 18 AND 23 THEN 1 ELSE 0 END AS is_evening,
    COALESCE(device_score, 0.5) AS device_score,
    CASE WHEN COALESCE(device_score, 0.5) < 0.3 THEN 1 ELSE 0 END AS low_device,
    COALESCE(country_risk, 1) AS country_risk,
    CASE WHEN COALESCE(country_risk, 1) >= 4 THEN 1 ELSE 0 END AS high_risk_country,
    round((CASE WHEN COALESCE(device_score, 0.5) < 0.3 THEN 1 ELSE 0 END) * 0.3::DOUBLE
      + (CASE WHEN COALESCE(country_risk, 1) >= 4 THEN 1 ELSE 0 END) * 0.2::DOUBLE
      + (CASE WHEN COALESCE(hour, 12) BETWEEN 0 AND 5 THEN 1 ELSE 0 END) * 0.2::DOUBLE, 9) AS risk_score
    FROM tx""", "tx"))
def q_f16(spark, sf_dir):
    """Feature-store variant of the features (9 columns, defaults, own risk score)."""
    out = fe.store_features(transactions(spark, sf_dir)).drop("created_at")
    return out.withColumn("amount_log", r9("amount_log")).withColumn("risk_score", r9("risk_score"))


_SCALE_COLS = ["amount", "hour", "device_score", "country_risk"]
_TRAIN_CUTOFF = "2024-01-21"


@register("F17", with_ctes("""SELECT transaction_id, """ + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 9) AS {c}" for c in _SCALE_COLS) +
    """ FROM tx, (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALE_COLS) +
    f""" FROM tx WHERE created_at < TIMESTAMP '{_TRAIN_CUTOFF}') sc
    WHERE created_at >= TIMESTAMP '{_TRAIN_CUTOFF}'""", "tx"))
def q_f17(spark, sf_dir):
    """Standard scaling fitted on the first 20 days (ddof=0), applied to the rest."""
    tx = transactions(spark, sf_dir)
    cutoff = F.lit(_TRAIN_CUTOFF).cast("timestamp_ntz")
    scaler = fe.fit_scaler(tx.where(F.col("created_at") < cutoff), _SCALE_COLS)
    cur = tx.where(F.col("created_at") >= cutoff).select("transaction_id", *_SCALE_COLS)
    out = fe.apply_scaler(cur, scaler, _SCALE_COLS)
    return out.select("transaction_id", *[r9(c) for c in _SCALE_COLS])


# ---------------------------------------------------------------- F18-F20 / J01

_LAST_HOUR_CTE = """lasth AS (
  SELECT user_id, count(*) AS cnt FROM tx
  WHERE created_at > (SELECT max(created_at) FROM tx) - INTERVAL 1 HOUR GROUP BY user_id)"""


@register("F18", with_ctes("""SELECT tx.transaction_id, CAST(COALESCE(lasth.cnt, 0) AS BIGINT) AS tx_count_last_hour
    FROM tx LEFT JOIN lasth ON tx.user_id = lasth.user_id""", "tx", extra=[_LAST_HOUR_CTE]))
def q_f18(spark, sf_dir):
    """Per-user count over the final hour of the log, looked up for every row (default 0)."""
    tx = transactions(spark, sf_dir)
    counts = lookups.last_hour_counts(tx)
    out = lookups.lookup_with_default(tx, counts, "user_id", {"cnt": ("tx_count_last_hour", 0)})
    return out.select("transaction_id", F.col("tx_count_last_hour").cast("bigint"))


_HIST_CTE = f"""hist AS (
  SELECT user_id, avg(amount) AS avg_amount, avg(is_fraud) AS fraud_rate
  FROM tx WHERE created_at < TIMESTAMP '{_TRAIN_CUTOFF}' GROUP BY user_id),
cur AS (SELECT * FROM tx WHERE created_at >= TIMESTAMP '{_TRAIN_CUTOFF}')"""


@register("F19", with_ctes("""SELECT cur.transaction_id,
    round(COALESCE(hist.avg_amount, (SELECT avg(amount) FROM cur)), 9) AS user_avg_amount,
    round(cur.amount / (COALESCE(hist.avg_amount, (SELECT avg(amount) FROM cur)) + 1), 9) AS amount_vs_avg
    FROM cur LEFT JOIN hist ON cur.user_id = hist.user_id""", "tx", extra=[_HIST_CTE]))
def q_f19(spark, sf_dir):
    """User average amount from history; unknown user -> mean of the current frame."""
    cur, hist = _split_history(spark, sf_dir)
    out = lookups.user_history_features(cur, hist)
    return out.select("transaction_id", r9("user_avg_amount"), r9("amount_vs_avg"))


@register("F20", with_ctes("""SELECT cur.transaction_id, round(COALESCE(hist.fraud_rate, 0.01), 9) AS user_fraud_rate
    FROM cur LEFT JOIN hist ON cur.user_id = hist.user_id""", "tx", extra=[_HIST_CTE]))
def q_f20(spark, sf_dir):
    """User fraud rate from history; unknown user -> 0.01."""
    cur, hist = _split_history(spark, sf_dir)
    out = lookups.user_history_features(cur, hist)
    return out.select("transaction_id", r9("user_fraud_rate"))


@register("J01", with_ctes("""SELECT cur.transaction_id, round(COALESCE(hist.avg_amount, 100.0), 9) AS user_avg_amount,
    round(COALESCE(hist.fraud_rate, 0.01), 9) AS user_fraud_rate
    FROM cur LEFT JOIN hist ON cur.user_id = hist.user_id""", "tx", extra=[_HIST_CTE]))
def q_j01(spark, sf_dir):
    """Dimension lookup with literal defaults (left join + coalesce)."""
    cur, hist = _split_history(spark, sf_dir)
    out = lookups.lookup_with_default(cur, hist, "user_id", {"avg_amount": ("user_avg_amount", 100.0),
                                                            "fraud_rate": ("user_fraud_rate", 0.01)})
    return out.select("transaction_id", r9("user_avg_amount"), r9("user_fraud_rate"))


def _split_history(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    cutoff = F.lit(_TRAIN_CUTOFF).cast("timestamp_ntz")
    hist = lookups.user_history(tx.where(F.col("created_at") < cutoff))
    cur = tx.where(F.col("created_at") >= cutoff)
    return cur, hist


# ---------------------------------------------------------------- F21, F22

_REASONS_SQL = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in fe.RULE_TEXTS) + ")"


@register("F21", with_ctes(f"""SELECT prediction_id, CASE WHEN fraud_label = 1 THEN
    CASE WHEN {_REASONS_SQL} = '' THEN '{fe.NO_RULE_TEXT}' ELSE {_REASONS_SQL} END END AS reasons FROM logs""", "logs"))
def q_f21(spark, sf_dir):
    """Rule reasons for every flagged prediction."""
    return fe.rule_reasons(prediction_logs(spark, sf_dir)).select("prediction_id", "reasons")


_KEY_COLS = ["amount", "country_risk", "device_score", "hour"]


@register("F22", with_ctes("SELECT transaction_id, md5(concat_ws('|', " + ", ".join(
    f"'{c}', CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)" for c in sorted(_KEY_COLS)) +
    ")) AS feature_key FROM tx", "tx"))
def q_f22(spark, sf_dir):
    """Canonical feature key: md5 over the fields in sorted-name order."""
    tx = transactions(spark, sf_dir)
    return tx.select("transaction_id", fe.feature_key(*_KEY_COLS).alias("feature_key"))


# ---------------------------------------------------------------- J04, J05

@register("J04", with_ctes("""SELECT prediction_id FROM logs b WHERE created_at >= TIMESTAMP '2024-01-15'
    AND NOT EXISTS (SELECT 1 FROM logs e WHERE e.created_at < TIMESTAMP '2024-01-21' AND e.prediction_id = b.prediction_id)""",
                           "logs"))
def q_j04(spark, sf_dir):
    """Anti-join for uniqueness: rows of a new batch whose id is not stored yet."""
    logs = prediction_logs(spark, sf_dir)
    existing = logs.where(F.col("created_at") < F.lit("2024-01-21").cast("timestamp_ntz")).select("prediction_id")
    batch = logs.where(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return lookups.new_keys(batch, existing, "prediction_id").select("prediction_id")


@register("J05", with_ctes("""SELECT l.prediction_id, t.transaction_id, t.amount, t.is_fraud,
    l.fraud_probability FROM logs l JOIN tx t ON l.transaction_id = t.transaction_id""", "logs"))
def q_j05(spark, sf_dir):
    """Prediction log joined to its transaction: both stored bucketed by transaction_id, joined without a shuffle."""
    tag = uuid.uuid4().hex[:12]

    def stored(df, name):
        return lookups.write_bucketed(df, f"rw_{name}_{tag}", scratch_path(spark, f"j05-{name}-{tag}"), "transaction_id", shuffle_partitions(spark))
    logs = stored(prediction_logs(spark, sf_dir).select("prediction_id", "transaction_id", "fraud_probability"), "logs")
    tx = stored(transactions(spark, sf_dir).select("transaction_id", "amount", "is_fraud"), "tx")
    return lookups.predictions_with_transactions(logs, tx).select(
        "prediction_id", "transaction_id", "amount", "is_fraud", "fraud_probability")
