"""Feature expressions F01-F22 as Spark column expressions.

Whole-frame statistics (mean, sample std, p75, p95) are fitted once into a
one-row table (``fit_feature_stats``) and applied with a broadcast cross
join of that single row. ``engineer(df)`` without stats fits on ``df``
itself, which reproduces the reference's per-frame refit; training and
scoring jobs pass the train stats instead, and streams must.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranking import quantile_row

# The model's 19 input columns, in order.
FEATURE_COLUMNS = [
    "amount", "hour", "device_score", "country_risk",
    "amount_log", "amount_zscore",
    "is_night", "is_evening", "is_weekend",
    "high_amount", "very_high_amount",
    "low_device", "medium_device",
    "high_risk_country",
    "risk_score",
    "hour_sin", "hour_cos",
    "amount_device_interaction", "amount_country_interaction",
]

RAW_COLUMNS = ["amount", "hour", "device_score", "country_risk"]

# Thresholds of the serverless variant.
FIXED_HIGH_AMOUNT = 500.0
FIXED_VERY_HIGH_AMOUNT = 2000.0

STAT_COLUMNS = ["amount_mean", "amount_std", "amount_p75", "amount_p95"]


def fit_feature_stats(df: DataFrame, amount: str = "amount") -> DataFrame:
    """One-row table: mean, sample std (ddof=1), exact p75 and p95 of amount."""
    moments = df.agg(F.avg(amount).alias("amount_mean"), F.stddev_samp(amount).alias("amount_std"))
    qs = quantile_row(df, amount, [0.75, 0.95], ["amount_p75", "amount_p95"])
    return moments.crossJoin(qs)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def is_night(hour: Column) -> Column:
    return _flag(hour.between(0, 5))


def is_evening(hour: Column) -> Column:
    return _flag(hour.between(18, 23))


def low_device(dev: Column) -> Column:
    return _flag(dev < 0.3)


def medium_device(dev: Column) -> Column:
    return _flag((dev >= 0.3) & (dev < 0.7))


def high_risk_country(cr: Column) -> Column:
    return _flag(cr >= 4)


def risk_score(high_amount: Column, low_dev: Column, high_risk: Column, night: Column) -> Column:
    return high_amount * 0.3 + low_dev * 0.3 + high_risk * 0.2 + night * 0.2


def stateless_features(df: DataFrame) -> DataFrame:
    """The features of F01-F14 that need nothing but the row."""
    amount, hour = F.col("amount"), F.col("hour")
    dev, cr = F.col("device_score"), F.col("country_risk")
    return df.withColumns({
        "amount_log": F.log1p(amount),
        "is_night": is_night(hour),
        "is_evening": is_evening(hour),
        "is_weekend": F.lit(0),
        "low_device": low_device(dev),
        "medium_device": medium_device(dev),
        "high_risk_country": high_risk_country(cr),
        "hour_sin": F.sin(F.lit(2 * math.pi) * hour / 24),
        "hour_cos": F.cos(F.lit(2 * math.pi) * hour / 24),
        "amount_device_interaction": amount * (1 - dev),
        "amount_country_interaction": amount * cr / 5,
    })


# features that compare a row with the frame's statistics
STAT_FEATURES = ("amount_zscore", "high_amount", "very_high_amount", "risk_score")


def engineer(df: DataFrame, stats: DataFrame | None = None, keep: bool = True) -> DataFrame:
    """Add F01-F14. ``stats`` is a one-row ``fit_feature_stats`` table."""
    if stats is None:
        stats = fit_feature_stats(df)
    joined = stateless_features(df).crossJoin(F.broadcast(stats.select(*STAT_COLUMNS)))
    amount = F.col("amount")
    out = joined.withColumns({
        "amount_zscore": F.try_divide(amount - F.col("amount_mean"), F.col("amount_std")),  # std 0 -> NULL
        "high_amount": _flag(amount > F.col("amount_p75")),
        "very_high_amount": _flag(amount > F.col("amount_p95")),
    })
    return out.withColumn("risk_score", risk_score(F.col("high_amount"), F.col("low_device"),
                                                   F.col("high_risk_country"), F.col("is_night"))).drop(*STAT_COLUMNS)


def engineer_fixed(df: DataFrame) -> DataFrame:
    """per-request variant with literal thresholds and zscore 0 (no frame stats)."""
    amount, hour = F.col("amount"), F.col("hour")
    dev, cr = F.col("device_score"), F.col("country_risk")
    out = df.withColumns({
        "amount_log": F.log1p(amount),
        "amount_zscore": F.lit(0.0),
        "is_night": is_night(hour),
        "is_evening": is_evening(hour),
        "is_weekend": F.lit(0),
        "high_amount": _flag(amount > FIXED_HIGH_AMOUNT),
        "very_high_amount": _flag(amount > FIXED_VERY_HIGH_AMOUNT),
        "low_device": low_device(dev),
        "medium_device": medium_device(dev),
        "high_risk_country": high_risk_country(cr),
    })
    return out.withColumns({
        "risk_score": risk_score(F.col("high_amount"), F.col("low_device"),
                                 F.col("high_risk_country"), F.col("is_night")),
        "hour_sin": F.sin(F.lit(2 * math.pi) * hour / 24),
        "hour_cos": F.cos(F.lit(2 * math.pi) * hour / 24),
        "amount_device_interaction": amount * (1 - dev),
        "amount_country_interaction": amount * cr / 5,
    })


def store_features(df: DataFrame) -> DataFrame:
    """F16: the feature-store variant (9 features, defaults, its own risk score)."""
    # Defaults of the store variant (value defaults; hour 12 for the flags).
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    hour_value = F.coalesce(F.col("hour"), F.lit(0))
    hour_flag = F.coalesce(F.col("hour"), F.lit(12))
    dev = F.coalesce(F.col("device_score"), F.lit(0.5))
    cr = F.coalesce(F.col("country_risk"), F.lit(1))
    low = low_device(dev)
    hrc = high_risk_country(cr)
    night = is_night(hour_flag)
    keep = [c for c in ("transaction_id", "user_id", "created_at") if c in df.columns]
    return df.select(
        *keep,
        amount.alias("amount"),
        F.log1p(amount).alias("amount_log"),
        hour_value.alias("hour"),
        night.alias("is_night"),
        is_evening(hour_flag).alias("is_evening"),
        dev.alias("device_score"),
        low.alias("low_device"),
        cr.alias("country_risk"),
        hrc.alias("high_risk_country"),
        (low * 0.3 + hrc * 0.2 + night * 0.2).alias("risk_score"),
    )


def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """F17 fit: one row of population mean and std per column (ddof=0)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """F17 apply: (x - mean) / std, a zero std divides by 1."""
    joined = df.crossJoin(F.broadcast(scaler))
    scaled = {}
    for c in cols:
        std = F.col(f"{c}__std")
        scaled[c] = (F.col(c) - F.col(f"{c}__mean")) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return joined.withColumns(scaled).drop(*scaler.columns)


# Conditions (plain SQL) and rule texts in display order, and the fallback text.
RULE_TEXTS = [("amount > 2000", "Large Transaction Amount"), ("device_score < 0.3", "Low Device Trust Score"),
              ("country_risk >= 4", "High Risk Country"), ("hour < 6 OR hour > 22", "Unusual Transaction Hour")]
NO_RULE_TEXT = "Complex pattern detected by model logic."


def rule_reasons(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """ordered rule texts for flagged rows, joined by '; '."""
    kept = F.concat_ws("; ", *[F.when(F.expr(condition), F.lit(text)) for condition, text in RULE_TEXTS])  # NULL entries are skipped
    text = F.when(kept == "", F.lit(NO_RULE_TEXT)).otherwise(kept)
    return df.withColumn("reasons", F.when(F.col(label) == 1, text))


def feature_key(*cols: str) -> Column:
    """stable md5 over the named fields in sorted-name order.

    Numbers are written as integer micro-units so the key text does not
    depend on an engine's float-to-text formatting.
    """
    names = sorted(cols)
    parts = []
    for n in names:
        parts += [F.lit(n), F.round(F.col(n) * 1000000).cast("bigint").cast("string")]
    return F.md5(F.concat_ws("|", *parts))
