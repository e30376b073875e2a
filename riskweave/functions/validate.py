"""Validation, sanitising and defaults (V01-V04) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Strict request bounds.
MAX_AMOUNT = 1_000_000.0
MAX_ID_CHARS = 100
MAX_TX_COUNT = 1000
MAX_TEXT_CHARS = 1000

REQUIRED = ["amount", "hour", "device_score", "country_risk"]


def strict_reasons(c: dict[str, str] | None = None) -> Column:
    """Comma-joined list of every violated bound (NULL when valid)."""
    amount, hour = F.col("amount"), F.col("hour")
    dev, cr = F.col("device_score"), F.col("country_risk")
    checks = [
        F.when(amount.isNull() | (amount <= 0) | (amount > MAX_AMOUNT), F.lit("amount")),
        F.when(hour.isNull() | (hour < 0) | (hour > 23), F.lit("hour")),
        F.when(dev.isNull() | (dev < 0) | (dev > 1), F.lit("device_score")),
        F.when(cr.isNull() | (cr < 1) | (cr > 5), F.lit("country_risk")),
        F.when(F.length("user_id") > MAX_ID_CHARS, F.lit("user_id")),
        F.when(F.length("merchant_id") > MAX_ID_CHARS, F.lit("merchant_id")),
        F.when((F.col("transaction_count_last_hour") < 0)
               | (F.col("transaction_count_last_hour") > MAX_TX_COUNT), F.lit("transaction_count_last_hour")),
    ]
    joined = F.concat_ws(",", *checks)
    return F.when(joined == "", F.lit(None).cast("string")).otherwise(joined)


def validate_strict(df: DataFrame) -> DataFrame:
    """Add ``reject_reasons`` and ``is_valid``; route with a filter on it."""
    return df.withColumn("reject_reasons", strict_reasons()) \
        .withColumn("is_valid", F.col("reject_reasons").isNull())


def lenient_reason(cols: list[str]) -> Column:
    """The first failing rule's message, NULL when the record passes."""
    missing = [c for c in REQUIRED if c not in cols]
    if missing:
        return F.lit(f"Missing required fields: {missing}")
    any_null = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    # Lenient rule messages in evaluation order.
    return F.coalesce(
        F.when(F.size(any_null) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(any_null, ","))),
        F.when(F.col("amount") < 0, F.lit("Amount must be non-negative")),
        F.when(~F.col("hour").between(0, 23), F.lit("Hour must be between 0 and 23")),
        F.when(~F.col("device_score").between(0, 1), F.lit("Device score must be between 0 and 1")),
        F.when(~F.col("country_risk").between(1, 5), F.lit("Country risk must be between 1 and 5")),
    )


def sanitize_strings(df: DataFrame, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """Trim and truncate every string column; other types unchanged."""
    fixed = {f.name: F.substring(F.trim(F.col(f.name)), 1, max_chars)
             for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns(fixed) if fixed else df


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill optional columns (missing count -> 0)."""
    out = df
    for name, value in defaults.items():
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
        else:
            out = out.withColumn(name, F.lit(value))
    return out
