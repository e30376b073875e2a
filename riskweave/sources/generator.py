"""Synthetic transactions (S04) and external card data standardising.

Random columns come from a seeded hash of the row id (stable under any
repartitioning, unlike ``rand``), so the same id always yields the same row.
The generator is driven by the ids of an existing table: its size follows
that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_53 = float(2 ** 53)

# Country risk levels and their probabilities.
COUNTRY_LEVELS = [1, 2, 3, 4, 5]
COUNTRY_PROBS = [0.4, 0.3, 0.2, 0.08, 0.02]


def uniform(row_id: Column, seed: int, stream: int) -> Column:
    """U[0,1) from xxhash64(id, seed, stream), 53 random bits."""
    h = F.xxhash64(row_id, F.lit(seed), F.lit(stream))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(TWO_53)


def drawn(row_id: Column, seed: int, stream: int) -> Column:
    """U[0,1) from the first 52 bits of md5(id/seed/stream): a draw that any SQL engine can repeat."""
    key = F.md5(F.concat_ws("/", row_id.cast("string"), F.lit(str(seed)), F.lit(str(stream))))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 52))


def categorical(u: Column, levels: list[int], probs: list[float]) -> Column:
    cum = 0.0
    expr = None
    for lvl, p in zip(levels, probs):
        cum += p
        cond = u < F.lit(cum)
        expr = F.when(cond, F.lit(lvl)) if expr is None else expr.when(cond, F.lit(lvl))
    return expr.otherwise(F.lit(levels[-1]))


def synthetic_transactions(ids: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Amount ~ Exp(mean 100), hour ~ U{0..23}, device ~ Beta(5,2)
    (5th smallest of 6 uniforms), country by fixed probabilities, and a fraud
    label ~ Bernoulli(clip(rule sum, 0, 1))."""
    rid = F.col(id_col)
    amount = -100.0 * F.log(1 - uniform(rid, seed, 0))
    hour = F.floor(uniform(rid, seed, 1) * 24).cast("int")
    device = F.element_at(F.array_sort(F.array(*[uniform(rid, seed, 10 + k) for k in range(6)])), 5)
    country = categorical(uniform(rid, seed, 2), COUNTRY_LEVELS, COUNTRY_PROBS)
    base = ids.select(rid.alias("row_id"), amount.alias("amount"), hour.alias("hour"),
                      device.alias("device_score"), country.cast("int").alias("country_risk"))
    # Rule terms of the label probability.
    prob = (F.lit(0.01) + 0.05 * (F.col("amount") > 500).cast("int") + 0.10 * (F.col("country_risk") >= 4).cast("int")
            + 0.15 * (F.col("device_score") < 0.2).cast("int")
            + 0.05 * ((F.col("hour") < 5) | (F.col("hour") > 23)).cast("int"))
    prob = F.least(F.greatest(prob, F.lit(0.0)), F.lit(1.0))
    return base.withColumn("is_fraud", (uniform(F.col("row_id"), seed, 3) < prob).cast("int"))


def standardize_card_data(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rename Time/V1/V2/Amount/Class, hour = int(Time/3600) % 24, and
    seeded device_score ~ U(0.5, 1) and country_risk by fixed probabilities."""
    renamed = df.withColumnsRenamed({"Time": "time_elapsed", "V1": "feature_1", "V2": "feature_2",
                                     "Amount": "amount", "Class": "is_fraud"})
    rid = F.col(id_col)
    return renamed.withColumns({
        "hour": (F.floor(F.col("time_elapsed") / 3600) % 24).cast("int"),
        "device_score": 0.5 + 0.5 * drawn(rid, seed, 20),
        "country_risk": categorical(drawn(rid, seed, 21), COUNTRY_LEVELS, COUNTRY_PROBS).cast("int"),
    })
