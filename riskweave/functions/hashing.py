"""Deterministic md5 routing buckets (R01-R04) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def md5_unit_bucket(text: Column) -> Column:
    """First 4 md5 bytes, big-endian, / 2^32 -> [0, 1)."""
    head = F.substring(F.md5(text), 1, 8)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / F.lit(TWO_32)


def md5_mod(text: Column, m: int = 100) -> Column:
    """Whole 128-bit md5 value modulo m, folded over its four 32-bit words.

    (acc * 2^32 + word) mod m == (acc * (2^32 mod m) + word) mod m.
    """
    h = F.md5(text)
    r = int(TWO_32) % m
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        word = F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * F.lit(r) + word, F.lit(m))
    return acc


def normalise_weights(variants: dict[str, float]) -> dict[str, float]:
    total = sum(variants.values())
    if abs(total - 1.0) > 0.001:
        return {k: v / total for k, v in variants.items()}
    return dict(variants)


def weighted_variant(bucket: Column, variants: dict[str, float]) -> Column:
    """Cumulative-weight choice: first variant whose cumulative weight > bucket."""
    variants = normalise_weights(variants)
    names = list(variants)
    cum = 0.0
    expr = None
    for name in names:
        cum += variants[name]
        expr = F.when(bucket < F.lit(cum), F.lit(name)) if expr is None else expr.when(bucket < F.lit(cum), F.lit(name))
    return expr.otherwise(F.lit(names[0]))


def weighted_variant_sql(bucket_sql: str, variants: dict[str, float]) -> str:
    variants = normalise_weights(variants)
    names = list(variants)
    cum = 0.0
    parts = []
    for name in names:
        cum += variants[name]
        parts.append(f"WHEN {bucket_sql} < {cum!r} THEN '{name}'")
    return "CASE " + " ".join(parts) + f" ELSE '{names[0]}' END"


def md5_unit_bucket_sql(text_sql: str) -> str:
    return f"(CAST(CAST(('0x' || substring(md5({text_sql}), 1, 8)) AS UBIGINT) AS DOUBLE) / {TWO_32!r})"


def md5_mod_sql(text_sql: str, m: int = 100) -> str:
    r = int(TWO_32) % m
    acc = "CAST(0 AS BIGINT)"
    for i in range(4):
        word = f"CAST(CAST(('0x' || substring(md5({text_sql}), {1 + 8 * i}, 8)) AS UBIGINT) AS BIGINT)"
        acc = f"(({acc} * {r} + {word}) % {m})"
    return acc
