"""Rounding shared by plan modules so both engines hash the same values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 9


def r9(c: Column | str, name: str | None = None) -> Column:
    """Round a float result to 9 places (last-bit noise of different summation
    orders must not change the value hash). A string names its own output."""
    col = F.col(c) if isinstance(c, str) else c
    alias = name or (c if isinstance(c, str) else None)
    out = F.round(col, DIGITS)
    return out.alias(alias) if alias else out
