"""One table of (ID, Spark builder, oracle SQL) for every registered query.

``(spark, sf_dir)`` and returns a DataFrame over the driver tables; the SQL
is the DuckDB twin over the same Parquet views (None = rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    qid: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(qid: str, sql: str | None = None):
    def deco(fn):
        if qid in REGISTRY:
            raise ValueError(f"duplicate query id {qid}")
        REGISTRY[qid] = Query(qid, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module so its queries register themselves."""
    from riskweave.plans import catalog  # noqa: F401
    return REGISTRY
