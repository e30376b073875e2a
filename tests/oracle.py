"""Spark-vs-DuckDB comparison used by the tests and scripts/check_oracle.py.

Mirrors the driver's gate: same column names, same row count, and equal
values after sorting rows (floats compared to 1e-9). ``exact`` reports
whether the rounded value multisets are identical, as a value hash would.
"""

from __future__ import annotations

import datetime as _dt
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
             "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
             "decimal": "DECIMAL"}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        if math.isinf(v):
            return (2, "inf" if v > 0 else "-inf")
        return (3, round(v, 6))
    if isinstance(v, int):
        return (3, float(v))
    if hasattr(v, "__float__") and not isinstance(v, (str, bytes)):
        return (3, round(float(v), 6))
    if isinstance(v, _dt.datetime):
        return (4, v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return (5, tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return (6, tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return (7, str(v))


def _close(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (bool, int, float)) and isinstance(b, (bool, int, float)):
        a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        if math.isinf(a) or math.isinf(b):
            return a == b
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if isinstance(a, _dt.datetime) and isinstance(b, _dt.datetime):
        return a.replace(tzinfo=None) == b.replace(tzinfo=None)
    if hasattr(a, "asDict"):
        a = tuple(a)
    if hasattr(b, "asDict"):
        b = tuple(b)
    if isinstance(a, (list, tuple)) and isinstance(b, dict):
        b = tuple(b.values())
    if type(a) is not type(b) and hasattr(a, "__float__") and hasattr(b, "__float__"):
        return _close(float(a), float(b))
    return a == b


def compare(spark_df, con, sql: str) -> dict:
    srows = [tuple(r) for r in spark_df.collect()]
    scols = spark_df.columns
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    res = {"rows_spark": len(srows), "rows_oracle": len(orows), "cols_match": sorted(scols) == sorted(ocols)}
    stypes = dict(spark_df.dtypes)
    otypes = {d[0]: str(d[1]) for d in rel.description}
    tdiff = {c: (stypes[c], otypes.get(c)) for c in scols
             if c in otypes and _TYPE_MAP.get(stypes[c].split("(")[0], stypes[c]) != otypes[c].split("(")[0]}
    if tdiff:
        res["type_diff"] = tdiff
    if not res["cols_match"]:
        res["ok"] = False
        res["detail"] = f"spark cols {scols} vs oracle {ocols}"
        return res
    order = [ocols.index(c) for c in scols]
    orows = [tuple(r[i] for i in order) for r in orows]
    ks = sorted(srows, key=lambda r: tuple(_norm(v) for v in r))
    ko = sorted(orows, key=lambda r: tuple(_norm(v) for v in r))
    mism = None
    if len(ks) == len(ko):
        for a, b in zip(ks, ko):
            if not all(_close(x, y) for x, y in zip(a, b)):
                mism = (a, b)
                break
    res["ok"] = len(ks) == len(ko) and mism is None and not tdiff
    res["exact"] = res["ok"] and all(
        all((a == b) or (a is None and b is None) or (isinstance(a, float) and isinstance(b, float)
                                                       and math.isnan(a) and math.isnan(b))
            or (isinstance(a, _dt.datetime) and isinstance(b, _dt.datetime)
                and a.replace(tzinfo=None) == b.replace(tzinfo=None))
            or (hasattr(a, "__float__") and hasattr(b, "__float__") and not isinstance(a, (str, bytes))
                and float(a) == float(b))
            for a, b in zip(x, y))
        for x, y in zip(ks, ko))
    if mism:
        res["detail"] = f"first mismatch spark={mism[0]} oracle={mism[1]}"
    elif len(ks) != len(ko):
        res["detail"] = "row count differs"
    return res
