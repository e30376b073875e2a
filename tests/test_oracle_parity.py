"""Every registered query against its DuckDB twin (sf0.001), and the entry contract."""

import importlib.util
import os

import pytest

from oracle import compare, duck
from riskweave.plans.registry import load_all
from conftest import ROOT, SF_SMALL

REG = load_all()
WITH_SQL = sorted(q for q, v in REG.items() if v.sql is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("qid", WITH_SQL)
def test_query_matches_oracle(spark, con, qid):
    res = compare(REG[qid].build(spark, SF_SMALL), con, REG[qid].sql)
    assert res["ok"], res


def _rates(rows, *names):
    return all(0.0 <= r[n] <= 1.0 for r in rows for n in names if r[n] is not None)


# what each query without SQL must hold on sf0.001
CHECKS = {
    "L05": lambda rows: len(rows) >= 3 and all(r["error"] is None for r in rows) and _rates(rows, "roc_auc", "average_precision")
    and sum(r["best_by_roc_auc"] for r in rows) == 1 and all(len(r["importances"]) == 19 for r in rows),
    "M08": lambda rows: len(rows) == 5 and sorted(r["fold"] for r in rows) == list(range(5)) and _rates(rows, "roc_auc"),
    "M09": lambda rows: len(rows) == 19 and [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True),
    "L04": lambda rows: len(rows) == 1 and _rates(rows, "roc_auc", "average_precision", "recall") and rows[0]["train_rows"] > 0,
    "L03": lambda rows: len({r["transaction_id"] for r in rows}) == len(rows) and all(0 < r["fraud_probability"] < 1 for r in rows),
    "L07": lambda rows: len(rows) == 1 and _rates(rows, "roc_auc", "average_precision"),
}


@pytest.mark.parametrize("qid", sorted(q for q, v in REG.items() if v.sql is None))
def test_rows_only_queries(spark, qid):
    rows = REG[qid].build(spark, SF_SMALL).collect()
    assert rows and CHECKS.get(qid, bool)(rows), rows[:3]


def test_entry_contract(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
