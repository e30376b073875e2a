"""Registered queries: stratified split, folds and leakage check."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import split as sp
from riskweave.plans._sqlhelp import r9
from riskweave.plans.registry import register
from riskweave.sources.tables import transactions, with_ctes

SEED = 42

_RANK_CTE = f"""rk AS (
  SELECT *, row_number() OVER (PARTITION BY is_fraud
             ORDER BY md5('{SEED}:' || CAST(transaction_id AS VARCHAR)), transaction_id) - 1 AS rnk,
         count(*) OVER (PARTITION BY is_fraud) AS cn
  FROM tx),
sp AS (
  SELECT *, CASE WHEN rnk < cn - ceil(0.4 * cn) THEN 'train'
                 WHEN rnk < cn - ceil(0.4 * cn) + (ceil(0.4 * cn) - ceil(0.5 * ceil(0.4 * cn))) THEN 'val'
                 ELSE 'test' END AS split
  FROM rk)"""


def split_tx(spark, sf_dir):
    return sp.stratified_split(transactions(spark, sf_dir), "is_fraud", "transaction_id", seed=SEED)


@register("P01", with_ctes("SELECT transaction_id, is_fraud, split FROM sp", "tx", extra=[_RANK_CTE]))
def q_p01(spark, sf_dir):
    """Exact stratified 60/20/20 split of all transactions."""
    return split_tx(spark, sf_dir).select("transaction_id", "is_fraud", "split")


@register("P02", with_ctes("""SELECT is_fraud, CAST(rnk % 5 AS INTEGER) AS fold, count(*) AS n
    FROM rk GROUP BY ALL""", "tx", extra=[_RANK_CTE]))
def q_p02(spark, sf_dir):
    """Stratified 5-fold assignment: rows per (class, fold)."""
    folds = sp.stratified_folds(transactions(spark, sf_dir), "is_fraud", "transaction_id", k=5, seed=SEED)
    return folds.groupBy("is_fraud", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("P03", with_ctes("""SELECT count(*) AS overlapping_rows FROM sp a JOIN sp b
    ON a.transaction_id = b.transaction_id AND a.split < b.split""", "tx", extra=[_RANK_CTE]))
def q_p03(spark, sf_dir):
    """Leakage check: ids present in two splits (expected 0)."""
    return sp.split_overlap(split_tx(spark, sf_dir), "transaction_id").agg(
        F.count(F.lit(1)).alias("overlapping_rows"))


@register("A04", with_ctes("""SELECT split, count(*) AS n_rows, round(avg(is_fraud), 9) AS fraud_rate
    FROM sp GROUP BY split""", "tx", extra=[_RANK_CTE]))
def q_a04(spark, sf_dir):
    """Fraud rate and size per split."""
    return split_tx(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), r9(F.avg("is_fraud"), "fraud_rate"))
