"""Exact stratified splits and folds.

Each class is ordered by a seeded hash of the row id and cut at exact
per-class sizes. The per-class rank comes from ``prefix_sums`` with the
class as the group and the hash's leading digits as bucket, so a class
holding most rows never lands in a single task (a plain
``row_number().over(partitionBy(label))`` would).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranking import prefix_sums


def split_order_key(row_id: str, seed: int) -> Column:
    """Seeded order key: md5 text of 'seed:id' (also computable in plain SQL)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def class_ranks(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """Add ``_rank`` (0-based, within class, by seeded hash) and ``_class_n``."""
    keyed = df.withColumn("_key", F.struct(split_order_key(row_id, seed).alias("h"), F.col(row_id).alias("i")))
    carry = [c for c in df.columns if c != label]
    ranked = prefix_sums(keyed, "_key", {"cnt": F.lit(1)}, by=[label], unique_keys=True, carry=carry,
                         bucket=F.substring("_key.h", 1, 3))
    return ranked.select(*df.columns, (F.col("cum_cnt") - 1).alias("_rank"),
                         F.col("total_cnt").alias("_class_n"))


def stratified_split(df: DataFrame, label: str, row_id: str, seed: int = 42,
                     holdout: float = 0.4, test_share: float = 0.5) -> DataFrame:
    """Add ``split`` in {train, val, test}; exact per-class sizes.

    Per class of n rows: ceil(holdout*n) rows are held out; of those
    ceil(test_share*held) go to test and the rest to val.
    """
    ranked = class_ranks(df, label, row_id, seed)
    held = F.ceil(F.lit(holdout) * F.col("_class_n"))
    n_train = F.col("_class_n") - held
    n_test = F.ceil(F.lit(test_share) * held)
    n_val = held - n_test
    split = (F.when(F.col("_rank") < n_train, "train")
             .when(F.col("_rank") < n_train + n_val, "val").otherwise("test"))
    return ranked.withColumn("split", split).drop("_rank", "_class_n")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = per-class hash rank mod k (balanced class counts per fold)."""
    ranked = class_ranks(df, label, row_id, seed)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_class_n")


def split_overlap(split_df: DataFrame, row_id: str) -> DataFrame:
    """Rows of one split whose id appears in another split (expect none)."""
    return split_df.groupBy(row_id).agg(F.min("split").alias("_s1"), F.max("split").alias("_s2")).where(
        F.col("_s1") < F.col("_s2"))
