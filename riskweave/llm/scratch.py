"""Tables written to the cluster's shared folder, to cut lineage between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from riskweave.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files: they go with the query's end and not with the driver's next garbage collection."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Every later use reads the files, so a lost executor costs a re-read and
    not a recomputation, and two uses see the same rows.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch_folder = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
