"""State of ``foreachBatch`` jobs as tables partitioned by batch and event time.

A batch writes only its own rows, below ``rows/_batch=N``, so a batch that runs
again replaces what it wrote, and reads rows of earlier batches only, so it
sees the same state again. ``progress/_batch=N`` holds the newest event time up
to and including batch N; the horizon of a batch (that time as of the batch
before, less the allowed lateness) tells which rows come too late and which
state no row can reach any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_BATCH, _CHUNK = "_batch", "_chunk"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def partitions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Values of the ``name=N`` folders below ``path`` (a listing, no data read)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}="))


class TimedState:
    """Rows kept for ``late_us + reach_us`` of event time; ``t`` is a column of epoch microseconds."""

    def __init__(self, path: str, late_us: int, reach_us: int, t: str = "_t"):
        self.path, self.late_us, self.reach_us, self.t = path, late_us, reach_us, t
        self.chunk_us = max(1, 16 * reach_us, late_us // 64)

    def newest(self, spark: SparkSession, batch_id: int) -> int | None:
        """Newest event time seen before the batch."""
        done = [i for i in partitions(spark, f"{self.path}/progress", _BATCH) if i < batch_id]
        return spark.read.schema("newest long").parquet(f"{self.path}/progress/{_BATCH}={done[-1]}").first()[0] if done else None

    def horizon(self, spark: SparkSession, batch_id: int) -> int | None:
        newest = self.newest(spark, batch_id)
        return None if newest is None else newest - self.late_us

    def read(self, spark: SparkSession, batch_id: int, schema: StructType, chunks: list[int] | None = None) -> DataFrame | None:
        """State rows of earlier batches, of some chunks of time only if given."""
        if not any(i < batch_id for i in partitions(spark, f"{self.path}/rows", _BATCH)):
            return None
        whole = StructType([*schema.fields, StructField(_BATCH, LongType()), StructField(_CHUNK, LongType())])
        rows = spark.read.schema(whole).parquet(f"{self.path}/rows").where(F.col(_BATCH) < batch_id)
        return (rows if chunks is None else rows.where(F.col(_CHUNK).isin(chunks))).drop(_BATCH, _CHUNK)

    def chunk(self, at: Column) -> Column:
        return F.floor(at / self.chunk_us).cast("long")

    def touched(self, rows: DataFrame) -> list[int]:
        """Chunks within reach of the rows: at most the batch's time span over the chunk's length."""
        t = F.col(self.t)
        span = F.explode(F.sequence(self.chunk(t - self.reach_us), self.chunk(t + self.reach_us)))
        return [r[0] for r in rows.select(span.alias("c")).distinct().collect()]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.withColumn(_CHUNK, self.chunk(F.col(self.t))).write.mode("overwrite").partitionBy(_CHUNK).parquet(
            f"{self.path}/rows/{_BATCH}={batch_id}")

    def commit(self, spark: SparkSession, batch_id: int, newest: int | None) -> None:
        """Last step of a batch: its newest event time (with that of the batches before)."""
        known = [x for x in (newest, self.newest(spark, batch_id)) if x is not None]
        if known:
            spark.createDataFrame([(max(known),)], "newest long").coalesce(1).write.mode("overwrite").parquet(
                f"{self.path}/progress/{_BATCH}={batch_id}")

    def forget(self, spark: SparkSession, batch_id: int) -> None:
        """Delete chunks of earlier batches that lie before the batch's horizon, reach included."""
        horizon = self.horizon(spark, batch_id)
        if horizon is None:
            return
        fs, _ = _fs(spark, self.path)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for i in partitions(spark, f"{self.path}/rows", _BATCH):
            folder = f"{self.path}/rows/{_BATCH}={i}"
            if i < batch_id:
                chunks = partitions(spark, folder, _CHUNK)
                old = [c for c in chunks if (c + 1) * self.chunk_us <= horizon - self.reach_us]
                for target in ([folder] if len(old) == len(chunks) else [f"{folder}/{_CHUNK}={c}" for c in old]):
                    fs.delete(path(target), True)
        drop_before(spark, self.path, ("progress",), batch_id - 1)


def drop_before(spark: SparkSession, path: str, names: tuple[str, ...], batch_id: int) -> None:
    """Delete the batch folders below ``path/name`` that come before the newest one older than ``batch_id``."""
    fs, _ = _fs(spark, path)
    for name in names:
        older = [i for i in partitions(spark, f"{path}/{name}", _BATCH) if i < batch_id]
        for i in older[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{_BATCH}={i}"), True)
