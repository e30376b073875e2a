"""Running Structured Streaming jobs to completion and reading their sinks.

* ``stage_files`` writes a table as time-ordered appends so a file source
  replays it as several micro-batches (oldest first), each of one file or
  of as many as tasks write at once (``files_per_chunk``).
* ``run_available_now`` drains every available file and stops; the
  checkpoint lives under the shared checkpoint folder, so a restarted job
  resumes from its last committed batch.
* ``write_updates`` / ``final_updates`` turn an ``update``-mode aggregation
  into a table: every micro-batch appends its changed rows tagged with the
  batch id, and the final value of a key is its row from the highest batch.
  A replayed batch writes the same rows again with the same id, so the
  result is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskweave.operators.windows import micros


def files_per_chunk(spark: SparkSession, chunks: int = 3) -> int:
    """As many files in a chunk as keep all cores at work while the chunks are written."""
    return max(1, -(-spark.sparkContext.defaultParallelism // chunks))


def stage_files(df: DataFrame, path: str, ts: str, chunks: int = 3, files: int = 1) -> None:
    """Write ``df`` as files in order of ``ts``: one write, ``files`` files per chunk of time.

    The file source takes files by age, so the files get ascending times.
    """
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())

    def listed() -> dict:
        found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {p.getName(): p for p in found if p.getName().startswith("part-")}
    before = listed()
    df.repartitionByRange(chunks * files, micros(ts)).write.mode("append").parquet(path)
    made = [p for name, p in sorted(listed().items()) if name not in before]
    newest = max((fs.getFileStatus(p).getModificationTime() for p in made), default=0)
    for age, p in enumerate(reversed(made)):
        fs.setTimes(p, newest - 1000 * age, -1)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_time(df: DataFrame, ts: str, out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not NTZ); the session time zone is UTC."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def run_available_now(writer: DataStreamWriter, checkpoint: str, timeout_s: float | None = None) -> None:
    """Drain what is there and stop; ``timeout_s`` bounds the wait only where it is given."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        done = q.awaitTermination(timeout_s) if timeout_s is not None else q.awaitTermination()
        if timeout_s is not None and not done:
            raise TimeoutError(f"stream did not finish within {timeout_s}s")
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        if q.isActive:
            q.stop()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the batch rows in a folder of their batch id (read back as column ``batch_id``).

    A batch that runs again after a failure replaces its own folder."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return sink


def final_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last emitted row per key (highest batch id) of an update-mode sink."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in keys and c != "batch_id"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_last"))
    return last.select(*keys, "_last.*")
