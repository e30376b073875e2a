"""Archive and retention (C01, C02) over day-partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskweave.sources.files import content_sum, read_archive, write_archive
from riskweave.streaming.state import path_exists


def write_by_day(df: DataFrame, path: str, ts: str) -> None:
    """A Parquet table partitioned by the ISO day of ``ts``, as ``archive_in_place`` expects it."""
    df.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("overwrite").partitionBy("day").parquet(path)


def read_by_day(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("day", StringType())])).parquet(path)


def _mark(spark: SparkSession, path: str, rows: tuple) -> None:
    spark.createDataFrame([rows], _COUNTS).coalesce(1).write.mode("overwrite").parquet(path)


_COUNTS = "archived long, kept long, verified boolean"


def archive_in_place(spark: SparkSession, table: str, schema: StructType, ts: str, cutoff: str, archive: str, run: str,
                     dry_run: bool = False) -> DataFrame:
    """Move the table's rows with ``ts`` before ``cutoff`` to a gzip JSON archive and remove them from the table.

    One run, named ``run``, is three steps, and running it again after a failure
    in any of them ends in the same state:

    1. the old rows are written to the run's archive folder, and what the
       cutoff's own day keeps to a staging folder;
    2. the archive is read back and compared (rows and content); only then is
       the run marked as verified, and from then on step 1 is not repeated;
    3. days before the cutoff's are removed, its own day is replaced by the
       staged rows (a dynamic overwrite of that partition), and the run is
       marked as done.

    A run whose archive doesn't match touches nothing. Rows that reach the
    archived days while a run is on are not part of it, so writers must not
    write there. Returns archived, kept (rows of the table then), verified.
    """
    files, staged, state = f"{archive}/run={run}", f"{archive}/_staged/{run}", f"{archive}/_state/{run}"
    cut, day = F.lit(cutoff).cast("timestamp_ntz"), cutoff[:10]
    if path_exists(spark, f"{state}/done/_SUCCESS"):
        return spark.read.schema(_COUNTS).parquet(f"{state}/done")
    rows = read_by_day(spark, table, schema)
    old = rows.where((F.col("day") <= day) & (F.col(ts) < cut)).drop("day")  # the partition filter prunes later days
    if dry_run:
        return old.agg(F.count(F.lit(1)).alias("archived")).select(
            "archived", F.lit(None).cast("long").alias("kept"), F.lit(False).alias("verified"))
    if not path_exists(spark, f"{state}/verified/_SUCCESS"):
        write_archive(old, files, ts)
        rows.where((F.col("day") == day) & (F.col(ts) >= cut)).write.mode("overwrite").parquet(staged)
        wanted, written = content_sum(old, schema.names), content_sum(read_archive(spark, files, schema), schema.names)
        if written != wanted:
            return spark.createDataFrame([(written[0], None, False)], _COUNTS)
        _mark(spark, f"{state}/verified", (written[0], None, True))
    drop_partitions_before(spark, table, "day", day)
    kept_of_day = read_by_day(spark, staged, schema)
    if kept_of_day.isEmpty():
        drop_partitions_before(spark, table, "day", f"{day}~")
    else:
        kept_of_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)
    archived = spark.read.schema(_COUNTS).parquet(f"{state}/verified").first()["archived"]
    _mark(spark, f"{state}/done", (archived, read_by_day(spark, table, schema).count(), True))
    return spark.read.schema(_COUNTS).parquet(f"{state}/done")


def drop_partitions_before(spark: SparkSession, path: str, column: str, oldest_kept: str) -> list[str]:
    """Delete partition directories ``column=value`` with value < oldest_kept.

    Works on partition values, not file modification times. Returns the dropped values.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(f"{column}="):
            value = name.split("=", 1)[1]
            if value < oldest_kept:
                fs.delete(st.getPath(), True)
                dropped.append(value)
    return dropped
