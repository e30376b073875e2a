"""File sources and sinks (S01-S03, S09, S10, S12, S13); appends with unique keys are in ``unique.py``.

All writes are distributed DataFrame writes; nothing is paged through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
# Full microsecond precision for timestamps in text formats (the default keeps milliseconds).
TS_OPTS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Header, no index column."""
    w = df.write.mode("overwrite").option("header", True).options(**TS_OPTS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Explicit schema, PERMISSIVE mode; malformed lines land in ``_corrupt_record``."""
    full = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    return (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").options(**TS_OPTS)
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, line): the data lines of header CSV files numbered from 0 in order of file name and place.

    A file's lines are placed by the split that reads them and their order in
    it: ``monotonically_increasing_id`` numbers the rows of a scan by partition,
    splits of one file are read in order of their offset, and no shuffle lies
    between scan and number. Counts per (file, partition), a row per split, are
    summed up to give each split its first number. The first line of every
    file is its header; a data line equal to it stays.
    """
    part = F.shiftright("_id", 33)
    scan = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_id")).withColumn("_part", part)
    counts = scan.groupBy("_file", "_offset").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    by_file = Window.partitionBy("_file").orderBy("_offset")
    before = Window.orderBy("_file", "_offset").rowsBetween(Window.unboundedPreceding, -1)  # a row per split, not per line
    starts = counts.withColumn("_head", F.when(F.row_number().over(by_file) == 1, 1).otherwise(0)).withColumn(
        "_start", F.coalesce(F.sum(F.col("_n") - F.col("_head")).over(before), F.lit(0)) - F.col("_head"))
    lines = scan.join(starts.select("_file", "_offset", "_first", "_start", "_head"), ["_file", "_offset"])
    at = F.col("_id") - F.col("_first")
    return lines.where((F.col("_head") == 0) | (at > 0)).select((F.col("_start") + at).alias("row_id"), F.col("value").alias("line"))


def pair_by_position(spark: SparkSession, x_path: str, y_path: str, x_schema: StructType,
                     y_schema: StructType) -> DataFrame:
    """Join two header CSV file sets row by row.

    Files are taken in name order; the pair is an equi-join on the position.
    Internally every table keeps a ``row_id`` instead, so this exists only to
    read such files (one line per row: quoted line breaks aren't supported).
    """
    def numbered(path, schema):
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        return numbered_lines(spark, path).select("row_id", F.from_csv("line", ddl).alias("r")).select("row_id", "r.*")
    return numbered(x_path, x_schema).join(numbered(y_path, y_schema), "row_id")


def write_json(df: DataFrame, path: str) -> None:
    """JSON report rows (one object per line)."""
    df.write.mode("overwrite").options(**TS_OPTS).json(path)


def write_archive(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Gzip JSON lines partitioned by ISO day of ``ts``."""
    df.withColumn("day", F.date_format(F.col(ts), "yyyy-MM-dd")).write.mode(mode) \
        .partitionBy("day").option("compression", "gzip").options(**TS_OPTS).json(path)


def read_archive(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of an archive with their own schema (nothing is inferred) and the partition ``day`` as text."""
    return spark.read.schema(StructType([*schema.fields, StructField("day", StringType())])).options(**TS_OPTS).json(path)


def content_sum(df: DataFrame, columns: Sequence[str]) -> tuple:
    """(rows, sum of row hashes): equal for the same rows in any order."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def export_json_lines(df: DataFrame, path: str) -> None:
    """Every row as one JSON text line."""
    df.select(F.to_json(F.struct(*df.columns), TS_OPTS).alias("value")).write.mode("overwrite").text(path)


def unnest_batch(bodies: DataFrame, body: str, item_schema: str, keep: list[str]) -> DataFrame:
    """A JSON body ``{"transactions": [...]}`` -> one row per item with its position."""
    parsed = bodies.select(*keep, F.from_json(F.col(body), f"struct<transactions: array<struct<{item_schema}>>>")
                           .alias("_b"))
    return parsed.select(*keep, F.posexplode("_b.transactions").alias("pos", "_t")).select(*keep, "pos", "_t.*")
