"""Parquet and CSV files in and out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import CONTROL, INPUT, METRICS


def with_lineage(rows: DataFrame, position: bool = True) -> DataFrame:
    """Adds the file path, its time and the 0-based row position in the file.

    All three come from the Parquet reader; splitting a file does not change
    the positions and no footer is read on the driver.
    """
    added = [
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    ]
    if position:
        added.append(F.col("_metadata.row_index").alias("row_number"))
    return rows.select("*", *added)


def scan(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | None = INPUT,
    recursive: bool = True,
) -> DataFrame:
    """All `.parquet` files below the paths, with lineage."""
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return with_lineage(reader.parquet(*([paths] if isinstance(paths, str) else paths)))


def listed_files(spark: SparkSession, path: str, suffix: str = "*.parquet") -> DataFrame:
    """Path, size and time of the files below a prefix; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", suffix)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("source_file"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("file_time"),
        )
    )


LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def new_files(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """A stream of the names of new Parquet files; contents are not read.

    A micro-batch frame is opaque to the optimizer. Streaming names instead of
    rows leaves column pruning and splitting to an ordinary scan of the files.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(LISTING)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path).select("path", F.col("modificationTime").alias("file_time"))


def literal_path(path: str) -> str:
    """A file name as a reader path: pattern characters stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def scan_nanoseconds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files whose `reference_date` is stored in nanoseconds.

    The session reads such columns as LONG when
    `spark.sql.legacy.parquet.nanosAsLong` is true; it must be set beforehand.
    """
    raw = T.StructType(
        [
            T.StructField(f.name, T.LongType() if f.name == "reference_date" else f.dataType)
            for f in INPUT
        ]
    )
    return scan(spark, paths, raw).withColumn(
        "reference_date", nanoseconds_to_timestamp(F.col("reference_date"))
    )


def nanoseconds_to_timestamp(c: Column) -> Column:
    """Whole microseconds since 1970 as a zone-free timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.floor(c / F.lit(1000).cast("decimal(4,0)")).cast("long")
    return epoch + F.make_dt_interval(
        secs=(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    )


def write_records(records: DataFrame, path: str, rows_per_file: int) -> None:
    """Input files of at most `rows_per_file` rows."""
    records.select(*INPUT.names).write.option("maxRecordsPerFile", rows_per_file).mode(
        "overwrite"
    ).parquet(path)


def write_allocated(records: DataFrame, path: str) -> None:
    """One folder per `file_number`, so that each number's keys stay together."""
    records.select("file_number", *INPUT.names).write.partitionBy("file_number").mode(
        "overwrite"
    ).parquet(path)


def write_control_csv(records: DataFrame, path: str) -> None:
    records.select(*CONTROL.names).write.option("header", True).mode("overwrite").csv(path)


def read_control_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTROL).option("header", True).csv(path)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics.select(*METRICS.names).write.option("header", True).mode("append").csv(path)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).option("header", True).csv(path)
