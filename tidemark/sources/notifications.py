"""Object-created notifications to file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import NOTIFICATION


def unwrapped(body: Column) -> Column:
    """The inner message of an envelope, or the body itself.

    The inner text counts only if it is JSON; otherwise the body is kept.
    """
    parsed = F.try_parse_json(body)
    message = F.try_variant_get(parsed, "$.Message", "string")
    is_envelope = (F.try_variant_get(parsed, "$.Type", "string") == "Notification") & (
        F.schema_of_variant(F.try_variant_get(parsed, "$.Message", "variant")) == "STRING"
    )
    return F.when(is_envelope & F.try_parse_json(message).isNotNull(), message).otherwise(body)


def notified_files(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row per notified Parquet file: the message columns, bucket, key, path."""
    records = F.from_json(unwrapped(F.col(body)), NOTIFICATION).getField("Records")
    kept = [c for c in messages.columns if c != body]
    entries = messages.select(*kept, F.explode(records).alias("_record")).select(
        *kept,
        F.col("_record.s3.bucket.name").alias("bucket"),
        F.col("_record.s3.object.key").alias("key"),
    )
    usable = (F.col("bucket") != "") & (F.col("key") != "") & F.col("key").endswith(".parquet")
    return entries.filter(usable).withColumn(
        "source_file", F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key")
    )
