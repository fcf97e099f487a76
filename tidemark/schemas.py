"""Column lists, types and keys of every table."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["account_id", "asset_id", "reference_date"]
VALUES = ["quantity", "amount"]
POSITION_KEY = ["source_file", "row_number"]

QUANTITY = T.DecimalType(18, 4)
AMOUNT = T.DecimalType(18, 2)


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


INPUT = _struct(
    ("account_id", T.StringType()),
    ("asset_id", T.StringType()),
    ("reference_date", T.TimestampNTZType()),
    ("quantity", T.DoubleType()),
    ("amount", T.DoubleType()),
)

STAGING = _struct(
    ("batch_id", T.StringType()),
    ("source_file", T.StringType()),
    ("row_number", T.LongType()),
    ("record_hash", T.StringType()),
    ("account_id", T.StringType()),
    ("asset_id", T.StringType()),
    ("reference_date", T.DateType()),
    ("quantity", QUANTITY),
    ("amount", AMOUNT),
    ("created_at", T.TimestampNTZType()),
    ("seq", T.LongType()),
)

ERROR = _struct(
    ("batch_id", T.StringType()),
    ("source_file", T.StringType()),
    ("row_number", T.LongType()),
    ("payload", T.StringType()),
    ("error_reason", T.StringType()),
    ("created_at", T.TimestampNTZType()),
)

PRINCIPAL = _struct(
    ("account_id", T.StringType()),
    ("asset_id", T.StringType()),
    ("reference_date", T.DateType()),
    ("quantity", QUANTITY),
    ("amount", AMOUNT),
    ("updated_at", T.TimestampNTZType()),
    ("created_at", T.TimestampNTZType()),
)

METRICS = _struct(
    ("timestamp", T.DoubleType()),
    ("batch", T.LongType()),
    ("batch_time_ms", T.DoubleType()),
    ("inserted", T.LongType()),
    ("updated", T.LongType()),
    ("total_processed", T.LongType()),
)

CONTROL = _struct(
    ("account_id", T.StringType()),
    ("asset_id", T.StringType()),
    ("reference_date", T.DateType()),
    ("quantity", T.DoubleType()),
    ("amount", T.DoubleType()),
    ("source_file", T.StringType()),
)

SNAPSHOT = _struct(
    ("elapsed", T.LongType()),
    ("staging", T.LongType()),
    ("principal", T.LongType()),
    ("errors", T.LongType()),
)

NOTIFICATION = T.StructType().add(
    "Records",
    T.ArrayType(
        T.StructType().add(
            "s3",
            T.StructType()
            .add("bucket", T.StructType().add("name", T.StringType()))
            .add("object", T.StructType().add("key", T.StringType())),
        )
    ),
)
