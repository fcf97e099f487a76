"""What the files of a list hold, from their footers alone.

One distributed pass over the names reads no data. It tells files that are
missing or no Parquet from readable ones, and the column types of the latter, so
that a scan can read every file with its own types.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import INPUT
from tidemark.sources.files import literal_path, nanoseconds_to_timestamp, scan

NANOSECONDS = "nanoseconds"


def footers(names: DataFrame) -> DataFrame:
    """(path, file_time, shape, error) of a column `path`; `shape` lists the input columns and their types."""
    wanted = set(INPUT.names)

    def spark_type(kind) -> str:
        import pyarrow.types as t

        if t.is_dictionary(kind):
            return spark_type(kind.value_type)
        if t.is_timestamp(kind):
            return NANOSECONDS if kind.unit == "ns" else "timestamp" if kind.tz else "timestamp_ntz"
        if t.is_decimal(kind):
            return f"decimal({kind.precision},{kind.scale})"
        plain = {"int8": "int", "int16": "int", "int32": "int", "int64": "bigint", "float": "float", "double": "double"}
        plain |= {"string": "string", "large_string": "string", "bool": "boolean", "date32[day]": "date"}
        if str(kind) not in plain:
            raise ValueError(f"a column of type {kind} is not supported")
        return plain[str(kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            times, shapes, errors = [], [], []
            for path in batch.column(0).to_pylist():
                try:
                    if path.startswith("file:") or path.startswith("/"):
                        files, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                    else:
                        files, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
                    schema = pq.read_schema(place, filesystem=files)
                    shape = ",".join(f"{f.name} {spark_type(f.type)}" for f in schema if f.name in wanted)
                    times.append(files.get_file_info(place).mtime)
                    shapes.append(shape)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - whatever a footer raises, the file is not readable
                    times.append(None)
                    shapes.append(None)
                    errors.append(f"{type(error).__name__}: {error}".split("\n", 1)[0][:500])
            columns = [pa.array(times, pa.timestamp("us", "UTC")), pa.array(shapes, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", "file_time", "shape", "error"])

    return names.select("path").mapInArrow(run, "path string, file_time timestamp, shape string, error string")


def scan_shape(spark: SparkSession, paths: list[str], shape: str) -> DataFrame:
    """Files of one shape as input rows with lineage; values are cast to the input types.

    Nanoseconds need `spark.sql.legacy.parquet.nanosAsLong` while the rows are read.
    """
    found = dict(column.split(" ", 1) for column in shape_columns(shape))
    fields = [
        T.StructField(n, T.DataType.fromDDL("bigint" if k == NANOSECONDS else k)) for n, k in found.items()
    ]
    rows = scan(spark, [literal_path(p) for p in paths], T.StructType(fields))

    def column(field: T.StructField):
        if field.name not in found:
            return F.lit(None).cast(field.dataType)
        value = F.col(field.name)
        if found[field.name] == NANOSECONDS:
            return nanoseconds_to_timestamp(value)
        return value.try_cast(field.dataType)

    return rows.select(*(column(f).alias(f.name) for f in INPUT), "source_file", "file_time", "row_number")


def shape_columns(shape: str) -> list[str]:
    """The columns of a shape; a comma within brackets belongs to a type."""
    out: list[str] = []
    for part in shape.split(",") if shape else []:
        if out and "(" in out[-1] and ")" not in out[-1]:
            out[-1] += "," + part
        else:
            out.append(part)
    return out


def scan_mixed(spark: SparkSession, shapes: dict[str, list[str]]) -> DataFrame:
    """Files of several shapes, each read with its own types; one scan a shape."""
    return reduce(DataFrame.unionByName, (scan_shape(spark, p, s) for s, p in sorted(shapes.items())))
