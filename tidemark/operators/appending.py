"""Append once: what is already there, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.dedup import piece_of
from tidemark.schemas import POSITION_KEY

# The ledger of landed files is kept in this many buckets.
BUCKETS = 64


def not_yet_present(new: DataFrame, existing: DataFrame, key: list[str] = POSITION_KEY) -> DataFrame:
    """Rows whose key is not in `existing` (conflict: do nothing).

    Only the key of `existing` is read. The position key is unique per row, so
    rows of one large file spread evenly over the shuffle.
    """
    return new.join(existing.select(*key), key, "left_anti")


def plain_path(column: str) -> Column:
    """A local path in one spelling."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def bucket_of(column: str) -> Column:
    """The ledger's bucket of a file name."""
    return F.pmod(F.xxhash64(plain_path(column)), F.lit(BUCKETS)).cast("int")


def file_lengths(rows: DataFrame) -> DataFrame:
    """Per file its rows and bucket; counting reads no data column."""
    return rows.groupBy("source_file", "file_time").agg((F.max("row_number") + 1).alias("file_rows")).withColumn(
        "bucket", bucket_of("source_file")
    )


def manifest(files: DataFrame, ledger: DataFrame, next_seq: int = 0) -> DataFrame:
    """Per file: its first row that the ledger does not have, and where its `seq` starts.

    `ledger` may hold just the buckets of the files. The window orders the file list
    of one run, which the driver has listed already, by file time and path.
    """
    landed_before = ledger.groupBy("source_file").agg(F.max("file_rows").alias("_seen"))
    in_order = Window.orderBy("file_time", "source_file").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(landed_before, "source_file", "left").select(
        "source_file",
        "file_time",
        "file_rows",
        F.coalesce("_seen", F.lit(0)).alias("first_new"),
        (F.lit(next_seq) + F.coalesce(F.sum("file_rows").over(in_order), F.lit(0))).alias("file_start"),
        "bucket",
    )


def unfinished(rows: DataFrame, files: DataFrame, small: bool) -> DataFrame:
    """All rows of files that have rows to land, with their `seq` and `first_new`.

    A `small` manifest is broadcast. A long one is joined by file and piece of the
    file, so that one huge file does not end up in one task.
    """
    columns = files.filter("first_new < file_rows").select("source_file", "file_rows", "first_new", "file_start")
    if small:
        joined = rows.join(F.broadcast(columns), "source_file")
    else:
        pieces = columns.withColumn(
            "_piece", F.explode(F.sequence(F.lit(0).cast("long"), piece_of(F.col("file_rows"))))
        )
        joined = (
            rows.withColumn("_piece", piece_of(F.col("row_number"))).join(pieces, ["source_file", "_piece"]).drop("_piece")
        )
    return joined.withColumn("seq", F.col("file_start") + F.col("row_number")).drop("file_rows", "file_start")


def not_landed(rows: DataFrame) -> DataFrame:
    """Of `unfinished` rows those from `first_new` on."""
    return rows.filter(F.col("row_number") >= F.col("first_new")).drop("first_new")


def high_water_marks(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Per file the highest staged row number, -1 if none is staged."""
    marks = staged.groupBy("source_file").agg(F.max("row_number").alias("_mark"))
    return files.join(marks, "source_file", "left").select(
        *files.columns, F.coalesce("_mark", F.lit(-1).cast("long")).alias("last_row")
    )


def still_staged(staged: DataFrame, consumed_batches: DataFrame) -> DataFrame:
    """Staged rows of batches that no merge has consumed."""
    return staged.join(consumed_batches.select("ingest_batch").distinct(), "ingest_batch", "left_anti")


def file_states(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Per file: `done` after a success, `dead` after `max_attempts` failures,
    otherwise `retry`. `attempts` has `source_file` and `ok`."""
    counted = attempts.groupBy("source_file").agg(
        F.count_if(~F.col("ok")).alias("failures"), F.count_if("ok").alias("successes")
    )
    return counted.select(
        "source_file",
        "failures",
        F.when(F.col("successes") > 0, F.lit("done"))
        .when(F.col("failures") >= max_attempts, F.lit("dead"))
        .otherwise(F.lit("retry"))
        .alias("status"),
    )


def files_to_try(files: DataFrame, states: DataFrame) -> DataFrame:
    """Listed files that are neither done nor given up."""
    closed = states.filter(F.col("status").isin("done", "dead")).select("source_file")
    return files.join(closed, "source_file", "left_anti")
