"""First, last and duplicate rows of a group, without gathering the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A hot group is cut into pieces of this many consecutive positions, so that
# no task ever holds more of one group.
PIECE_BITS = 20


def piece_of(position: Column) -> Column:
    return F.shiftright(position.cast("long"), PIECE_BITS)


def last_per_key(rows: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """The values of the row with the highest `order` per key.

    `max_by` over plain columns is a hash aggregate with map-side combine: a
    key that holds a third of all rows leaves each map task as one row.
    """
    return rows.groupBy(*key).agg(*[F.max_by(v, order).alias(v) for v in values])


def first_per_key(rows: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    return rows.groupBy(*key).agg(*[F.min_by(v, order).alias(v) for v in values])


def distinct_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key).distinct()


def possible_repeats(rows: DataFrame, content: list[str]) -> DataFrame:
    """64-bit digests of `content` that occur more than once.

    The first, cheap pass over a large table: nine bytes per row are shuffled
    instead of paths and hashes. Different contents may share a digest, so this
    only narrows down what `repeated_pieces` then decides.
    """
    return (
        rows.groupBy(F.xxhash64(*content).alias("_digest"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1")
        .select("_digest")
    )


def with_digest_in(rows: DataFrame, digests: DataFrame, content: list[str]) -> DataFrame:
    """The rows whose digest is listed; a skewed digest is split by the adaptive join."""
    return rows.withColumn("_digest", F.xxhash64(*content)).join(digests, "_digest", "left_semi").drop("_digest")


def repeated_pieces(rows: DataFrame, group: list[str], position: str) -> DataFrame:
    """The pieces that hold a repeat, with the first position of their group.

    Rows are counted per piece first, with map-side combine. The window then
    sees a group as one row per piece: a group of a billion rows as a thousand.
    """
    pieces = rows.groupBy(*group, piece_of(F.col(position)).alias("_piece")).agg(
        F.min(position).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    in_group = Window.partitionBy(*group)
    first = F.min("_first").over(in_group)
    only_first = (F.col("_rows") == 1) & (F.col("_first") == F.col("first_position"))
    return (
        pieces.withColumn("first_position", first)
        .filter(~only_first)
        .select(*group, "_piece", "first_position")
    )


def mark_repeats(rows: DataFrame, pieces: DataFrame, group: list[str], position: str) -> DataFrame:
    """Adds `is_repeat`: true for every row of a group but its first.

    The join key includes the piece, which bounds the rows per join key.
    """
    return (
        rows.withColumn("_piece", piece_of(F.col(position)))
        .join(pieces, [*group, "_piece"], "left")
        .withColumn("is_repeat", F.coalesce(F.col(position) > F.col("first_position"), F.lit(False)))
        .drop("_piece", "first_position")
    )
