"""What the corpus operators share: stored tables, row keys and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tidemark.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str, **options: str) -> DataFrame:
    """The frame written below the shared folder, with the writer's options, and read again.

    Later reads start from the files, so a lost executor costs no recomputation
    of what came before, and all readers see the same rows.
    """
    path = scratch_dir(frame.sparkSession, label)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def type_of(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def text_key(text: str | Column) -> Column:
    """Tells rows of one id apart by their text. Rows equal in both are equal rows."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def packed(frame: DataFrame, made: list[str], **columns: str | Column) -> DataFrame:
    """`row`, a struct of the frame's columns but those the operator makes, and the named columns.

    In this form no column of the input can clash with one of the operator's.
    """
    made = {c.lower() for c in made}
    kept = [F.col(f"`{c}`") for c in frame.columns if c.lower() not in made]
    return frame.select(
        F.struct(*kept).alias("row"),
        *((F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()),
    )


def schema_with(fields: StructType, **made: str) -> StructType:
    return StructType([*fields.fields, *(StructField(n, _parse(t)) for n, t in made.items())])


def _parse(kind: str) -> DataType:
    return DataType.fromDDL(kind)


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality in all columns, null equal to null."""
    test = F.lit(True)
    for c in columns:
        test = test & left[c].eqNullSafe(right[c])
    return test


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `size` bytes of a text column, so that a worker holds few texts as objects."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cells = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of one task that are needed to keep its components.

    Every batch is joined with the forest of the batches before it, which has
    fewer links than the task has nodes.
    """
    kept: list[pa.RecordBatch] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter((x for x in parent if root(x) != x), np.int64)
    if len(nodes):
        tops = np.fromiter((root(x) for x in nodes.tolist()), np.int64, len(nodes))
        kept.append(pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tops)], ["u", "v"]))
    yield from kept


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): every linked node and the smallest node it reaches.

    `links` has two long columns. Alternating large and small stars; each round
    is a minimum per node (combined before the shuffle) and a join. Each task first
    cuts its links to a spanning forest, but the join sends what is left of a node
    with very many links to one task. Rounds grow with the logarithm of the longest
    chain. Nodes without links are not returned.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    links = stored(links.mapInArrow(spanning_forest, "u long, v long"), "links")
    state = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u"), F.col("m").alias("v")),
                )
            ).alias("x")
        )
        new = stored(small.select("x.u", "x.v").where("u != v").distinct(), "links")
        after = _fingerprint(new)
        if after == state:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        links, state = new, after


def _fingerprint(links: DataFrame) -> tuple:
    """Equal for equal sets of links; distinct links are counted once each."""
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)
