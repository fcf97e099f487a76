"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is its share of the target over its size. Every
row draws a uniform number from a hash of a seed and its id and text, and the
inverse of the Poisson distribution turns it into a count with the rate as its
mean: no state, the same counts in every run. Copies are exploded and put in a
global random order, which is again a hash. As that order is uniform, its ranges
are known beforehand: rows go straight to their range, without a sampling pass,
and are sorted there.

Sizes per source are combined before the shuffle. The rates have one row per
source and are joined (Spark broadcasts them if they are small, and splits a hot
source if not).

Defined cases: a null source is a source of its own; a source without a weight,
or with weight null, zero or less, gets no rows; a source of size zero gets no
rows either, as no repetition reaches its target; null text has size zero; equal
rows draw equal numbers, so their copies are numbered on: `copy` counts within a
row. Empty tables and a total weight of zero give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, stored

DIGITS = 13  # hexadecimal digits of a hash that make one exact double


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of the parts; null parts count as an empty text."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(
        float(16**DIGITS)
    )


def distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... up to where only rounding is left.

    Rates above 700 would underflow at k = 0; they are split into equal parts in
    `repetitions`.
    """
    top = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), F.array(zero).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(
            p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums")
        )

    return F.aggregate(F.sequence(F.lit(1), top), start, step)["sums"]


def source_rates(
    documents: DataFrame, weights: DataFrame, total: float | None = None, source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(source, size, rate): bytes of each source and how often its rows are to be repeated.

    `weights` has (source, weight). `total` is the size of the mixture in bytes,
    by default that of the corpus.
    """
    sizes = documents.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("size")
    )
    weights = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"))
    joined = sizes.join(
        weights.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source")), "left"
    ).drop("w_source")
    sums = joined.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    goal = F.col("all_size").cast("double") if total is None else F.lit(float(total))
    # One row of totals: a bounded broadcast.
    return joined.join(F.broadcast(sums)).select(
        "source",
        "size",
        F.when(
            (F.col("size") > 0) & F.col("weight").isNotNull(),
            goal * F.col("weight") / F.col("all_weight") / F.col("size"),
        )
        .otherwise(0.0)
        .alias("rate"),
    )


def mix(
    documents: DataFrame,
    weights: DataFrame,
    total: float | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """The documents' columns, `copy` (1, 2, ... within a row) and `shuffle_key`, in the order of `shuffle_key`."""
    spark = documents.sparkSession
    rates = source_rates(documents, weights, total, source_col, text_col).where("rate > 0")
    parts = F.greatest(F.ceil(F.col("rate") / 500), F.lit(1)).cast("int")
    rates = stored(
        rates.select(F.col("source").alias("of"), parts.alias("parts"), distribution(F.col("rate") / parts).alias("sums")),
        "rates",
    )
    rows = packed(documents, ["copy", "shuffle_key"], id=id_col, source=source_col)
    text = F.col("row")[text_col]

    def one(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("id"), text, part)
        return F.size(F.filter("sums", lambda s: s <= u))

    count = F.when(F.col("parts") == 1, one(F.lit(1))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, part: a + one(part))
    )
    copies = (
        rows.join(rates, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("n", count)
        .where("n > 0")
        .select("row", "id", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    )
    keyed = copies.withColumn("shuffle_key", uniform(F.lit(f"order {seed}"), F.col("id"), text, F.col("copy")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        keyed.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int"))
        .sortWithinPartitions("shuffle_key", "id", "copy")
        .select("row.*", "copy", "shuffle_key")
    )


def poisson_count(rate: float, u: float) -> int:
    """The inverse the operator uses, for one number; for rates up to 500."""
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < math.ceil(rate + 12 * math.sqrt(rate) + 24) + 1:
        k += 1
        p = p * rate / k
        total += p
    return k
