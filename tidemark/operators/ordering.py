"""Global order without a global sort: positions, running sums, batches, samples.

Everything works in two levels. Rows are cut into ranges of the order column,
ranges are summed up (small), and inside a range a window does the rest. The
order column is a LONG without repeats, so a range holds at most `width` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import HASH_BITS, Hash, fast_hash
from tidemark.functions.numbers import batch_number, int_div

WIDTH = 1 << 20
SAMPLE_BITS = 16


def running_sums(
    rows: DataFrame,
    order: str,
    sums: dict[str, Column],
    within: list[str] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Adds inclusive running sums in the order of `order`, per `within`.

    The window runs first; its sort order then serves the join with the range
    offsets, so the rows are shuffled and sorted once.
    """
    within = within or []
    cut = rows.withColumn("_range", int_div(F.col(order), width))
    totals = cut.groupBy(*within, "_range").agg(
        *[F.sum(c).alias(f"_total_{name}") for name, c in sums.items()]
    )
    earlier = (
        Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *within,
        "_range",
        *[
            F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in sums
        ],
    )
    inside = (
        Window.partitionBy(*within, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = cut.withColumns({f"_local_{name}": F.sum(c).over(inside) for name, c in sums.items()})
    joined = local.join(offsets, [*within, "_range"])
    return joined.select(
        *rows.columns,
        *[(F.col(f"_before_{name}") + F.col(f"_local_{name}")).alias(name) for name in sums],
    )


def with_position(rows: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """Adds the 1-based `position` in the order of `order`."""
    return running_sums(rows, order, {"position": F.lit(1).cast("long")}, width=width)


def with_batches(rows: DataFrame, order: str, batch_size: int, width: int = WIDTH) -> DataFrame:
    """Adds the 1-based `batch`: exactly `batch_size` rows each, the last may hold less."""
    return with_position(rows, order, width).withColumn(
        "batch", batch_number(F.col("position"), batch_size)
    )


def first_rows(rows: DataFrame, order: str, count: int) -> DataFrame:
    """The first `count` rows of an order; `count` is one batch, so a top-k."""
    return rows.orderBy(order).limit(count)


def nth_value(rows: DataFrame, order: str, n: int, width: int = WIDTH) -> DataFrame:
    """The `n`-th smallest value of the order column as one row; none if there are fewer rows.

    Rows are counted per range; only the values of the one range with the n-th are
    ordered, at most `width` of them.
    """
    cut = rows.select(F.col(order).alias("_order"), int_div(F.col(order), width).alias("_range"))
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.withColumn("_left", F.lit(n) - F.coalesce(F.sum("_rows").over(before), F.lit(0))).filter(
        "_left > 0 and _left <= _rows"
    )
    inside = cut.join(F.broadcast(edge.select("_range", "_left")), "_range")
    ranked = inside.withColumn("_rank", F.row_number().over(Window.orderBy("_order")))
    return ranked.filter("_rank = _left").select(F.col("_order").alias(order))


def sample_rows(
    rows: DataFrame, key: list[str], count: int | Column, seed: int = 0, hashed: Hash = fast_hash
) -> DataFrame:
    """Exactly `count` rows in hash order of a unique key (all, if there are fewer).

    The last row to keep is looked up among the keys, and one filter over the rows
    follows: nothing is joined or shuffled but keys. The look-up cuts the hashes into
    65,536 even ranges, then the one in which the limit falls into 65,536 again; only
    what shares 32 bits with the limit is ordered.
    """
    place = F.struct(F.expr(hashed(*key, seed=seed)).alias("_hash"), *key)
    count = count if isinstance(count, Column) else F.lit(count)
    last = _row_at(rows.select(place.alias("_place")), count).scalar()
    return rows.filter(F.coalesce(place <= last, count > 0))


def _row_at(places: DataFrame, count: Column) -> DataFrame:
    """The place with exactly `count` places up to it, as one row; none if there are fewer."""
    for level in (1, 2):
        ranged = places.withColumn("_range", F.shiftright("_place._hash", HASH_BITS - level * SAMPLE_BITS))
        if level == 1:
            counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_left", count)
        else:
            counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.first("_left").alias("_left"))
        # At most 2^16 ranges of three numbers.
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        edge = counts.withColumn("_left", F.col("_left") - F.coalesce(F.sum("_rows").over(before), F.lit(0))).filter(
            "_left > 0 and _left <= _rows"
        )
        places = ranged.drop("_left").join(F.broadcast(edge.select("_range", "_left")), "_range").drop("_range")
    in_order = Window.orderBy("_place")
    return places.withColumn("_rank", F.row_number().over(in_order)).filter("_rank = _left").select("_place")


def hash_order(rows: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """The rows shuffled: range-partitioned and sorted by a hash of the key.

    Use right before a write; the order lives in the files only.
    """
    return rows.orderBy(F.expr(fast_hash(*key, seed=seed)), *key)
