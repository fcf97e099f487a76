"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= c of unit vectors is a distance of at most eps = sqrt(2 - 2c). Unit
vectors are projected on their leading principal dimensions and sorted by grid
cells of that width. The sorted sequence is cut into intervals of `TILE` rows,
intervals of intervals and so on, each with its bounding box. The join starts
from the whole sequence with itself and descends into pairs of intervals whose
boxes come within eps; everything else is provably distant and skipped. Pairs of
tiles that are left are joined block by block: a block pair is skipped if its
boxes are too far apart, counted without a product if its balls are so close
that every pair links, and multiplied otherwise. Products are made in single
precision and every pair within the error of it is decided in double precision.

No pair leaves a task: a tile pair yields a number of links per vector and a
spanning forest of them. Equal vectors are one class with a weight, so copies
are never compared.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite
component have no links; vectors of different length have none with each other;
a row without links is its own component; rows are counted each, also if they
repeat an id; null ids never name a component, and a row with a null id is kept
only if nothing it reaches has an id; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, packed, spanning_forest, stored

LEADING = 8  # principal dimensions of the grid and the boxes
BLOCK, TILE = 256, 4096
DIGIT = 6  # an interval has 2^DIGIT parts
SEQUENCE_BITS = 18  # of a tile's number: its place within a partition
ERROR = 1e-5  # of a product in single precision, with room


def _arrays(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Leading axes (length x LEADING) of the unit vectors of the most frequent length, about zero.

    Sums of products are made per task and combined by Spark; length^2 numbers
    reach the driver. They only steer the order, never the result.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                units = _units(_arrays(batch.column(0)))
                total += units.T @ units
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    found = (
        vectors.where(F.size("v") == width).select("v").mapInArrow(sums, "i int, j int, s double")
        .groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    )
    matrix = np.zeros((width, width))
    matrix[found["i"].to_numpy(), found["j"].to_numpy()] = found["s"].to_numpy()
    return np.linalg.eigh(matrix)[1][:, ::-1][:, :LEADING].copy()


def _place(axes: np.ndarray, eps: float):
    """Adds the cells of the leading dimensions; other lengths share one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            cells = np.zeros((batch.num_rows, LEADING), np.int32)
            fit = np.flatnonzero(lengths == len(axes))
            if len(fit):
                near = _units(_arrays(batch.column(2).take(pa.array(fit)))) @ axes
                cells[fit, : near.shape[1]] = np.floor(near / eps)
            offsets = pa.array(np.arange(0, cells.size + 1, LEADING, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))],
                ["node", "weight", "v", "length", "cells"],
            )

    return run


def _boxes(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    if units.shape[1] != len(axes):
        return np.zeros((len(units), axes.shape[1]))
    return units @ axes


def _tiles(axes: np.ndarray):
    """Cuts the sorted rows of a task into tiles of one vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def tile(rows: pa.Table, length: int) -> pa.RecordBatch:
            nonlocal number
            rows = rows.combine_chunks()
            raw = _arrays(rows["v"].chunk(0))
            near = _boxes(_units(raw), axes)
            code = (part << SEQUENCE_BITS) + number
            number += 1
            # Vectors of different length are kept apart by one more dimension.
            low = [10.0 * length, *(near.min(0) - 1e-9)]
            high = [10.0 * length, *(near.max(0) + 1e-9)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([code], pa.int64()),
                    pa.array([length], pa.int32()),
                    pa.array([low], pa.list_(pa.float64())),
                    pa.array([high], pa.list_(pa.float64())),
                    pa.array([rows["node"].to_numpy().tobytes()], pa.binary()),
                    pa.array([rows["weight"].to_numpy().tobytes()], pa.binary()),
                    pa.array([raw.tobytes()], pa.binary()),
                ],
                ["tile", "length", "low", "high", "nodes", "weights", "data"],
            )

        held: list[pa.RecordBatch] = []
        size = length = 0
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            at = 0
            while at < batch.num_rows:
                if size and (lengths[at] != length or size == TILE):
                    yield tile(pa.Table.from_batches(held), length)
                    held, size = [], 0
                length = int(lengths[at])
                other = np.flatnonzero(lengths[at:] != length)
                take = min(TILE - size, int(other[0]) if len(other) else batch.num_rows - at)
                held.append(batch.slice(at, take))
                size, at = size + take, at + take
        if size:
            yield tile(pa.Table.from_batches(held), length)

    return run


def _gap(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Squared distance between two boxes."""
    apart = F.zip_with(
        F.zip_with(low_a, high_b, lambda x, y: x - y),
        F.zip_with(low_b, high_a, lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)


def near_tiles(tiles: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles that are not provably distant."""
    boxes = stored(tiles.select("tile", "low", "high"), "tile-boxes")
    top = boxes.agg(F.max("tile")).first()[0]
    depth = 0
    while top is not None and top >> (depth * DIGIT):
        depth += 1
    start = boxes.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(1)
    pairs = start
    for level in range(depth - 1, -1, -1):
        shift = level * DIGIT
        grouped = boxes.groupBy(F.shiftright("tile", shift).alias("n")).agg(
            *(F.min(F.col("low")[i]).alias(f"l{i}") for i in range(LEADING + 1)),
            *(F.max(F.col("high")[i]).alias(f"h{i}") for i in range(LEADING + 1)),
        )
        # Vectors shorter than LEADING leave places empty.
        low = F.array(*(F.coalesce(F.col(f"l{i}"), F.lit(0.0)) for i in range(LEADING + 1)))
        high = F.array(*(F.coalesce(F.col(f"h{i}"), F.lit(0.0)) for i in range(LEADING + 1)))
        nodes = grouped.select("n", F.shiftright("n", DIGIT).alias("up"), low.alias("low"), high.alias("high"))
        one = nodes.select(F.col("n").alias("x"), F.col("up").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
        two = nodes.select(F.col("n").alias("y"), F.col("up").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        pairs = (
            pairs.join(one, "a").join(two, "b").where("x <= y").where(_gap("la", "ha", "lb", "hb") <= eps * eps)
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
    return pairs


class _Side:
    def __init__(self, row: dict, axes: np.ndarray):
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.weights = np.frombuffer(row["weights"], np.int64)
        self.units = _units(np.frombuffer(row["data"], np.float64).reshape(-1, row["length"]))
        self.single = self.units.astype(np.float32)
        near = _boxes(self.units, axes)
        self.cuts = [slice(i, min(i + BLOCK, len(self.nodes))) for i in range(0, len(self.nodes), BLOCK)]
        self.low = np.array([near[c].min(0) for c in self.cuts]) - 1e-9
        self.high = np.array([near[c].max(0) for c in self.cuts]) + 1e-9
        self.centres = np.array([self.units[c].mean(0) for c in self.cuts])
        self.radii = np.array(
            [np.linalg.norm(self.units[c] - m, axis=1).max() for c, m in zip(self.cuts, self.centres, strict=True)]
        )
        self.links = np.zeros(len(self.nodes), np.int64)


def _join_tiles(axes: np.ndarray, cosine: float):
    eps = float(np.sqrt(2 - 2 * cosine))

    def block(a: _Side, b: _Side, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = a.cuts[i], b.cuts[j]
        own = a is b and i == j
        if np.linalg.norm(a.centres[i] - b.centres[j]) + a.radii[i] + b.radii[j] < eps - 1e-7:
            a.links[x] += b.weights[y].sum() - (b.weights[y] if own else 0)
            if not own:
                b.links[y] += a.weights[x].sum()
            nodes = np.concatenate([a.nodes[x], b.nodes[y]])
            yield nodes, np.full(len(nodes), nodes.min())
            return
        near = a.single[x] @ b.single[y].T
        linked = near >= np.float32(cosine + ERROR)
        unsure = np.argwhere(~linked & (near > np.float32(cosine - ERROR)))
        if len(unsure):
            exact = np.einsum("ij,ij->i", a.units[x][unsure[:, 0]], b.units[y][unsure[:, 1]])
            linked[tuple(unsure[exact >= cosine].T)] = True
        if own:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        a.links[x] += linked @ b.weights[y]
        if not own:
            b.links[y] += linked.T @ a.weights[x]
        # Each round halves the way to the smallest label at the least; one label per component.
        left, right = a.nodes[x].copy(), b.nodes[y].copy()
        rows, columns = np.nonzero(linked)
        while True:
            before = left.copy(), right.copy()
            np.minimum.at(left, rows, right[columns])
            np.minimum.at(right, columns, left[rows])
            if np.array_equal(before[0], left) and np.array_equal(before[1], right):
                break
        yield np.concatenate([a.nodes[x], b.nodes[y]]), np.concatenate([left, right])

    def run(group: pa.Table) -> pa.Table:
        sides = [_Side(row, axes) for row in sorted(group.to_pylist(), key=lambda r: r["side"])]
        a, b = sides[0], sides[-1]
        found = []
        for i in range(len(a.cuts)):
            apart = np.maximum(0, np.maximum(a.low[i] - b.high, b.low - a.high[i]))
            for j in np.flatnonzero((apart**2).sum(1) <= eps * eps + 1e-9).tolist():
                if a is not b or i <= j:
                    found += [pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) for u, v in block(a, b, i, j)]
        nodes = np.concatenate([s.nodes[s.links > 0] for s in dict.fromkeys(sides)])
        counts = np.concatenate([s.links[s.links > 0] for s in dict.fromkeys(sides)])
        links = [(r.column(0).to_numpy(), r.column(1).to_numpy()) for r in spanning_forest(iter(found))]
        nothing = np.zeros(0, np.int64)
        u, v = links[0] if links else (nothing, nothing)
        return pa.table(
            {
                "node": np.concatenate([nodes, u]),
                "n": pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(len(u), pa.int64())]),
                "other": pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(v, pa.int64())]),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The columns of `vectors`, n_links, component_id and kept.

    `n_links` counts the other rows with a cosine of `cosine` or more,
    `component_id` is the smallest id reachable by links, the row's included.
    """
    made = ["n_links", "component_id", "kept"]
    value = F.col(f"`{vector_col}`")
    rows = packed(vectors, made, id=id_col, v=value.cast("array<double>"))
    fine = (
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    # Adding zero makes -0.0 and 0.0 the same.
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    classes = stored(
        rows.where("v is not null").groupBy("v").agg(F.count("*").alias("weight"), F.min("id").alias("least")), "vector-classes"
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    widths = classes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = principal_axes(classes, widths[0].w) if widths else np.zeros((1, 1))
    placed = classes.select("node", "weight", "v").mapInArrow(
        _place(axes, eps), "node long, weight long, v array<double>, length int, cells array<int>"
    )
    tiles = stored(
        placed.repartitionByRange("length", "cells").sortWithinPartitions("length", "cells").mapInArrow(
            _tiles(axes),
            "tile long, length int, low array<double>, high array<double>, nodes binary, weights binary, data binary",
        ),
        "vector-tiles",
    )
    pairs = stored(near_tiles(tiles, eps), "tile-pairs")
    data = tiles.select("tile", "length", "nodes", "weights", "data")
    first = pairs.join(data, pairs["a"] == data["tile"]).withColumn("side", F.lit(0))
    second = pairs.where("a < b").join(data, F.col("b") == data["tile"]).withColumn("side", F.lit(1))
    found = stored(
        first.unionByName(second).groupBy("a", "b").applyInArrow(_join_tiles(axes, cosine), "node long, n long, other long"),
        "vector-links",
    )
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("other is not null").select("node", "other"))
    named = (
        labels.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    )
    labels = labels.join(named, "component").select("node", "smallest")
    full = (
        classes.join(counts, "node", "left").join(labels, "node", "left")
        .select(
            F.col("v").alias("of"),
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"),
            F.coalesce("smallest", "least").alias("least"),
        )
    )
    return rows.join(full, rows["v"] == full["of"], "left").select(
        "row.*",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("least", "id"), F.col("least").isNull()).alias("kept"),
    )
