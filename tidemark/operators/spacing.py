"""Rows at least some time apart: the first one, then always the next that is far enough.

Which rows stay depends on all rows before, but a stretch of time needs to know one
thing of them only: the last row kept. Time is cut into blocks. Every row of a block
has a successor, the first row far enough behind it, and successors of successors by
doubling jumps; so a block says, for each row it may start with, with which one it
ends. Rows that may start it lie in its first interval, and neighbours with one end
are one entry.

A block with too many times is cut into slices as well: a slice holds the same part of
every interval, as the last and the next row kept lie at about the same place of their
intervals. A way through a slice ends where the slice has no row left in an interval;
the next slice goes on there, with its first row in that interval. So ways begin in the
first interval or at the first row of a slice in another one.

The entries of all blocks are small and are followed in the order of time. Each slice then
tells the times that stay, and only these are joined with the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 12  # intervals of a block
TIMES = 1 << 20  # times of a slice, about
CELLS = 1 << 12  # parts of an interval that slices are made of


def successors(at: np.ndarray, gap: int) -> np.ndarray:
    """Per position of an ascending column the first one `gap` or more behind it; its length if there is none."""
    return np.searchsorted(at, at + gap)


def ends(following: np.ndarray) -> np.ndarray:
    """The last position on the way from each one, by jumps that double."""
    n = len(following)
    jump = np.append(following, n)
    last = np.arange(n + 1)
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[np.minimum(jump, n)], last)
        jump = jump[np.minimum(jump, n)]
    return last[:n]


def _inside(at: np.ndarray, gap: int, start: int, sliced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of a block's ascending times, and successors as far as they are found in the slice."""
    place, following = (at - start) // gap, successors(at, gap)
    if sliced:
        # Behind the next interval other slices come first.
        near = np.append(place, -1)[following] == place + 1
        following = np.where(near, following, len(at))
    return place, following


def _entries(gap: int) -> Callable:
    def run(key: tuple, times: pa.Table) -> pa.Table:
        _, block, sliced, _ = (k.as_py() for k in key)
        at = np.sort(times["at"].to_numpy())
        start = block * gap * BLOCK
        place, following = _inside(at, gap, start, sliced)
        if sliced:
            first = np.flatnonzero((place == 0) | np.append(True, np.diff(place) > 0))
        else:
            first = np.arange(min(len(at), int(np.searchsorted(at, start + gap)) + 1))
        last = ends(following)[first]
        keep = np.append(np.diff(last) != 0, True)
        if sliced:
            keep |= np.append(np.diff(place[first]) != 0, True)
        columns = [pa.array([k.as_py()] * int(keep.sum()), k.type) for k in key]
        low = np.full(int(keep.sum()), ((at - start) % gap).min())
        return pa.Table.from_arrays(
            [*columns, pa.array(low), pa.array(at[first[keep]]), pa.array(at[last[keep]])], [*GROUP, "low", "upto", "last"]
        )

    return run


def _starts(gap: int) -> Callable:
    """Per slice on the way the earliest times that may stay, one for each visit."""

    def run(key: tuple, entries: pa.Table) -> pa.Table:
        order = np.lexsort([entries[c].to_numpy() for c in ("upto", "slice", "block")])
        blocks, slices, low, upto, last = (entries[c].to_numpy()[order] for c in ("block", "slice", "low", "upto", "last"))
        sliced = entries["sliced"].to_numpy(zero_copy_only=False)[order]
        new = (np.diff(blocks) != 0) | (np.diff(slices) != 0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(blocks)]]).tolist()
        by_block: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            by_block.setdefault(int(blocks[a]), []).append((a, b))
        out: list[tuple[int, bool, int, int]] = []
        earliest = np.iinfo(np.int64).min
        for block, groups in by_block.items():
            start = block * gap * BLOCK
            end = start + gap * BLOCK
            earliest = max(earliest, start)
            lows = [int(low[a]) for a, _ in groups]
            while earliest < end:
                interval, place = divmod(earliest - start, gap)
                number = max(bisect_right(lows, place) - 1, 0)
                a, b = groups[number]
                found = a + int(np.searchsorted(upto[a:b], earliest))
                cut = bool(sliced[a])
                if found < b and (not cut or upto[found] < start + (interval + 1) * gap):
                    out.append((block, cut, int(slices[a]), earliest))
                    earliest = int(last[found]) + gap
                    if earliest >= end:
                        break
                    interval = (earliest - start) // gap
                if not cut:
                    earliest = end
                    break
                # This slice has no more rows in the interval.
                earliest = start + interval * gap + (lows[number + 1] if number + 1 < len(lows) else gap)
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        run_column = pa.array([key[0].as_py()] * len(out), key[0].type)
        return pa.Table.from_arrays([run_column, *arrays], [*GROUP, "earliest"])

    return run


def _kept(gap: int) -> Callable:
    def run(key: tuple, times: pa.Table, starts: pa.Table) -> pa.Table:
        at, keep = np.sort(times["at"].to_numpy()), []
        if len(starts):
            _, following = _inside(at, gap, key[1].as_py() * gap * BLOCK, key[2].as_py())
            for earliest in starts["earliest"].to_pylist():
                place = int(np.searchsorted(at, earliest))
                while place < len(at):
                    keep.append(place)
                    place = int(following[place])
        run_column = pa.array([key[0].as_py()] * len(keep), key[0].type)
        return pa.Table.from_arrays([run_column, pa.array(at[np.array(keep, np.int64)])], ["run", "at"])

    return run


GROUP = ["run", "block", "sliced", "slice"]


def slices(times: DataFrame, gap: int) -> DataFrame:
    """Adds block and slice to distinct (run, at). A slice has about TIMES times: cells are added until then."""
    width = gap * BLOCK
    placed = times.withColumns(
        {
            "block": F.expr(f"(at - pmod(at, {width}L)) div {width}L"),
            "cell": F.expr(f"pmod(at, {gap}L) * {CELLS}L div {gap}L"),
        }
    )
    counts = placed.groupBy("run", "block", "cell").agg(F.count(F.lit(1)).alias("n"))
    of_block = Window.partitionBy("run", "block")
    before = F.sum("n").over(of_block.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = counts.select(
        F.col("run").alias("_run"),
        F.col("block").alias("_block"),
        F.col("cell").alias("_cell"),
        F.expr(f"{TIMES}L").alias("_times"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("n").over(of_block).alias("_total"),
    ).where("_total > _times")
    same = F.col("run").eqNullSafe(F.col("_run")) & (F.col("block") == F.col("_block")) & (F.col("cell") == F.col("_cell"))
    return placed.join(cells, same, "left").select(
        "run",
        "block",
        F.col("_total").isNotNull().alias("sliced"),
        F.coalesce(F.expr("_before div _times"), F.lit(0).cast("long")).alias("slice"),
        "at",
    )


def spaced(rows: DataFrame, ts: str, seconds: float, tie: str, run: str | None = None) -> DataFrame:
    """The first row of a run and every next one `seconds` or more after the last one kept.

    Of rows at one time the one with the smallest `tie` counts. Rows without a time are
    left out. A task holds the times of one slice, and no rows.
    """
    gap = round(seconds * 1_000_000)
    held = rows.select(
        F.struct(*rows.columns).alias("row"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(tie).alias("tie"),
        (F.col(run) if run else F.lit(0)).alias("run"),
    ).where("at is not null")
    kind = held.schema["run"].dataType.simpleString()
    group = f"run {kind}, block long, sliced boolean, slice long"
    times = slices(held.select("run", "at").distinct(), gap)
    entries = times.groupBy(*GROUP).applyInArrow(_entries(gap), f"{group}, low long, upto long, last long")
    starts = entries.groupBy("run").applyInArrow(_starts(gap), f"{group}, earliest long")
    kept = times.groupBy(*GROUP).cogroup(starts.groupBy(*GROUP)).applyInArrow(_kept(gap), f"run {kind}, at long")
    kept = kept.select(F.col("run").alias("_run"), F.col("at").alias("_at"))
    stay = held.join(kept, F.col("run").eqNullSafe(F.col("_run")) & (F.col("at") == F.col("_at")), "left_semi")
    one = stay.groupBy("run", "at").agg(F.min_by("row", F.struct(F.col("tie").isNull(), "tie")).alias("row"))
    return one.select("row.*")
