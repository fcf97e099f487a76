"""Line dedup by range-sorted line hashes, with per-document bitmaps as the result.

Lines that are long enough become (hash, id, positions) rows, one per document
and distinct line. They are range-partitioned by hash and id, so a line that a
third of all documents hold is cut over many tasks, and sorted within; a task
then streams its rows and sees the last holder of every line first. A line that
begins inside a task is decided there with a handful of rows in memory. Only the
first line of a task may have begun in an earlier one: its rows, and the short
remainder of the last line, are put aside and decided together. There are at
most two such lines a task, so their table may be broadcast.

Defined cases: a null or empty text is one empty line; rows with one id are one
document for the counts, null being the smallest id; equal rows get equal
bitmaps; no rows give no rows. Columns other than id and text are carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, same, schema_with, stored, text_key, type_of

SPACE = " \t\n\x0b\x0c\r"


def line_hashes(documents: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, text_key, n_lines, positions) per document and long line."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, second, counts, places = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text or len(text) < min_chars:
                    continue
                lines = text.split("\n")
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    line = line.strip(SPACE)
                    if len(line) >= min_chars:
                        digest = hashlib.blake2b(line.encode().lower(), digest_size=16).digest()
                        found.setdefault(digest, []).append(at)
                for digest, positions in found.items():
                    a, b = struct.unpack("<qq", digest)
                    rows.append(i)
                    first.append(a)
                    second.append(b)
                    counts.append(len(lines))
                    places.append(positions)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(counts, pa.int32()),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                ["h1", "h2", "id", "text_key", "n_lines", "positions"],
            )

    return documents.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")
    ).mapInArrow(
        split,
        f"h1 long, h2 long, id {type_of(documents, id_col)}, text_key long, n_lines int, positions array<int>",
    )


def _stream(min_docs: int):
    """Streams sorted rows; see the module text. `kind`: drop, or edge rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = keeper = last = None
        begun, docs, full = False, 0, False
        pending: list[tuple] = []

        def batched(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            names = ["h1", "h2", "id", "text_key", "n_lines", "positions"]
            types = [like.schema.field(n).type for n in names] + [pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*names, "kind"]
            )

        batch = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun:
                    begun, first = True, row[:2]
                if row[:2] == first:
                    out.append((*row, "edge"))
                    continue
                if row[:2] != key:
                    key, keeper, last, docs, full, pending = row[:2], row[2], row[2], 1, min_docs <= 1, []
                elif row[2] != last:
                    last, docs = row[2], docs + 1
                    if docs >= min_docs and not full:
                        full = True
                        out += [(*r, "drop") for r in pending if r[2] != keeper]
                        pending = [pending[0]]
                if not full:
                    pending.append(row)
                elif row[2] != keeper:
                    out.append((*row, "drop"))
            yield batched(out, batch)
        if batch is not None and key is not None:
            rows = [(*r, "full") for r in pending[:1]] if full else [(*r, "edge") for r in pending]
            yield batched(rows, batch)

    return run


def line_bitmaps(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(id, text_key, n_lines, bitmap) of the documents that lose lines.

    A line is compared without white space at its ends and with A-Z in lower
    case. If it has `min_chars` code points or more and `min_docs` documents or
    more hold it, all its lines go but those of the largest id. `bitmap` is the
    zlib form of one bit per line, 1 to keep, most significant bit first.
    """
    lines = line_hashes(documents, id_col, text_col, min_chars)
    kind = type_of(lines, "id")
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last()]
    decided = stored(
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _stream(min_docs),
            f"h1 long, h2 long, id {kind}, text_key long, n_lines int, positions array<int>, kind string",
        ),
        "line-decisions",
    )
    edges = decided.where("kind != 'drop'")
    # Holders are made distinct before they are counted, so no line meets in one task.
    holders = edges.groupBy("h1", "h2", "id").agg(F.max(F.col("kind") == "full").alias("full"))
    shared = (
        holders.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("full").alias("full"), F.max("id").alias("keeper"))
        .where((F.col("n") >= min_docs) | F.col("full"))
        .select("h1", "h2", "keeper")
    )
    late = (
        edges.where("kind = 'edge'")
        .join(F.broadcast(shared), ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
    )
    columns = ["id", "text_key", "n_lines", "positions"]
    dropped = decided.where("kind = 'drop'").select(*columns).unionByName(late.select(*columns))
    per_row = dropped.groupBy("id", "text_key").agg(
        F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("positions")).alias("positions")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[gone] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(maps, pa.binary())], ["id", "text_key", "n_lines", "bitmap"]
            )

    return per_row.mapInArrow(pack, f"id {kind}, text_key long, n_lines int, bitmap binary")


def keep_lines(documents: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `kept_text`, `n_lines` and `n_dropped`."""
    made = ["kept_text", "n_lines", "n_dropped"]
    left = packed(documents, made, id=id_col, text_key=text_key(text_col))
    right = bitmaps.select("id", "text_key", "bitmap")
    joined = left.join(right, same(left, right, ["id", "text_key"]), "left").select("row.*", right["bitmap"].alias("_bitmap"))
    fields = left.schema["row"].dataType
    at, width = fields.names.index(text_col), len(fields.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept, counts, gone = batch.column(at).to_pylist(), [], [], []
            for text, bitmap in zip(texts, batch.column(width).to_pylist(), strict=True):
                n = (text or "").count("\n") + 1
                lost = 0
                if bitmap is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n)
                    lost = n - int(keep.sum())
                    text = "\n".join(line for line, k in zip(text.split("\n"), keep.tolist(), strict=True) if k)
                kept.append(text or "")
                counts.append(n)
                gone.append(lost)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:width],
                    pa.array(kept, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                ],
                [*fields.names, *made],
            )

    return joined.mapInArrow(apply, schema_with(fields, kept_text="string", n_lines="long", n_dropped="long"))
