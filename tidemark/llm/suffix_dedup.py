"""Removal of repeated byte strings by distributed prefix doubling on sampled positions.

A position is sampled if its eight bytes have the smallest hash of some stretch
of `STRETCH` positions; a string of `length` bytes is owned by the sampled
position of its first stretch. Equal strings are owned at equal distance, so
sampled positions stand for all positions at a hundredth of their number.

Ranks are digests: equal strings, equal ranks. A set of strings that one position
owns at distances d, ..., d + w - 1 has a common part of length - w + 1 bytes,
which is what the rank covers. Spark groups the ranks; unique ones leave, since
none of their strings can repeat. The others pair it with the rank at the far
end of their strings: if the pair, all bytes from the first string to the last,
repeats, so do all strings of the set. What is between is cut into narrower sets,
w = 256, 16, 1, so that the ranked length grows to `length` and the last round
leaves no doubt. Of equal pairs one stays in the next round for the sake of
others that share its rank.

Rounds group narrow rows by rank, and counts are combined before the shuffle. What
is grouped is stored before it is joined with, so that Spark can split a hot rank and
the copies of one text. Only texts with surviving positions are read again, from a stored copy. Tasks sample long
texts part by part and rank a bounded number of sets at a time.

Defined cases: null is the empty text; texts shorter than `length` keep all their
bytes; strings do not cross documents; rows with equal texts repeat each other
and get equal answers; no rows give no rows. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, pieces, schema_with, stored

STRETCH = 256  # positions, and the width of the first round
WIDTHS = (STRETCH, 16, 1)
GRAM = 8
CHUNK = 1 << 18  # bytes sampled at a time
ROWS = 1 << 15  # sets ranked at a time


def text_id(text: Column) -> list[Column]:
    """Names a text; two columns, so that clashes need 96 equal bits."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def sampled(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, position, least and greatest distance) of the sampled positions of texts that lie one after another."""
    n = len(data)
    starts = np.concatenate([[0], ends[:-1]])
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    grams = np.empty(n - GRAM + 1, np.uint64)
    for shift in range(GRAM):
        part = np.frombuffer(data, "<u8", (n - shift) // GRAM, shift) if n - shift >= GRAM else np.zeros(0, "<u8")
        grams[shift::GRAM] = part[: len(grams[shift::GRAM])]
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    # Hash above, place below: the smallest is the leftmost of equal hashes.
    grams &= np.uint64(0xFFFFFFFF00000000)
    grams |= np.arange(len(grams), dtype=np.uint64)
    count = len(grams) - STRETCH + 1
    padded = np.full(-(-len(grams) // STRETCH) * STRETCH, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = grams
    rows = padded.reshape(-1, STRETCH)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    owner = (np.minimum(after[:count], before[STRETCH - 1 : STRETCH - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = np.repeat(ends, ends - starts)[:count]
    begins = np.flatnonzero(np.arange(count) + length <= last)
    owner = owner[begins]
    text = np.searchsorted(ends, begins, "right")
    cut = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(text, prepend=-1))
    stop = np.append(cut[1:], len(begins)) - 1
    if not len(begins):
        return (np.zeros(0, np.int64),) * 4
    at = owner[cut]
    return text[cut], at - starts[text[cut]], at - begins[stop], at - begins[cut]


def digest(data: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest())


def _pair(digests: Sequence[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]


def _first_ranks(length: int):
    names = ["k1", "k2", "t1", "t2", "at", "low", "high"]

    def ranks(ids: pa.RecordBatch, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows, begins, texts = zip(*parts, strict=True)
        ends = np.cumsum([len(t) for t in texts])
        data = b"".join(texts)
        text, at, low, high = sampled(data, ends, length)
        place = (at + (ends - [len(t) for t in texts])[text]).tolist() if len(text) else []
        size = length - STRETCH + 1
        keys = [digest(data[p : p + size]) for p in place]
        owner = pa.array(np.array(rows, np.int64)[text])
        at = at + np.array(begins, np.int64)[text]
        return pa.RecordBatch.from_arrays(
            [
                *_pair(keys),
                ids.column(0).take(owner),
                ids.column(1).take(owner),
                *(pa.array(x, pa.int32()) for x in (at, low, high)),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            parts, held = [], 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                text = (text or "").encode()
                # Every string begins in one part of a long text and lies in it whole.
                for begin in range(0, len(text) - length + 1, CHUNK):
                    parts.append((i, begin, text[begin : begin + CHUNK + length - 1]))
                    held += len(parts[-1][2])
                    if held >= CHUNK:
                        yield ranks(batch, parts)
                        parts, held = [], 0
            if parts:
                yield ranks(batch, parts)

    return run


def _next_ranks(length: int, width: int):
    """Sets of at most `width` strings of the given positions, with rank and pair."""
    names = ["k1", "k2", "u1", "u2", "t1", "t2", "at", "low", "high"]

    def ranks(ids: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows, keys, pairs, *places = zip(*found, strict=True)
        owner = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *_pair(keys),
                *_pair(pairs),
                ids.column(0).take(owner),
                ids.column(1).take(owner),
                *(pa.array(p, pa.int32()) for p in places),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (text, sets) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                text = text.as_py().encode()
                sets = sets.values
                for at, low, high in zip(*(sets.field(n).to_pylist() for n in ("at", "low", "high")), strict=True):
                    for cell in range(low // width, high // width + 1):
                        near, far = cell * width, cell * width + width - 1
                        a, b = max(low, near), min(high, far)
                        key, pair = digest(text[at - near : at - far + length]), digest(text[at - b : at - a + length])
                        found.append((i, key, pair, at, a, b))
                        if len(found) >= ROWS:
                            yield ranks(batch, found)
                            found = []
            if found:
                yield ranks(batch, found)

    return run


TEXT, RANK, PAIR, PLACE = ["t1", "t2"], ["k1", "k2"], ["u1", "u2"], ["at", "low", "high"]
RANKS = "k1 long, k2 long, t1 long, t2 int, at int, low int, high int"
PAIRS = "k1 long, k2 long, u1 long, u2 long, t1 long, t2 int, at int, low int, high int"


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def _lists(rows: DataFrame) -> DataFrame:
    """The sets of a text as one row; there are as many as the text is long, at most."""
    return rows.groupBy(*(F.col(t).alias(f"of_{t}") for t in TEXT)).agg(
        F.collect_set(F.struct(*PLACE)).alias("sets")
    )


def repeated_spans(documents: DataFrame, text_col: str = "text", length: int = 400) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): per text with repeated strings its spans (start, end; in bytes, ascending, apart), and the
    texts they can lie in, as (t1, t2, text).

    A span is a run of bytes covered by strings of `length` bytes that start anywhere else, too.
    """
    if length < STRETCH + GRAM:
        raise ValueError(f"strings must have at least {STRETCH + GRAM} bytes")
    texts = documents.select(*text_id(F.col(text_col)), F.col(text_col).alias("text"))
    ranks = stored(texts.mapInArrow(_first_ranks(length), RANKS), "ranks")
    alive = ranks.join(stored(_repeated(ranks, RANK), "repeated-ranks"), RANK)
    lists = stored(_lists(alive), "sets")
    own = (texts["t1"] == lists["of_t1"]) & (texts["t2"] == lists["of_t2"])
    again = stored(texts.join(lists, own).select(*TEXT, "text", "sets"), "suffix-texts")

    found, sets = None, again
    for width in WIDTHS:
        pairs = stored(sets.select(*TEXT, "text", "sets").mapInArrow(_next_ranks(length, width), PAIRS), "rank-pairs")
        if width < STRETCH:
            pairs = pairs.join(stored(_repeated(pairs, RANK), "repeated-ranks"), RANK)
        counted = pairs.groupBy(*PAIR).agg(
            F.count("*").alias("n"), F.min(F.struct(*RANK, *TEXT, *PLACE)).alias("first")
        )
        counted = stored(counted.where("n > 1"), "repeated-pairs")
        known = stored(pairs.join(counted.select(*PAIR, "n"), PAIR, "left"), "ranked")
        settled = known.where("n > 1").select(*TEXT, *PLACE).distinct()
        found = settled if found is None else found.unionByName(settled)
        if width == 1:
            break
        open_ = known.where("n is null").select(*RANK, *TEXT, *PLACE)
        kept = counted.select("first.*").join(stored(open_.select(*RANK).distinct(), "open-ranks"), RANK, "left_semi")
        lists = stored(_lists(open_.unionByName(kept.select(*open_.columns))), "sets")
        base = again.drop("sets")
        sets = base.join(lists, (base["t1"] == lists["of_t1"]) & (base["t2"] == lists["of_t2"]))

    found = stored(found, "repeated-strings")
    spans = found.groupBy(*TEXT).agg(
        F.array_sort(
            F.collect_set(
                F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
            )
        ).alias("runs")
    )
    kind = "array<struct<start:int,end:int>>"
    joined = F.aggregate(
        "runs",
        F.array().cast(kind),
        lambda done, run: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["end"], run["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(run))),
    )
    return stored(spans.select(*TEXT, joined.alias("spans")), "spans"), again.select(*TEXT, "text")


def cut(texts: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The rows with `kept` (binary), the bytes outside the spans. What is left need not be valid UTF-8."""
    at, spans = texts.columns.index(text_col), texts.columns.index(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            kept = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                text, parts, done = (text or "").encode(), [], 0
                for span in gone or ():
                    parts.append(text[done : span["start"]])
                    done = span["end"]
                kept.append(b"".join([*parts, text[done:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], [*batch.schema.names, "kept"])

    return texts.mapInArrow(run, schema_with(texts.schema, kept="binary"))


def remove_repeats(documents: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """The documents' columns, `spans` and `kept` (binary): the text without its repeated strings."""
    spans, _ = repeated_spans(documents, text_col, length)
    t1, t2 = text_id(F.col(f"`{text_col}`"))
    rows = packed(documents, ["spans", "kept"], t1=t1, t2=t2)
    return cut(rows.join(spans, TEXT, "left").select("row.*", "spans"), text_col)


def removal_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row.

    Texts without repeated strings are hashed where they are read; only the others
    are cut.
    """
    spans, texts = repeated_spans(documents, text_col, length)
    done = cut(texts.dropDuplicates(TEXT).join(spans, TEXT)).select(
        *TEXT, "spans", F.sha2("kept", 256).alias("kept_sha256")
    )
    done = stored(done, "cut-texts")
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(id_col).alias("id"),
        *text_id(F.col(text_col)),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.sha2(whole, 256).alias("whole_sha256"),
    )
    return rows.join(done, TEXT, "left").select(
        "id",
        "n_bytes",
        F.aggregate(
            F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)),
            F.lit(0).cast("long"),
            lambda n, s: n + s["end"] - s["start"],
        ).alias("n_removed"),
        F.greatest(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )
