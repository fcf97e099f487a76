"""Token counts from distinct pre-tokens.

No piece of the vocabulary crosses from a visible character to a white space
mark, and none holds a line feed, so a text is the sum of its pre-tokens: a run
of blanks with what follows it. Tasks write, per block of documents and
distinct pre-token, one posting row with packed (document in block, frequency)
pairs; the rows meet sorted by pre-token, the library encodes each pre-token
once, and the product with the frequencies is summed per document. Ids are
never kept. A pre-token that all documents hold has one row per block; rows
also part by groups of `SALT` input partitions, so no task gets more than that
many partitions' worth of it.

Defined cases: null counts as empty and has no tokens; repeated rows are counted
each; any id type, nulls included; no rows give no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import type_of

BLOCK_DOCS = 65_536  # local numbers are two bytes
BLOCK_BYTES = 24 << 20
SALT = 256
PIECES = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def pre_tokens(text: str) -> tuple[list[str], int]:
    """The pre-tokens of a non-empty text, its start mark included, and its line feeds."""
    lines = (" " + text).split("\n")
    found = PIECES.findall(lines[0])
    for line in lines[1:]:
        found += PIECES.findall(line)
    return found, len(lines) - 1


class PieceCounter:
    """Counts the pieces of a pre-token as it stands within a text."""

    def __init__(self, model_path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._start = len(self._library.encode("\n"))

    def __call__(self, tokens: list[str]) -> list[int]:
        # A line feed in front is one piece of its own and keeps the start mark away.
        return [len(ids) - self._start for ids in self._library.encode(["\n" + t for t in tokens], num_threads=1)]


def _postings(id_type: pa.DataType):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                ids.append(column[i])
                texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES or len(texts) == BLOCK_DOCS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if texts:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), ["token", "block", "packed"]
        for number, (ids, texts) in enumerate(blocks(batches)):
            block = (part << 24) + number
            slots: dict[str, int] = {}
            slot, place, times, sizes, feeds = [], [], [], [], []
            for i, text in enumerate(texts):
                sizes.append(len(text.encode()))
                tokens, n = pre_tokens(text) if text else ([], 0)
                feeds.append(n)
                for token, count in Counter(tokens).items():
                    slot.append(slots.setdefault(token, len(slots)))
                    place.append(i)
                    times.append(count)
            slot, place, times = np.array(slot, np.int32), np.array(place, "<u2"), np.array(times, "<u4")
            order = np.argsort(slot, kind="stable")
            ends = np.cumsum(np.bincount(slot, minlength=len(slots)))
            # (document, frequency) in three bytes; larger frequencies take several entries.
            place, times = place[order], times[order]
            more = np.maximum(1, -(-times.astype(np.int64) // 255))
            starts = np.repeat(np.cumsum(more) - more, more)
            step = np.arange(len(starts)) - starts
            packed = np.zeros((len(starts), 3), np.uint8)
            packed[:, :2] = np.repeat(place, more).view(np.uint8).reshape(-1, 2)
            packed[:, 2] = np.minimum(255, np.repeat(times, more) - 255 * step)
            ends = np.concatenate([[0], np.cumsum(more)])[np.concatenate([[0], ends])] if len(slots) else np.zeros(1, int)
            data = pa.py_buffer(packed.tobytes())
            binary = pa.Array.from_buffers(
                pa.binary(), len(slots), [None, pa.py_buffer((3 * ends).astype("<i4").tobytes()), data]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(slots), pa.string()), pa.array(np.full(len(slots), block, np.int64)), binary], names
            )
            head = pa.record_batch([pa.array([x.as_py() for x in ids], id_type), pa.array(sizes), pa.array(feeds)], ["id", "n_bytes", "feeds"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as stream:
                stream.write_batch(head)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.string()), pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()])], names
            )

    return run


def _sums(model_path: str):
    """Encodes every pre-token once and adds pieces x frequency per document of a block."""

    def flush(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        blocks, rows = [], []
        for block, total in sums.items():
            used = np.flatnonzero(total)
            entry = np.zeros(len(used), np.dtype([("i", "<u2"), ("n", "<i8")]))
            entry["i"], entry["n"] = used, total[used]
            blocks.append(block)
            rows.append(entry.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(rows, pa.binary())], ["block", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(model_path)
        sums: dict[int, np.ndarray] = {}
        last, pieces = None, 0
        for batch in batches:
            words = batch.column(0).to_pylist()
            fresh = [w for i, w in enumerate(words) if w != (words[i - 1] if i else last)]
            counts = iter(count(fresh))
            blocks, packed = batch.column(1).to_numpy(), batch.column(2)
            for i, word in enumerate(words):
                if word != last:
                    last, pieces = word, next(counts)
                entry = np.frombuffer(packed[i].as_buffer(), np.uint8).reshape(-1, 3)
                at = entry[:, 0].astype(np.int64) | (entry[:, 1].astype(np.int64) << 8)
                total = sums.get(int(blocks[i]))
                if total is None:
                    total = sums[int(blocks[i])] = np.zeros(int(at[-1]) + 1, np.int64)
                elif len(total) <= at[-1]:
                    total = sums[int(blocks[i])] = np.concatenate([total, np.zeros(int(at[-1]) + 1 - len(total), np.int64)])
                if len(at) == 1:
                    total[at[0]] += pieces * int(entry[0, 2])
                else:
                    np.add.at(total, at, pieces * entry[:, 2].astype(np.int64))
            if len(sums) > 64 * SALT:
                yield flush(sums)
                sums = {}
        yield flush(sums)

    return run


def _per_document():
    def run(group: pa.Table) -> pa.Table:
        heads = [x for x, h in zip(group["part"], group["head"], strict=True) if h.as_py()]
        head = pa.ipc.open_stream(heads[0].as_buffer()).read_all()
        total = head["feeds"].to_numpy().copy()
        for part, is_head in zip(group["part"], group["head"], strict=True):
            if not is_head.as_py():
                entry = np.frombuffer(part.as_buffer(), np.dtype([("i", "<u2"), ("n", "<i8")]))
                total[entry["i"]] += entry["n"]
        return pa.table([head["id"], head["n_bytes"], pa.array(total)], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row, as the sentencepiece library counts its whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = type_of(documents, id_col)
    arrow = to_arrow_type(documents.schema[id_col].dataType)
    postings = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _postings(arrow), "token string, block long, packed binary"
    )
    # The header row of a block comes with its postings, so one scan makes both.
    salt = F.floor(F.shiftright("block", 24) / F.lit(SALT))
    spread = F.when(F.col("token").isNull(), F.col("block")).otherwise(salt)
    dealt = postings.repartition("token", spread).sortWithinPartitions("token", "block")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "part", "head"]
        heads: list[pa.RecordBatch] = []

        def words() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column(0).null_count  # null sorts first
                if n:
                    heads.append(
                        pa.RecordBatch.from_arrays([*(c.slice(0, n) for c in batch.columns[1:]), pa.array([True] * n)], names)
                    )
                if n < batch.num_rows:
                    yield batch.slice(n)

        for sums in _sums(model_path)(words()):
            yield pa.RecordBatch.from_arrays([*sums.columns, pa.array([False] * sums.num_rows, pa.bool_())], names)
            yield from heads
            heads.clear()

    sums = dealt.mapInArrow(both, "block long, part binary, head boolean")
    return sums.groupBy("block").applyInArrow(
        _per_document(), f"id {kind}, n_bytes long, n_tokens long"
    )
