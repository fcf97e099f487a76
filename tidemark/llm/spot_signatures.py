"""Document fingerprints from spot signatures, and how alike a text is to its neighbours.

Common words are anchors. An anchor and the `CHAIN` content words that follow it are a
signature; a text's fingerprint is its multiset of signatures, each with its number among
its equals a 32-bit hash. Where a text has no anchor for `GAP` words, and at its start, a chain begins without one, so texts of
any language and lists of rare words have fingerprints, too. Letters count in lower case;
ideographs and kana are words of one character, and long words are read in pieces. In a
text of anchors only, chains are made of anchors.

Anchors are the words that make up at least `SHARE` of all words of the corpus, so there
are 1 / SHARE at most. A word with that share of all words has it in at least one block of
any division into blocks, so tasks name the candidates of their blocks, and a second pass
counts only those.

Likeness is the Jaccard coefficient of two fingerprints. Sets are parted by length: the
bounds grow by 1 / least, and sets of parts that are not neighbours cannot reach `least`.
Others are compared piece by piece and left as soon as the rest cannot reach it.

Each text also meets the next one in falling order of ids. Ranges of ids are found first,
from ids and hashes alone; a range's texts meet in one task, which reads them as a stream,
with a copy of the first text of the next range. A range holds about RANGE_BYTES, and
there are at most 2^16 of them.

Defined cases: null is the empty text; texts without words have the empty fingerprint; two
empty fingerprints have likeness 1, an empty and another 0; rows with one id follow each
other by a hash of their texts, null ids come last; the only row is its own next one; no
rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, schema_with, type_of

SHARE = 1 / 400
CHAIN = 2
GAP = 6
BLOCK_WORDS = 1 << 22
TABLE_WORDS = 1 << 20
RANGE_BYTES = 32 << 20
MAX_RANGES = 1 << 16
BATCH_BYTES = 4 << 20
COMPARE = 1 << 12  # signatures compared at a time
WORD = re.compile("[぀-ヿ㐀-䶿一-鿿]|[^\\W_぀-ヿ㐀-䶿一-鿿]{1,16}")
ASCII_WORD = re.compile("[a-z0-9]{1,16}")


def words_of(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) of the words with the wanted share in some block; and, without a word, the bytes of all texts."""

    def common() -> pa.RecordBatch:
        least = SHARE * counts.total()
        found = [w for w, n in counts.items() if n >= least]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([0] * len(found), pa.int64())], ["word", "bytes"])

    counts, size = Counter(), 0
    for batch in pieces(batches, 0):
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(words_of(text))
                size += len(text.encode())
        if counts.total() >= BLOCK_WORDS:
            yield common()
            counts = Counter()
    yield common()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([size], pa.int64())], ["word", "bytes"])


def _counter(wanted: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, counts, total = set(wanted), Counter(), 0
        for batch in pieces(batches, 0):
            for text in batch.column(0).to_pylist():
                found = words_of(text) if text else []
                total += len(found)
                counts.update(filter(keep.__contains__, found))
        rows = [*counts.items(), (None, total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"]
        )

    return run


def common_words(documents: DataFrame, text_col: str = "text") -> tuple[list[str], int]:
    """(the words that make up at least SHARE of all words, the bytes of all texts)."""
    texts = documents.select(F.col(f"`{text_col}`").alias("text"))
    named = texts.mapInArrow(_candidates, "word string, bytes long").groupBy("word").agg(F.sum("bytes").alias("bytes"))
    named = {r.word: r.bytes for r in named.collect()}  # 1 / SHARE words per block at most, nearly the same in all
    size = named.pop(None, 0)
    counted = texts.mapInArrow(_counter(sorted(named)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word: r.n for r in counted.collect()}
    total = counts.pop(None, 0)
    return sorted(w for w, n in counts.items() if n >= SHARE * total), size


class Codes(dict):
    """Codes of words: 63 bits of a hash, and whether the word is an anchor."""

    def __init__(self, anchors: list[str]):
        self._anchors = frozenset(anchors)

    def __missing__(self, word: str) -> int:
        self[word] = code = xxhash.xxh3_64_intdigest(word) >> 1 << 1 | (word in self._anchors)
        return code


class Spotter:
    """Signatures of texts, given the anchors."""

    def __init__(self, anchors: list[str]):
        self._codes = Codes(anchors)

    def codes(self, text: str) -> np.ndarray:
        words = words_of(text)
        if len(self._codes) > TABLE_WORDS:
            self._codes.clear()
        return np.fromiter(map(self._codes.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        return signatures(self.codes(text))

    def split(self, text: str, cut: int) -> tuple[np.ndarray, int, np.ndarray]:
        """(signatures, a place up to `cut` where a word begins, codes of the words before it)."""
        place = text.rfind(" ", 0, cut) + 1
        head = self.codes(text[:place])
        return signatures(np.concatenate([head, self.codes(text[place:])])), place, head


def signatures(codes: np.ndarray) -> np.ndarray:
    """The signatures of a sequence of words, ascending."""
    if not len(codes):
        return np.zeros(0, np.uint32)
    anchor = (codes & np.uint64(1)).astype(bool)
    place = np.arange(len(codes))
    content = place[~anchor]
    since = place - np.maximum.accumulate(np.where(anchor, place, -1))
    starts = np.flatnonzero(anchor | (place == 0) | (since % GAP == 0))
    head = np.where(anchor[starts], codes[starts], np.uint64(1))
    first = np.searchsorted(content, starts)
    chained = first < len(content)
    if not chained.any():  # anchors only: each is followed by the next ones
        content, first, head, chained = place, place + 1, codes, np.ones(len(codes), bool)
    value, first = head[chained], first[chained]
    for step in range(CHAIN):
        at = first + step
        follows = np.where(at < len(content), codes[content[np.minimum(at, len(content) - 1)]], np.uint64(0))
        value = (value ^ follows) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
    value.sort()
    again = np.flatnonzero(np.diff(value, prepend=~value[:1]))
    times = np.arange(len(value)) - np.repeat(again, np.diff(again, append=len(value)))
    value = (value + times.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((value >> np.uint64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    """Eight hexadecimal digits per signature, ascending."""
    return found.astype(">u4").tobytes().hex()


def set_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def length_part(n: int, least: float) -> int:
    """The part of sets with n signatures. With sets of parts that are no neighbours the coefficient is below `least`."""
    return -1 if not n else int(math.log(n) / -math.log(least)) if 0 < least < 1 else n if least else 0


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard coefficient of two sorted sets if it is at least `least`, otherwise 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) or length_part(len(b), least) - length_part(len(a), least) > 1:
        return 0.0
    both, done = 0, 0
    for at in range(0, len(a), COMPARE):
        part = a[at : at + COMPARE]
        stop = int(np.searchsorted(b, part[-1], "right"))
        both += len(np.intersect1d(part, b[done:stop], assume_unique=True))
        done = stop
        left_a, left_b = len(a) - at - len(part), len(b) - done
        most = both + min(left_a, left_b)
        if most < least * (len(a) + len(b) - most):
            return 0.0
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by as many code points of the other's start, or all of them."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def _place(value, tie: int) -> tuple:
    """Sorts ids; nulls are least, rows of one id go by their text's hash."""
    return (value is not None, value, tie) if value is not None else (False, tie)


def _ranges(documents: DataFrame, count: int) -> list[tuple]:
    """The greatest place of every range of ids, ascending; at most `count`."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    order = [F.desc_nulls_last("id"), F.desc("tie")]
    dealt = documents.select("id", "tie").repartitionByRange(count, *order).sortWithinPartitions(*order)
    return sorted(_place(r.id, r.tie) for r in dealt.mapInArrow(first, dealt.schema).collect())


def _dealt(bounds: list[tuple]) -> Callable:
    """Rows with the number of their range. The first row of a range also goes to the range before it, as `look`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {b: i for i, b in enumerate(bounds)}
        sent = set()
        names = ["range", "look", "id", "tie", "text"]
        for batch in pieces(batches, 2, BATCH_BYTES):
            places = list(map(_place, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ranges = [bisect_left(bounds, p) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([False] * len(ranges)), *batch.columns], names)
            firsts = [(i, heads[p]) for i, p in enumerate(places) if p in heads and p not in sent]
            sent |= {places[i] for i, _ in firsts}
            if firsts:
                rows = batch.take(pa.array([i for i, _ in firsts]))
                before = [(b + 1) % len(bounds) for _, b in firsts]  # ids fall, so the range before has the higher number
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array([True] * len(firsts)), *rows.columns], names)

    return run


def _compared(anchors: list[str], id_type: pa.DataType, least: float) -> Callable:
    """Fingerprints of a stream of rows sorted by range, `look` and falling place, each with its next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = Spotter(anchors)
        out, held = [], 0
        last = None  # (range, id, text, signatures, place, codes of the words before the place)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, made, strict=True)], [n for n, _ in made])

        made = [("id", id_type), *RESULT]
        for batch in pieces(batches, 4, BATCH_BYTES):
            ranges, looks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, look, key, text in zip(ranges, looks, batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if last is None and look:
                    continue  # a further copy of the first row of the next range
                text = text or ""
                own = last[3:] if last and last[2] == text else spot.split(text, len(text) - len(text) // 3)
                if last is not None:
                    if last[0] != at:
                        raise RuntimeError("a range of ids came without the first row of the next one")
                    _, before_id, before, found, place, head = last
                    whole = edited(before, text)
                    # Up to `place` the edited text has the words of the text.
                    other = signatures(np.concatenate([head, spot.codes(whole[place:])]))
                    row = (
                        before_id,
                        len(before),
                        len(found),
                        hashlib.sha256(whole.encode()).hexdigest(),
                        fingerprint(found),
                        fingerprint(other),
                        pruned_jaccard(found, other, least),
                        pruned_jaccard(found, own[0], least),
                    )
                    out.append(row)
                    held += len(row[4]) + len(row[5]) + 200
                    if held >= BATCH_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                last = None if look else (at, key, text, *own)
        if out:
            yield batch_of(out)

    return run


RESULT = [
    ("n_chars", pa.int64()),
    ("n_signatures", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]


def fingerprints(documents: DataFrame, anchors: list[str], text_col: str = "text") -> DataFrame:
    """The documents' columns and `signatures`, the sorted set as array<long>."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = Spotter(anchors)
        for batch in pieces(batches, at, BATCH_BYTES):
            sets = [spot(t or "").astype(np.int64) for t in batch.column(at).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64())
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "signatures"])

    return documents.mapInArrow(run, schema_with(documents.schema, signatures="array<bigint>"))


def edited_likeness(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0
) -> DataFrame:
    """Per row: id, n_chars, n_signatures, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text replaced by the start of the next
    document's, in falling order of ids; after the last comes the first. near_edited and
    near_next are the likeness to the edited text and the next document, or 0 below `least`.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = type_of(documents, id_col)
    arrow = to_arrow_type(documents.schema[id_col].dataType)
    anchors, size = common_words(documents, text_col)
    rows = documents.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tie"),
        F.col(f"`{text_col}`").alias("text"),
    )
    bounds = _ranges(rows, min(MAX_RANGES, size // RANGE_BYTES + 1))
    dealt = rows.mapInArrow(_dealt(bounds), f"range int, look boolean, id {kind}, tie long, text string")
    dealt = dealt.repartitionById(max(1, len(bounds)), "range")
    dealt = dealt.sortWithinPartitions("range", "look", F.desc_nulls_last("id"), F.desc("tie"))
    made = ", ".join(f"{n} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for n, t in RESULT)
    return dealt.mapInArrow(_compared(anchors, arrow, least), f"id {kind}, {made}")
