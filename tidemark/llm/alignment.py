"""Cross-tokenizer alignment by sparse products of token-byte incidence matrices.

Two tokenizers cut the same bytes, space + text, in two ways. Each has an incidence
matrix, tokens x bytes, with a one where a token covers a byte. The matrices are held
in compressed rows made by hand (`Csr`), and Gustavson's row-wise product A.B^T has an
entry for every pair of tokens that share bytes, the number of shared bytes: the
overlap links. Those whose byte ranges end together are the links; the bytes where they
end cut the tokens into groups. The product of the two group incidences, G_A.G_B^T, has
an entry for every pair of one group: the shared-group links. A long run on which the
tokenizers never meet makes a group with very many of them, so they are counted by the
product's symbolic step and written out in blocks of rows only on demand.

The corpus' matrices are block diagonal, with equal blocks for equal segments: texts are cut
before white space, which no token of either vocabulary crosses. A task multiplies each
distinct segment of a block of documents once, in stretches of rows, so memory does not grow
with the length of a text, and writes each block in rows of at most 128 KB: the documents'
results, their segments by number and the segments' links, cut into chunks, and the distinct id
pairs with their counts. Pair counts are summed over the corpus (combined before the shuffle) and
stored; each block gets its chunks and the counts of its own pairs together. No text is shuffled,
and a pair that all documents hold has one row per block.

Tokenizers: (A) a byte-level BPE from a `tokenizers` file, read into the faster `tiktoken`
library, whose ids are the same (tests compare them); texts with very long runs of white
space, which `tiktoken` refuses, go to `tokenizers` itself. (B) a sentencepiece model with
a leading space mark and byte fallback. Neither adds or knows special tokens here.

Defined cases: null and empty texts, and texts that a tokenizer's bytes do not give back
(such as those with U+2581), have no tokens: zeros and an empty hash; repeated rows and
null ids are rows like any other; equal counts tie; no rows give no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, stored, type_of

TEXT_BYTES = 1 << 18  # tokenized at a time
PRODUCT = 1 << 20  # entries of a product held at a time
SEGMENTS = 1 << 17  # of a block
SEGMENT_BYTES = 1 << 24
REFERENCES = 1 << 21
BLOCK_DOCS = 1 << 16
CHUNK = 1 << 17  # bytes of a stored row of a block
# Rows of a row group and of a page: readers and writers hold 4 MB of blocks, however many blocks a file has.
ROW_GROUPS = {"parquet.block.row.count.limit": "32", "parquet.page.row.count.limit": "8"}
LONG_BLANK = 1000
ID_BITS = 16  # both vocabularies are smaller

# The pre-token pattern of byte-level BPE files, and sentencepiece's space mark.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"

# White space and what follows it. A cut lies before some ASCII white space that follows visible characters, where
# byte-level pre-tokens end, too. Carriage returns are in pieces behind visible characters, and libraries differ on
# what else is white space; there is no cut before those.
SEGMENT = r"\s*\S+(?:[^\S \t\n\f\v]\s*\S+)*(?:[^\S \t\n\f\v]\s*)?|\s+"


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has columns indices[indptr[i]:indptr[i + 1]] with the values of data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int


def incidence(starts: np.ndarray, ends: np.ndarray, columns: int) -> Csr:
    """Rows with ones from start to end."""
    sizes = ends - starts
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    indices = np.arange(indptr[-1]) + np.repeat(starts - indptr[:-1], sizes)
    return Csr(indptr, indices, np.ones(len(indices), np.int32), columns)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))[order]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    return Csr(indptr, rows, m.data[order], len(m.indptr) - 1)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """The symbolic step: terms that each row of a.b is a sum of."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def product(a: Csr, b: Csr) -> Iterator[tuple[int, Csr]]:
    """(first row, rows) of a.b by Gustavson: every entry of a row of `a` adds its multiple of a row of `b`.

    Rows come in stretches of about PRODUCT terms.
    """
    sizes = product_sizes(a, b)
    cells = np.cumsum(sizes) // PRODUCT
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(sizes)]])
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if first == last:
            continue
        inner = a.indices[a.indptr[first] : a.indptr[last]]
        factor = a.data[a.indptr[first] : a.indptr[last]]
        counts = b.indptr[inner + 1] - b.indptr[inner]
        before = np.cumsum(counts) - counts
        at = np.repeat(b.indptr[inner] - before, counts) + np.arange(counts.sum())
        rows = np.repeat(np.arange(last - first), sizes[first:last])
        cols, terms = b.indices[at], np.repeat(factor, counts) * b.data[at]
        key = rows * np.int64(b.columns) + cols
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, rows, cols, terms = key[order], rows[order], cols[order], terms[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(terms, heads) if len(heads) else terms
        indptr = np.concatenate([[0], np.cumsum(np.bincount(rows[heads], minlength=last - first))])
        yield first, Csr(indptr, cols[heads], sums, b.columns)


def entries(part: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries."""
    return np.repeat(np.arange(len(part.indptr) - 1), np.diff(part.indptr)), part.indices, part.data


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of A, token of B, shared bytes) of all that overlap, from A.B^T over stretches of bytes.

    Both cut the same bytes into tokens; given are the ends.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends_a // PRODUCT)) + 1, [len(ends_a)]])
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if first == last:
            continue
        low = int(ends_a[first - 1]) if first else 0
        high = int(ends_a[last - 1])
        b0, b1 = np.searchsorted(ends_b, [low, high - 1], "right")
        rows = np.concatenate([[low], ends_a[first:last]]) - low
        cols = np.clip(np.concatenate([[low], ends_b[b0 : b1 + 1]]) - low, 0, high - low)
        a = incidence(rows[:-1], rows[1:], high - low)
        b = incidence(cols[:-1], cols[1:], high - low)
        for at, part in product(a, transposed(b)):
            i, j, shared = entries(part)
            yield first + at + i, b0 + j, shared


class Tokenizers:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            whole = json.load(f)
        self._a_path, self._slow = a_path, None
        alphabet, added = _byte_alphabet(), {t["content"] for t in whole["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in added}
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a = _by_id({i: t for t, i in ranks.items()})
        self.bytes_b = _by_id({i: self._piece(i) for i in range(self._b.get_piece_size())})
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self._blank = re.compile(r"\s{%d}" % LONG_BLANK)
        self._start = len(self._b.encode("\n"))
        pieces_ = [self._b.id_to_piece(i).replace(MARK, " ") for i in range(self._b.get_piece_size()) if not self._b.is_byte(i)]
        if any("\n" in p for p in pieces_):
            raise ValueError("a piece of the sentencepiece model holds a line feed")
        crossing = any(re.search(r"\S[ \t\n\f\v]", p) for p in pieces_)
        self._segment = re.compile("(?s).+" if crossing else SEGMENT)

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace(MARK, " ").encode()

    def a(self, string: str) -> list[int]:
        if len(string) > LONG_BLANK and self._blank.search(string):
            return self._whole(string)
        return self._a.encode_ordinary(string)

    def _whole(self, string: str) -> list[int]:
        from tokenizers import Tokenizer

        if self._slow is None:
            self._slow = Tokenizer.from_file(self._a_path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(string, add_special_tokens=False).ids

    def b(self, strings: list[str]) -> list[list[int]]:
        # A line feed in front is one piece of its own and keeps the start mark away.
        return [ids[self._start :] for ids in self._b.encode(["\n" + s for s in strings], num_threads=1)]

    def segments(self, text: str) -> list[str]:
        """The text with its space in front, cut where no token of either vocabulary can cross."""
        return self._segment.findall(" " + text)


def _byte_alphabet() -> dict[str, int]:
    """The visible characters that byte-level files write for bytes: printable ones for themselves, others from U+0100."""
    visible = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _by_id(table: dict[int, bytes]) -> list[bytes]:
    return [table.get(i, b"") for i in range(max(table) + 1)]


class Aligned(NamedTuple):
    """Tokens and links of some strings that lie one after another."""

    a: np.ndarray  # ids
    b: np.ndarray
    n_a: np.ndarray  # per string
    n_b: np.ndarray
    ends_a: np.ndarray  # bytes, from the first string's start
    ends_b: np.ndarray
    ends: np.ndarray  # of strings
    link_a: np.ndarray  # tokens that end together
    link_b: np.ndarray
    good: np.ndarray  # strings that both tokenizers give back; others have no tokens


def align(strings: list[str], tokenizers: Tokenizers) -> Aligned:
    """Links of strings that start where a text, its leading space included, can be cut."""
    empty = np.zeros(0, np.int64)
    a, b = [tokenizers.a(s) for s in strings], tokenizers.b(strings)
    good = np.ones(len(strings), bool)
    data = [s.encode() for s in strings]
    whole = b"".join(data)
    for table, sizes, found in ((tokenizers.bytes_a, tokenizers.sizes_a, a), (tokenizers.bytes_b, tokenizers.sizes_b, b)):
        ids = _flat(found)
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum([len(x) for x in found], dtype=np.int64)]
        if np.array_equal(ends, np.cumsum([len(x) for x in data])) and _joined(table, ids.tolist()) == whole:
            continue
        good &= np.array([_joined(table, x) == d for x, d in zip(found, data, strict=True)], bool)
    if not good.all():
        a, b = ([x if ok else [] for x, ok in zip(found, good.tolist(), strict=True)] for found in (a, b))
    n_a, n_b = (np.array([len(x) for x in found], np.int64) for found in (a, b))
    a, b = _flat(a), _flat(b)
    ends_a, ends_b = np.cumsum(tokenizers.sizes_a[a]), np.cumsum(tokenizers.sizes_b[b])
    ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
    links: list[tuple[np.ndarray, np.ndarray]] = [(empty, empty)]
    for i, j, _ in overlaps(ends_a, ends_b):
        together = ends_a[i] == ends_b[j]
        links.append((i[together], j[together]))
    return Aligned(a, b, n_a, n_b, ends_a, ends_b, ends, *(np.concatenate(x) for x in zip(*links, strict=True)), good)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def groups(found: Aligned) -> tuple[Csr, Csr]:
    """The group incidences, tokens x groups."""
    joint = found.ends_a[found.link_a]
    out = []
    for ends in (found.ends_a, found.ends_b):
        at = np.searchsorted(joint, ends)
        out.append(incidence(at, at + 1, len(joint)))
    return out[0], out[1]


def group_texts(found: Aligned, a: Csr, b: Csr, words: list[bytes]) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3;` per string. `words` has each id with each of the marks , | ; behind it."""
    of_a, of_b, n = a.indices, b.indices, a.columns
    count_a, count_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    before_b = np.concatenate([[0], np.cumsum(count_b)])
    upto_a = np.cumsum(count_a)
    codes = np.empty(len(of_a) + len(of_b), np.int64)
    mark_a = np.append(np.diff(of_a) > 0, True)[: len(of_a)]
    mark_b = np.append(np.diff(of_b) > 0, True)[: len(of_b)]
    codes[np.arange(len(of_a)) + before_b[of_a]] = 3 * found.a + mark_a
    codes[np.arange(len(of_b)) + upto_a[of_b]] = 3 * found.b + 2 * mark_b
    ends = np.cumsum(found.n_a + found.n_b).tolist()
    parts = list(map(words.__getitem__, codes.tolist()))
    return [b"".join(parts[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]


HEAD = [
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("n_groups", pa.int64()),
    ("n_links", pa.int64()),
    ("n_group_links", pa.int64()),
    ("n_segments", pa.int64()),
    ("groups_sha256", pa.string()),
]


def _per(owner_ends: np.ndarray, at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Sums of the values at byte ends `at`, by the string that holds them."""
    sums = np.bincount(np.searchsorted(owner_ends, at), values, len(owner_ends))
    return sums.astype(np.int64)


class _Block:
    """Texts as sequences of distinct segments. Equal segments have equal blocks in the matrices, so each is multiplied once."""

    def __init__(self, tokenizers: Tokenizers, words: list[bytes]):
        self._tokenizers, self._words = tokenizers, words
        self._slots: dict[str, int] = {}
        self._ids: list[pa.Array] = []
        self._texts: list[np.ndarray] = []
        self.references = self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        slots = self._slots
        self._ids.append(ids)
        for text in texts:
            found = self._tokenizers.segments(text) if text else []
            for segment in found:
                if segment not in slots:
                    slots[segment] = len(slots)
                    self.bytes += len(segment)
            self._texts.append(np.fromiter(map(slots.__getitem__, found), np.int32, len(found)))
            self.references += len(found)

    def full(self) -> bool:
        return (
            len(self._slots) >= SEGMENTS
            or self.bytes >= SEGMENT_BYTES
            or self.references >= REFERENCES
            or len(self._texts) >= BLOCK_DOCS
        )

    def __bool__(self) -> bool:
        return bool(self._ids)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        strings = list(self._slots)
        part, size, parts = [], 0, []
        for string in [*strings, None]:
            if part and (string is None or size >= TEXT_BYTES):
                parts.append(self._segments(part))
                part, size = [], 0
            if string is not None:
                part.append(string)
                size += len(string)
        stats = np.concatenate([np.zeros((6, 0), np.int64), *(p[0] for p in parts)], 1)
        forms = [t for p in parts for t in p[1]]
        keys = np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)])
        good = stats[0].astype(bool)

        empty, texts, shas = np.zeros(0, np.int32), [], []
        for at in self._texts:
            whole = len(at) and good[at].all()
            texts.append(at if whole else empty)
            form = b"".join(map(forms.__getitem__, at.tolist()))[:-1] if whole else None
            shas.append(hashlib.sha256(form).hexdigest() if whole else "")
        sizes = np.array([len(at) for at in texts], np.int64)
        refs = np.concatenate([empty, *texts])
        ends = np.cumsum(sizes)
        sums = []
        for values in stats[1:]:
            running = np.concatenate([[0], np.cumsum(values[refs])])
            sums.append(running[ends] - running[ends - sizes])
        columns = [pa.array(x, pa.int64()) for x in (*sums, sizes)]
        head = pa.Table.from_arrays(
            [pa.chunked_array(self._ids), *columns, pa.array(shas, pa.string())], ["id", *(n for n, _ in HEAD)]
        )

        # Frequent segments and pairs get small numbers, so that the upper planes are nearly empty.
        times = np.bincount(refs, minlength=len(strings))
        links = stats[4]
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, np.repeat(times, links), len(pairs)).astype(np.int64)
        by_count = np.argsort(-counts, kind="stable")
        by_count = by_count[counts[by_count] > 0]
        pair_rank = np.full(len(pairs), -1, np.int64)
        pair_rank[by_count] = np.arange(len(by_count))
        used = order[times[order] > 0]
        first = np.cumsum(links) - links
        at = np.repeat(first[used] - (np.cumsum(links[used]) - links[used]), links[used]) + np.arange(links[used].sum())
        packed = _ipc(head), _planes(rank[refs]), links[used].astype("<u4").tobytes(), _planes(pair_rank[place[at]])
        yield from _chunks(block, packed)
        for start in range(0, len(by_count), CHUNK // 16):
            part = by_count[start : start + CHUNK // 16]
            yield _row(block, first=start, pairs=pairs[part], counts=counts[part])

    def _segments(self, strings: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(good and the numbers of HEAD, group text, pairs of all links) of some segments."""
        found = align(strings, self._tokenizers)
        a, b = groups(found)
        joint = found.ends_a[found.link_a]
        last_b = np.flatnonzero(np.diff(b.indices, append=b.columns))
        stats = np.stack(
            [
                found.good.astype(np.int64),
                found.n_a,
                found.n_b,
                _per(found.ends, found.ends_b[last_b]),
                _per(found.ends, joint),
                _per(found.ends, found.ends_a, product_sizes(a, transposed(b))),
            ]
        )
        keys = (found.a[found.link_a] << ID_BITS) | found.b[found.link_b]
        return stats, group_texts(found, a, b, self._words), keys


ROW = pa.schema(
    [
        ("block", pa.int64()),
        ("part", pa.int32()),
        ("first", pa.int64()),
        ("data", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
    ]
)
BLOCKS = "block long, part int, first long, data binary, pairs array<long>, counts array<long>"
PARTS = ("head", "refs", "sizes", "places")


def _row(block: int, **values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": block, **values}], ROW)


def _chunks(block: int, parts: tuple[bytes, ...]) -> Iterator[pa.RecordBatch]:
    for part, data in enumerate(parts):
        for first in range(0, len(data), CHUNK):
            yield _row(block, part=part, first=first, data=data[first : first + CHUNK])


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _planes(numbers: np.ndarray) -> bytes:
    """The lower and the upper two bytes of numbers, apart."""
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    both = np.frombuffer(planes, "<u2").reshape(2, -1).astype(np.int64)
    return both[0] | (both[1] << 16)


def _blocks(a_path: str, b_path: str, id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        size = max(len(tokenizers.bytes_a), len(tokenizers.bytes_b))
        words = [f"{i}{mark}".encode() for i in range(size) for mark in ",|;"]
        number = TaskContext.get().partitionId() << 24
        block = _Block(tokenizers, words)
        for batch in pieces(batches, 1, TEXT_BYTES):
            block.add(batch.column(0).cast(id_type), batch.column(1).to_pylist())
            if block.full():
                yield from block.rows(number)
                block, number = _Block(tokenizers, words), number + 1
        if block:
            yield from block.rows(number)

    return run


def _per_document(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    chunks: list[list[bytes]] = [[] for _ in PARTS]
    for row in blocks.sort_by([("part", "ascending"), ("first", "ascending")]).to_pylist():
        chunks[row["part"]].append(row["data"])
    stream, refs, sizes, places = map(b"".join, chunks)
    head = pa.ipc.open_stream(stream).read_all()
    refs, places = _numbers(refs), _numbers(places)
    segment_ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
    segment_starts = np.concatenate([[0], segment_ends[:-1]]) if len(segment_ends) else segment_ends
    at = found["pos"].to_numpy()
    total, best = np.zeros((2, len(at)), np.int64)
    total[at], best[at] = found["total"].to_numpy(), found["best"].to_numpy()
    sizes = head["n_segments"].to_numpy()
    ends = np.cumsum(sizes)
    for name, values in (("n_best", best), ("count_sum", total)):
        running = np.concatenate([[0], np.cumsum(values[places])])
        per_segment = running[segment_ends] - running[segment_starts]
        running = np.concatenate([[0], np.cumsum(per_segment[refs])])
        head = head.append_column(name, pa.array(running[ends] - running[ends - sizes], pa.int64()))
    return head


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of every id pair, and whether no other pair of its B id has more."""
    posted = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    totals = stored(posted.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")), "pair-totals")
    b_id = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    top = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("top"))
    return totals.join(top, b_id == F.col("b_id")).select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def token_alignment(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum.

    n_best counts the links whose id pair is the most frequent of its B id, ties
    included; count_sum adds the corpus-wide counts of the links' pairs.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = type_of(documents, id_col)
    arrow = to_arrow_type(documents.schema[id_col].dataType)
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = stored(texts.mapInArrow(_blocks(a_path, b_path, arrow), BLOCKS), "token-pairs", **ROW_GROUPS)
    counts = stored(pair_counts(blocks), "pair-counts")
    places = blocks.where("pairs is not null").select("block", "first", F.posexplode("pairs").alias("pos", "pair"))
    found = places.join(counts, "pair").select("block", (F.col("first") + F.col("pos")).alias("pos"), "total", "best")
    heads = blocks.where("data is not null").select(F.col("block").alias("of"), "part", "first", "data")
    made = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in HEAD)
    return (
        heads.groupBy("of")
        .cogroup(found.groupBy("block"))
        .applyInArrow(_per_document, f"id {kind}, {made}, n_best long, count_sum long")
    )


def token_links(
    documents: DataFrame, a_path: str, b_path: str, kind: str = "end", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, a, b, a_id, b_id, bytes): linked tokens of every text, by their numbers from 0 and their ids.

    `kind` is "overlap" (tokens that share bytes, and how many), "end" (those of them
    that end together) or "group" (all pairs of one group; bytes is null).
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"unknown kind of links: {kind}")
    id_kind = type_of(documents, id_col)

    def rows(ids: pa.Array, found: Aligned, i: np.ndarray, j: np.ndarray, shared: np.ndarray | None) -> pa.RecordBatch:
        doc = np.searchsorted(found.ends, found.ends_a[i])
        first_a, first_b = np.cumsum(found.n_a) - found.n_a, np.cumsum(found.n_b) - found.n_b
        columns = [i - first_a[doc], j - first_b[doc], found.a[i], found.b[j]]
        size = pa.nulls(len(i), pa.int64()) if shared is None else pa.array(shared, pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns), size], ["id", "a", "b", "a_id", "b_id", "bytes"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        for batch in pieces(batches, 1, TEXT_BYTES):
            batch = batch.filter(pc.greater(pc.binary_length(batch.column(1)), 0))
            found, ids = align([" " + t for t in batch.column(1).to_pylist()], tokenizers), batch.column(0)
            if kind == "group":
                a, b = groups(found)
                for first, part in product(a, transposed(b)):
                    i, j, _ = entries(part)
                    yield rows(ids, found, first + i, j, None)
                continue
            for i, j, shared in overlaps(found.ends_a, found.ends_b):
                if kind == "end":
                    ok = found.ends_a[i] == found.ends_b[j]
                    i, j, shared = i[ok], j[ok], shared[ok]
                yield rows(ids, found, i, j, shared)

    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(run, f"id {id_kind}, a long, b long, a_id long, b_id long, bytes long")
