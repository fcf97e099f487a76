"""Cross-entropy difference between a target and a background language model.

Both models are bigram models over one shared vocabulary: all distinct words in
lower case. Words and pairs of words are counted exactly, over all documents, and
nothing of the models has a fixed size.

Documents are cut into pieces of about `PIECE` bytes, which are stored as numbers
that stand for the piece's own words. Every distinct word of a piece is dealt to a
bucket, where it gets its number in the corpus and its counts, which go back to the
piece; then every distinct pair of numbers likewise. (Checksums only choose the
bucket.) So the most frequent word or pair is one entry a piece in its bucket, a
piece gets only the counts of what it holds, and no task or driver has a model.
There are as many buckets as the corpus needs for buckets of bounded size.

The probability of a word w after v interpolates with the unigram model,
(c(v, w) + A p(w)) / (c(v) + A), p(w) = (c(w) + 1) / (n + V), where V is the number
of distinct words. Background counts are scaled to the number of
target words, so that both models are smoothed alike. A document that a model was
trained on would look familiar to it, so each of its words is scored without its
own occurrence.

score = mean loss under the target model - mean loss under the background model;
the lower, the more like the target.

Defined cases: null, empty and blank texts have no tokens, and null losses and
score; with an empty target both models know the same of it, the target's being
uniform; ids repeated among the targets count once; rows with one id are all
target or all background; null ids are background; no rows give no rows. Other
columns are carried along.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, pieces, stored

PRIOR = 64.0  # A, in words
START = 0  # stands before the first word of a document; as a word it is ""
PIECE = 10 << 20  # bytes of text
LEVEL = 3  # of compression
BUCKET_WORDS = 1 << 19  # distinct words of pieces in a bucket, about
BUCKET_PAIRS = 1 << 21
BUCKETS = 4  # buckets a shuffle partition, at least
BROADCAST_BYTES = 32 << 20


class Tokens:
    """Numbers of the words of texts, in the order of their first occurrence."""

    def __init__(self):
        self.known: dict[str, int] = {"": START}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per text, numbers, numbers before them, pairs), the texts one after another."""
        known, ids, counts = self.known, [], []
        for text in texts:
            words = (text or "").lower().split()
            counts.append(len(words))
            ids.extend([known.setdefault(word, len(known)) for word in words])
        ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
        before = words_before(ids, counts)
        return counts, ids, before, before << 32 | ids


def words_before(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return before


def pack(*columns: np.ndarray) -> bytes:
    """Columns of natural numbers, of one length, in as few bytes each as the largest needs."""
    table = np.array(columns, np.uint64)
    width = 8 if table.size and table.max() >= 2**32 else 4
    table = table.astype(f"<u{width}")
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(columns), -1, width).transpose(0, 2, 1))
    head = np.array([len(columns), width, planes.size], "<i8").tobytes()
    return head + pa.Codec("zstd", LEVEL).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    columns, width, size = np.frombuffer(data, "<i8", 3).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[24:], size, asbytes=True), np.uint8)
    planes = np.ascontiguousarray(planes.reshape(columns, width, -1).transpose(0, 2, 1))
    return planes.view(f"<u{width}").reshape(columns, -1).astype(np.int64)


PIECES = (
    "piece binary, n long, n_target long, n_words long, keys binary, docs binary, ids binary, hashes binary, "
    "words binary, counts binary"
)
BLOBS = "piece binary, bucket int, kind int, vocabulary long, blob binary"


def _table(kind: str, columns: dict[str, list]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) for n, t in fields], [n for n, _ in fields])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents (key, text, target)."""
    def piece() -> pa.RecordBatch:
        counts, ids, before = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
        flags = np.concatenate(flagged)
        mine, n = np.repeat(flags, counts), len(tokens.known)
        words = [w.encode() for w in tokens.known]
        sums = [np.bincount(x, minlength=n) for x in (ids, ids[mine], before, before[mine])]
        text = b"\n".join(words)  # no word holds white space
        row = {
            "piece": uuid.uuid4().bytes, "n": len(ids), "n_target": int(mine.sum()), "n_words": n, "keys": b"".join(keys),
            "docs": pack(counts, flags), "ids": pack(ids), "hashes": pack(np.fromiter(map(zlib.crc32, words), np.int64, n)),
            "words": np.int64(len(text)).tobytes() + pa.Codec("zstd", LEVEL).compress(text, asbytes=True), "counts": pack(*sums),
        }
        return _table(PIECES, {k: [v] for k, v in row.items()})

    tokens, held, keys, flagged, size = Tokens(), [], [], [], 0
    for batch in pieces(batches, 1, 1 << 20):
        texts = batch.column(1).to_pylist()
        held.append(tokens(texts)[:3])
        keys += batch.column(0).to_pylist()
        flagged.append(np.array(batch.column(2).to_pylist(), bool))
        size += sum(len(t or "") for t in texts)
        if size >= PIECE:
            yield piece()
            tokens, held, keys, flagged, size = Tokens(), [], [], [], 0
    if keys:
        yield piece()


def _dealt(bucket: np.ndarray, by: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of every bucket that occurs, the places ordered by `by`."""
    order = np.argsort(bucket, kind="stable") if by is None else np.lexsort((by, bucket))
    values, starts = np.unique(bucket[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, starts[1:]), strict=True)


def _deal_words(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, hashes, words, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                size = int(np.frombuffer(words, np.int64, 1)[0])
                words = pa.Codec("zstd").decompress(words[8:], size, asbytes=True).split(b"\n")
                counts, parts = unpack(counts), list(_dealt(unpack(hashes)[0] % buckets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([piece] * len(parts), pa.binary()),
                        pa.array([b for b, _ in parts], pa.int32()),
                        pa.array([b"\n".join([words[i] for i in x.tolist()]) for _, x in parts], pa.binary()),
                        pa.array([pack(*counts[:, x]) for _, x in parts], pa.binary()),
                    ],
                    ["piece", "bucket", "words", "counts"],
                )

    return run


def _back(group: pa.Table, kind: int, lengths: list[int], found: np.ndarray, vocabulary: int = 0) -> pa.Table:
    """What a bucket found, cut as its rows came and sent to their pieces."""
    parts = np.split(found, np.cumsum(lengths)[:-1], axis=1)
    n = len(parts)
    columns = {"piece": group["piece"].to_pylist(), "bucket": group["bucket"].to_pylist(), "kind": [kind] * n}
    columns |= {"vocabulary": [vocabulary] + [0] * (n - 1), "blob": [pack(*x) for x in parts]}
    return pa.Table.from_batches([_table(BLOBS, columns)])


def _count_words(buckets: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """Number and counts of the bucket's words: as word (all, target), as word before (all, target)."""
        counts = [unpack(x) for x in group["counts"].to_pylist()]
        words = pa.concat_arrays([pa.array(x.split(b"\n"), pa.binary()) for x in group["words"].to_pylist()]).dictionary_encode()
        index, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        sums = np.zeros((4, n), np.int64)
        for total, each in zip(sums, np.concatenate(counts, axis=1), strict=True):
            np.add.at(total, index, each)
        numbers = index * buckets + group["bucket"][0].as_py()
        real = n - words.dictionary.to_pylist().count(b"")
        return _back(group, 0, [x.shape[1] for x in counts], np.vstack([numbers, sums[:, index]]), real)

    return run


def _of_piece(row: dict) -> tuple:
    """(words per document, flags, ids, before, distinct pairs as words before and words, place of every token's pair)."""
    counts, flags = unpack(row["docs"])
    ids = unpack(row["ids"])[0]
    before = words_before(ids, counts)
    pairs, place = np.unique(before << 32 | ids, return_inverse=True)
    return counts, flags.astype(bool), ids, before, pairs >> 32, pairs & 0xFFFFFFFF, place


def _pair_buckets(hashes: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    mixed = hashes[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hashes[second].astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _known(hashes: np.ndarray, blobs: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    """What came back of the piece's words."""
    return _joined(hashes % buckets, blobs, 5)


def _joined(bucket: np.ndarray, blobs: list[tuple[int, bytes]], rows: int, by: np.ndarray | None = None) -> np.ndarray:
    found, blobs = np.empty((rows, len(bucket)), np.int64), dict(blobs)
    for b, places in _dealt(bucket, by):
        found[:, places] = unpack(blobs.pop(b))
    assert not blobs
    return found


def _blobs(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(b, x) for b, k, x in zip(*(table[c].to_pylist() for c in ("bucket", "kind", "blob")), strict=True) if k == kind]


def _deal_pairs(word_buckets: int, buckets: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        counts, flags, _, _, first, second, place = _of_piece(row)
        hashes = unpack(row["hashes"])[0]
        numbers = _known(hashes, _blobs(right, 0), word_buckets)[0]
        mine = np.repeat(flags, counts)
        n = [np.bincount(x, minlength=len(first)) for x in (place, place[mine])]
        columns = np.vstack([numbers[first], numbers[second], *n])
        # In the order of the first words, of which only the steps are sent.
        parts = list(_dealt(_pair_buckets(hashes, first, second, buckets), numbers[first])) if len(first) else []
        steps = [np.diff(columns[0, x], prepend=0) for _, x in parts]
        return pa.table(
            {
                "piece": pa.array([row["piece"]] * len(parts), pa.binary()),
                "bucket": pa.array([b for b, _ in parts], pa.int32()),
                "pairs": pa.array([pack(d, *columns[1:, x]) for d, (_, x) in zip(steps, parts, strict=True)], pa.binary()),
            }
        )

    return run


def _count_pairs(group: pa.Table) -> pa.Table:
    """Counts of the bucket's pairs: all, target."""
    parts = [unpack(x) for x in group["pairs"].to_pylist()]
    for x in parts:
        np.cumsum(x[0], out=x[0])
    lengths = [x.shape[1] for x in parts]
    first, second, *counts = np.concatenate(parts, axis=1)
    del parts
    if max(first.max(), second.max()) >= 2**32:
        first, second = (np.unique(x, return_inverse=True)[1] for x in (first, second))
    keys = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    distinct, index = np.unique(keys, return_inverse=True)
    sums = np.zeros((2, len(distinct)), np.int64)
    for total, each in zip(sums, counts, strict=True):
        np.add.at(total, index, each)
    return _back(group, 1, lengths, sums[:, index])


def losses(
    word: np.ndarray, pair: np.ndarray, context: np.ndarray, n: int, size: int, scale: float, own: np.ndarray
) -> np.ndarray:
    """-log p of every word; counts are scaled, and `own` (0 or 1) taken off where the word was counted itself."""
    unigram = ((word - own) * scale + 1) / ((n - own) * scale + size)
    return -np.log(((pair - own) * scale + PRIOR * unigram) / ((context - own) * scale + PRIOR))


SCORES = "key binary, target boolean, n_tokens long, target_loss double, background_loss double"


def _score(word_buckets: int, pair_buckets: int, n: int, n_target: int, size: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        counts, flags, ids, before, first, second, place = _of_piece(row)
        hashes = unpack(row["hashes"])[0]
        numbers, words, words_target, contexts, contexts_target = _known(hashes, _blobs(right, 0), word_buckets)
        dealt = _pair_buckets(hashes, first, second, pair_buckets)
        pairs, pairs_target = _joined(dealt, _blobs(right, 1), 2, numbers[first])
        own = np.repeat(flags, counts).astype(np.float64)
        target = losses(words_target[ids], pairs_target[place], contexts_target[before], n_target, size, 1.0, own)
        scale = n_target / n if n_target else 1.0
        background = losses(words[ids], pairs[place], contexts[before], n, size, scale, np.ones(len(ids)))
        means = np.full((2, len(counts)), np.nan)
        used = np.flatnonzero(counts)
        if len(used):
            starts = (np.cumsum(counts) - counts)[used]
            means[:, used] = [np.add.reduceat(x, starts) / counts[used] for x in (target, background)]
        keys, none = row["keys"], counts == 0
        return pa.table(
            {
                "key": pa.array([keys[i : i + 32] for i in range(0, len(keys), 32)], pa.binary()),
                "target": pa.array(flags),
                "n_tokens": pa.array(counts),
                "target_loss": pa.array(means[0], mask=none),
                "background_loss": pa.array(means[1], mask=none),
            }
        )

    return run


def score(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns, n_tokens, target_loss, background_loss and score.

    `targets` has one column, the ids of the target documents; the background is
    all documents. The ids are broadcast if they take `BROADCAST_BYTES` at most.
    """
    spark = documents.sparkSession
    made = ["n_tokens", "target_loss", "background_loss", "score"]
    wanted = targets.select(F.col(targets.columns[0]).alias("wanted")).where("wanted is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length(F.col("wanted").cast("string")).cast("long") + 32)).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    rows = packed(documents, made, id=id_col, text=text_col).join(wanted, F.col("id") == F.col("wanted"), "left")
    # Rows with one text and flag have one score; so scores are found again by a digest of the text.
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = rows.select("row", "text", F.col("wanted").isNotNull().alias("is_target"), key.alias("text_digest"))
    cut = stored(rows.select("text_digest", "text", "is_target").mapInArrow(_cut, PIECES), "lm-pieces")
    total = cut.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_target", "n_words"))).first()
    n, n_target, n_words = map(int, total)
    least = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets, pair_buckets = max(least, n_words // BUCKET_WORDS), max(least, n // BUCKET_PAIRS)
    words = cut.select("piece", "hashes", "words", "counts").mapInArrow(
        _deal_words(word_buckets), "piece binary, bucket int, words binary, counts binary"
    )
    words = stored(words.groupBy("bucket").applyInArrow(_count_words(word_buckets), BLOBS), "lm-words")
    vocabulary = int(words.agg(F.sum("vocabulary")).first()[0] or 0)
    pairs = (
        cut.select("piece", "docs", "ids", "hashes").groupBy("piece").cogroup(words.groupBy("piece"))
        .applyInArrow(_deal_pairs(word_buckets, pair_buckets), "piece binary, bucket int, pairs binary")
        .groupBy("bucket").applyInArrow(_count_pairs, BLOBS)
    )
    scores = (
        cut.select("piece", "docs", "ids", "hashes", "keys").groupBy("piece").cogroup(words.unionByName(pairs).groupBy("piece"))
        .applyInArrow(_score(word_buckets, pair_buckets, n, n_target, vocabulary), SCORES)
        .groupBy(F.col("key").alias("of"), F.col("target").alias("flag"))
        .agg(*(F.first(c).alias(c) for c in ("n_tokens", "target_loss", "background_loss")))
    )
    # Stored, so that the join is a join of two plain inputs and a text with many copies can be split.
    scores = stored(scores, "lm-scores")
    found = rows.join(scores, (F.col("text_digest") == F.col("of")) & (F.col("is_target") == F.col("flag")))
    return found.select("row.*", *made[:3], (F.col("target_loss") - F.col("background_loss")).alias("score"))
