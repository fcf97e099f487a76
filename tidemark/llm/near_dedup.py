"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. A document is the set of its distinct word shingles. Equal sets are one class,
   found by a digest, so copies are never compared.
2. Every class has a MinHash signature. Equal bands of it make candidates: `bands`
   and `rows` miss a pair at the threshold with a chance below `miss`.
3. In a bucket all members are compared with one of them. Signatures are compared
   batch by batch (one byte per hash); after each batch the posterior chance that
   the similarity reaches the threshold is bounded from the matches so far, and
   the pair is dropped if it is below `miss`. Survivors are verified on full sets.
4. Links give components. Members of one component need no more comparisons, so
   what is left of a bucket is its members outside its main component against all
   of it. That is done in chunks: a task holds a hundred signatures against a
   thousand and returns the survivors, which are verified as before. As members of
   such buckets are alike, more hashes tell the posterior apart, and a pair is
   returned only by the first bucket that holds both.

So the pairs of a group of near copies are never emitted, and nothing is capped:
a bucket of any size is compared to the end. Minima per bucket are combined before
the shuffle; large buckets meet in joins, which Spark splits.

Defined cases: null, empty and blank texts have no shingles and no links; rows
with equal id and text are one document and get the same answer; of several rows
with the smallest id of a component the one with the smallest text key is kept;
null ids come after all others; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, packed, pieces, same, stored, text_key, type_of

BATCH = 30  # hashes compared between two decisions
LARGE, SMALL = 1024, 128  # rows of the chunks compared at once
WORDS = 1 << 18  # word hashes a task remembers
MORE = 1020  # further hashes of texts in large buckets, for a second look


def plan_bands(threshold: float, rows: int, miss: float) -> int:
    """Bands needed so that a pair at the threshold is missed with a chance of at most `miss`."""
    return ceil(log(miss) / log(1 - threshold**rows))


def fewest_matches(threshold: float, hashes: int, miss: float) -> list[int]:
    """Per batch: with fewer matches the chance of reaching the threshold is below `miss`.

    With a uniform prior, m matches of k leave a Beta(m + 1, k - m + 1) posterior;
    its tail above t is the chance of at most m successes in k + 1 trials of t.
    One byte per hash matches by accident once in 256 times.
    """
    t = threshold + (1 - threshold) / 256
    bounds = []
    for k in range(BATCH, hashes + 1, BATCH):
        chance, m = 0.0, 0
        while True:
            ways = lgamma(k + 2) - lgamma(m + 1) - lgamma(k + 2 - m)
            chance += exp(ways + m * log(t) + (k + 1 - m) * log(1 - t))
            if chance >= miss:
                break
            m += 1
        bounds.append(m)
    return bounds


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, words: int):
        self._words, self._known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()
        known = self._known
        if len(known) > WORDS:
            known.clear()
        hashes = []
        for word in found:
            h = known.get(word)
            if h is None:
                h = known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        if not len(h):
            return h
        n = min(self._words, len(h))
        out = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15 + n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(31)
        return np.unique(out)


def least_hashes(found: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        least = np.minimum(least, ((low[i : i + 2048, None] ^ plus) * times).min(0))
    return least


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return (
        draw.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1),
        draw.integers(0, 2**32, count, dtype=np.uint32),
    )


def one_byte(least: np.ndarray) -> bytes:
    return (least >> np.uint32(13)).astype(np.uint8).tobytes()


def _signatures(words: int, hashes: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = hash_family(hashes, 7)
        mix = np.random.default_rng(8).integers(0, 2**62, rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        shingles = Shingler(words)
        for batch in pieces(batches, 2):
            counts, first, second, bands, bytes_ = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                counts.append(len(found))
                if not len(found):
                    first.append(None), second.append(None), bands.append(None), bytes_.append(None)
                    continue
                a, b = struct.unpack("<qq", hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = least_hashes(found, times, plus)
                band = (least.reshape(-1, rows).astype(np.uint64) + np.uint64(1)) * mix
                band = (band ^ (band >> np.uint64(29))).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                first.append(a), second.append(b)
                bands.append((band + np.arange(len(band), dtype=np.uint64)).view(np.int64))
                bytes_.append(one_byte(least))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(bytes_, pa.binary()),
                ],
                ["id", "text_key", "n_shingles", "s1", "s2", "bands", "signature"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _prune(bounds: list[int]):
    """Keeps (a, b) of the pairs whose signatures pass every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = np.arange(batch.num_rows)
            if len(alive):
                one, two = _matrix(batch.column(2)), _matrix(batch.column(3))
                matches = np.zeros(len(alive), np.int64)
                for i, least in enumerate(bounds):
                    part = slice(i * BATCH, (i + 1) * BATCH)
                    matches[alive] += (one[alive, part] == two[alive, part]).sum(1)
                    alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _chunk_pairs(bounds: list[int]):
    """Survivors of a small chunk against a large one, of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, few, many in zip(*batch.columns, strict=True):
                few, many = few.values, many.values
                a, ca, one = few.field(0).to_numpy(), few.field(1).to_numpy(), _matrix(few.field(2))
                b, cb, two = many.field(0).to_numpy(), many.field(1).to_numpy(), _matrix(many.field(2))
                x, y = np.nonzero(ca[:, None] != cb)
                matches = np.zeros(len(x), np.int32)
                for i, least in enumerate(bounds):
                    # Few pairs survive the first batch, so it is done for a slice of pairs at a time.
                    part = slice(i * BATCH, (i + 1) * BATCH)
                    left, right = one[:, part], two[:, part]
                    for s in range(0, len(x), 1 << 16):
                        at = slice(s, s + (1 << 16))
                        matches[at] += (left[x[at]] == right[y[at]]).sum(1, dtype=np.int32)
                    keep = matches >= least
                    x, y, matches = x[keep], y[keep], matches[keep]
                if len(x):
                    # Of all buckets that hold the pair the first returns it.
                    left = few.field(3).flatten().to_numpy().reshape(len(a), -1)[x]
                    shared = left == many.field(3).flatten().to_numpy().reshape(len(b), -1)[y]
                    first = left[np.arange(len(x)), shared.argmax(1)] == bucket.as_py()
                    x, y = x[first], y[first]
                low, high = np.minimum(a[x], b[y]), np.maximum(a[x], b[y])
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns[:2]], ["a", "b"])

    return run


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = 5,
    miss: float = 1e-6,
) -> DataFrame:
    """The documents' columns, n_shingles, component_id and kept.

    Texts are compared in lower case (A-Z) as sets of `words`-word shingles, split
    at ASCII white space; a shorter text is one shingle. Documents whose sets have
    at least `percent` per cent of their union in common are linked; `component_id`
    is the smallest id reachable and `kept` marks one document per component.
    """
    threshold = percent / 100
    bands = plan_bands(threshold, rows, miss)
    hashes = ceil(bands * rows / BATCH) * BATCH
    bands = hashes // rows
    bounds = fewest_matches(threshold, hashes, miss)
    long_bounds = fewest_matches(threshold, hashes + MORE, miss)
    made = ["n_shingles", "component_id", "kept"]

    texts = documents.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    kind = type_of(texts, "id")
    signed = stored(
        texts.mapInArrow(
            _signatures(words, hashes, rows),
            f"id {kind}, text_key long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary",
        ).withColumn("row", F.monotonically_increasing_id()),
        "signatures",
    )
    keys = signed.select("row", "id", "text_key", "n_shingles", "s1", "s2")
    classes = stored(keys.where("s1 is not null").groupBy("s1", "s2").agg(F.min("row").alias("node")), "classes")
    # One row per class from here on; copies come back at the end.
    reps = signed.join(classes.select(F.col("node").alias("row")), "row")

    entries = stored(reps.select("row", F.explode("bands").alias("bucket")), "buckets")
    hubs = entries.groupBy("bucket").agg(F.min("row").alias("hub"), F.count("*").alias("size")).where("size > 1")
    held = stored(entries.join(hubs, "bucket").select("bucket", "row", "hub", "size"), "bucket-members")
    pairs = held.where("row <> hub").select(F.col("hub").alias("a"), F.col("row").alias("b")).distinct()

    wanted = held.select("row").distinct()
    bytes_of = stored(
        signed.select("row", "id", "text_key", "signature", "bands").join(wanted, "row"), "candidate-signatures"
    )
    named = bytes_of.select("row", F.col("id").alias("c_id"), F.col("text_key").alias("c_key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, family = Shingler(words), hash_family(MORE, 9)
        for batch in pieces(batches, 1):
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            more = [one_byte(least_hashes(f, *family)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(more, pa.binary())],
                ["row", "set", "more"],
            )

    full = texts.join(named, texts["id"].eqNullSafe(named["c_id"]) & (texts["text_key"] == named["c_key"]))
    shingle_sets = stored(
        full.select("row", "text").mapInArrow(sets, "row long, set binary, more binary").dropDuplicates(["row"]), "shingle-sets"
    )

    def verified(candidates: DataFrame, label: str) -> DataFrame:
        one = shingle_sets.select(F.col("row").alias("a"), F.col("set").alias("x"))
        two = shingle_sets.select(F.col("row").alias("b"), F.col("set").alias("y"))
        return stored(
            candidates.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_exact(percent), "a long, b long"),
            label,
        )

    one = bytes_of.select(F.col("row").alias("a"), F.col("signature").alias("x"))
    two = bytes_of.select(F.col("row").alias("b"), F.col("signature").alias("y"))
    likely = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_prune(bounds), "a long, b long")
    links = verified(likely, "links")
    found = connected_components(links)

    # What is left: buckets whose members are in several components.
    labelled = held.where("size > 2").join(found.withColumnRenamed("node", "row"), "row", "left").select(
        "bucket", "row", "size", F.coalesce("component", "row").alias("component")
    )
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    mains = stored(
        parts.groupBy("bucket")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"), F.max("size").alias("size"))
        .where("n < size"),
        "open-buckets",
    )
    looks = bytes_of.join(shingle_sets.select("row", "more"), "row").select(
        "row", F.concat("signature", "more").alias("signature"), "bands"
    )
    open_ = (
        labelled.drop("size").join(mains, "bucket").join(looks, "row")
        .select("bucket", "main", "size", "n", "component", F.struct("row", "component", "signature", "bands").alias("member"))
    )
    spread = F.abs(F.xxhash64("member.row"))
    few = (
        open_.where("component <> main")
        .groupBy("bucket", (spread % F.ceil((F.col("size") - F.col("n")) / SMALL)).alias("part"))
        .agg(F.collect_list("member").alias("few")).drop("part")
    )
    many = open_.groupBy("bucket", (spread % F.ceil(F.col("size") / LARGE)).alias("part")).agg(
        F.collect_list("member").alias("many")
    )
    more = (
        few.join(many.drop("part"), "bucket").select("bucket", "few", "many")
        .mapInArrow(_chunk_pairs(long_bounds), "a long, b long").distinct()
    )
    links = links.unionByName(verified(more.join(pairs, ["a", "b"], "left_anti"), "links"))

    labels = connected_components(links)
    members = keys.join(classes, ["s1", "s2"], "left")
    answer = stored(
        members.join(labels, "node", "left").select(
            "id", "text_key", "n_shingles", F.coalesce("component", "node", "row").alias("component")
        ),
        "near-components",
    )
    first = answer.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("least"))
    answer = (
        answer.join(first, "component")
        .groupBy("id", "text_key").agg(F.first("n_shingles").alias("n_shingles"), F.min("least").alias("least"))
        .select(
            "id", "text_key", "n_shingles", F.col("least.id").alias("component_id"),
            (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.text_key"))).alias("kept"),
        )
    )
    left = packed(documents, made, id=id_col, text_key=text_key(text_col))
    return left.join(answer, same(left, answer, ["id", "text_key"])).select("row.*", *made)
