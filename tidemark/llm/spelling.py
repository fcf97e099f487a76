"""Spelling variants: words that differ by one letter, found in a trie of letter-group counts.

A word has a vector of counts, one per group of letters: the most frequent letters are
groups of their own, the rest is the last. A trie arranges the words by successive counts.
One edit adds at most one to the counts and takes at most one away, so a depth-first search
carries the words that look for partners down the trie and spends, for each, a budget of one
surplus and one deficit. Nodes of few words are leaves; what arrives there is compared by
the rest of the vector, and what is left is verified letter by letter.

The top of the trie, the first groups' counts, divides the work: a subtrie and the words
that can reach it within the budget are one group of a Spark shuffle. A word looks into its
own subtrie and the greater ones in reach, so each pair is met once. The division goes down
until no subtrie has more than GROUP words; the words of those that still do are dealt into
chunks, each of which meets what looks into the subtrie and the words of the chunks before
it. Tasks return counts and best partners per word, not pairs.

Defined cases: null texts have no words, a null id reads as an empty one; repeated rows count
each; of near words with equal numbers the smallest in code-point order is the form; empty
tables and tables without frequent words give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GROUPS = 32
DEPTHS = (3, 5, 7, 9)  # groups in the key of a subtrie
GROUP = 1 << 16  # words of a subtrie in one place
LEAF = 32
COUNTED = 1 << 19  # different words a task counts before it writes them
VERIFIED = 1 << 18  # candidates verified at a time
WIDE = 64  # longer words are verified one by one


def lower_ascii(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWER)


def thinned(doc_id: str, run: str, every: int) -> str:
    """The run, without one letter if `every` divides its hash."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def _counter(min_chars: int, every: int) -> Callable:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found, n in Counter(RUN.findall(text)).items() if text else ():
                    if len(found) >= min_chars:
                        word = thinned(key or "", lower_ascii(found), every)
                        if len(word) >= min_chars:
                            counts[word] += n
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def frequent_words(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, every: int = 199
) -> DataFrame:
    """(word, n) of all words; `every` thins runs by a hash of id and run, 0 leaves them."""
    texts = documents.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    counts = texts.mapInArrow(_counter(min_chars, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def letter_groups(words: DataFrame) -> dict[str, int]:
    """Letters with their group. There are as many as the alphabet has, 90 at most for `frequent_words`."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    ranked = sorted(((-r["count"], r.letter) for r in letters.collect()))
    return {letter: min(i, GROUPS - 1) for i, (_, letter) in enumerate(ranked)}


def vectors(words: list[str], groups: dict[str, int]) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.fromiter(map(groups.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    cell = np.repeat(np.arange(len(words)), sizes) * GROUPS + at
    return np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def greater_prefixes(prefix: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The prefixes that sort after this one and lie within one surplus and one deficit."""
    out = []
    for i in range(len(prefix)):
        more = prefix[:i] + (prefix[i] + 1,) + prefix[i + 1 :]
        out.append(more)
        out += [more[:j] + (more[j] - 1,) + more[j + 1 :] for j in range(i + 1, len(prefix)) if more[j]]
    return out


def _prefix_name(prefix) -> str:
    return ",".join(map(str, prefix))


def _prefixes(groups: dict[str, int], depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column(0).to_pylist(), groups)[:, :depth]
            yield pa.RecordBatch.from_arrays([pa.array([_prefix_name(p) for p in found.tolist()], pa.string())], ["key"])

    return run


def _division(words: DataFrame, groups: dict[str, int]) -> tuple[int, dict[str, int]]:
    """(groups in the key, chunks of the subtries that are too large even so)."""
    for depth in DEPTHS:
        sizes = words.select("word").mapInArrow(_prefixes(groups, depth), "key string").groupBy("key").count()
        large = {r.key: -(-r["count"] // GROUP) for r in sizes.where(F.col("count") > GROUP).collect()}
        if not large:
            break
    return depth, large


def _routes(groups: dict[str, int], depth: int, chunks: dict[str, int]) -> Callable:
    """(subtrie, chunk, word, n, whether it is one of the subtrie's words there) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                owner, keys, parts, members = [], [], [], []
                words = batch.column(0).to_pylist()
                for i, prefix in enumerate(map(tuple, vectors(words, groups)[:, :depth].tolist())):
                    key = _prefix_name(prefix)
                    count = chunks.get(key, 1)
                    own = zlib.crc32(words[i].encode()) % count
                    targets = [(key, c, c == own) for c in range(own, count)]
                    for other in map(_prefix_name, greater_prefixes(prefix)):
                        targets += [(other, c, False) for c in range(chunks.get(other, 1))]
                    owner += [i] * len(targets)
                    for column, values in zip((keys, parts, members), zip(*targets, strict=True), strict=True):
                        column += values
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(parts, pa.int32()), *(c.take(at) for c in batch.columns), pa.array(members, pa.bool_())],
                    ["key", "chunk", "word", "n", "member"],
                )

    return run


def search(members: np.ndarray, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, probe) whose vectors differ by one surplus and one deficit at most, by depth-first search.

    `members` is sorted by its columns from the first on.
    """
    first = (0, 0, len(members), np.arange(len(probes)), np.zeros((2, len(probes)), np.int8))
    stack = [first]
    while stack:
        level, low, high, alive, spent = stack.pop()
        if not len(alive):
            continue
        if high - low <= LEAF or level == GROUPS:
            for at in range(low, high):
                rest = members[at, level:] - probes[alive, level:]
                size = rest.sum(1)
                surplus = np.abs(rest).sum(1)
                surplus += size
                surplus //= 2
                ok = (spent[0] + surplus <= 1) & (spent[1] + surplus - size <= 1)
                found = alive[ok]
                yield np.full(len(found), at), found
            continue
        column = members[low:high, level]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
        own = probes[alive, level]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            more = int(column[a]) - own
            now = spent + np.stack([np.maximum(more, 0), np.maximum(-more, 0)])
            ok = (now <= 1).all(0)
            stack.append((level + 1, low + a, low + b, alive[ok], now[:, ok].astype(np.int8)))


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def verified(words: list[str], letters: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j differ by one edit. `letters` holds the code points of words of up to WIDE letters."""
    swap = sizes[i] > sizes[j]
    short, long = np.where(swap, j, i), np.where(swap, i, j)
    more = sizes[long] - sizes[short]
    out = more <= 1
    wide = np.flatnonzero(out & (sizes[long] > WIDE))
    out[wide] = [one_edit(words[a], words[b]) for a, b in zip(short[wide].tolist(), long[wide].tolist(), strict=True)]
    for shift in (0, 1):
        at = np.flatnonzero((more == shift) & (sizes[long] <= WIDE))
        a, b = letters[short[at]], letters[long[at]]
        apart = a != b
        if shift == 0:
            out[at] = apart.sum(1) == 1
        else:
            seen = np.maximum.accumulate(apart, 1)  # from the first difference on
            out[at] = ~(seen[:, :-1] & (a[:, :-1] != b[:, 1:])).any(1)
    return out


def _partners(groups: dict[str, int]) -> Callable:
    """Per word of a subtrie and of those that look into it: near words and the best of them."""

    def run(group: pa.Table) -> pa.Table:
        words = group["word"].to_pylist()
        counts, member = group["n"].to_numpy(), group["member"].to_numpy(zero_copy_only=False)
        names, results = ["word", "n_near", "form_n", "form"], []
        if member.any() and len(words) > 1:
            found = vectors(words, groups)
            mine = np.flatnonzero(member)
            mine = mine[np.lexsort(found[mine].T[::-1])]
            sizes = np.array([len(w) for w in words], np.int64)
            letters = np.zeros((len(words), WIDE + 1), np.uint16)
            narrow = np.flatnonzero(sizes <= WIDE)
            points = np.fromiter(map(ord, chain.from_iterable(words[k] for k in narrow.tolist())), np.uint16)
            rows = np.repeat(narrow, sizes[narrow])
            letters[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes[narrow]) - sizes[narrow], sizes[narrow])] = points
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            # A word of the subtrie looks for those after it only.
            place = np.full(len(words), -1)
            place[mine] = np.arange(len(mine))

            def best(i: np.ndarray, j: np.ndarray) -> pa.Table:
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
                order = np.lexsort((rank[j], -counts[j], i))
                i, j = i[order], j[order]
                heads = np.flatnonzero(np.diff(i, prepend=-1))
                near = np.diff(heads, append=len(i))
                column = group["word"].combine_chunks()
                return pa.table(
                    [column.take(pa.array(i[heads])), pa.array(near, pa.int64()), pa.array(counts[j[heads]], pa.int64()), column.take(pa.array(j[heads]))], names
                )

            held, size = [], 0
            pairs = search(found[mine], found)
            while True:
                pair = next(pairs, None)
                if pair is not None:
                    at, probe = pair
                    ok = place[probe] < at
                    held.append((mine[at[ok]], probe[ok]))
                    size += int(ok.sum())
                if held and (pair is None or size >= VERIFIED):
                    i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                    for k in range(0, len(i), VERIFIED):
                        good = verified(words, letters, sizes, i[k : k + VERIFIED], j[k : k + VERIFIED])
                        if good.any():
                            results.append(best(i[k : k + VERIFIED][good], j[k : k + VERIFIED][good]))
                    held, size = [], 0
                if pair is None:
                    break
        empty = pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], names)
        return pa.concat_tables([empty, *results])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near ones; the form is the most frequent of them."""
    groups = letter_groups(words)
    depth, chunks = _division(words, groups)
    routed = words.select("word", "n").mapInArrow(
        _routes(groups, depth, chunks), "key string, chunk int, word string, n long, member boolean"
    )
    found = routed.groupBy("key", "chunk").applyInArrow(_partners(groups), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all (word, n).

    The form of a word is its near word of the largest n, if that is at least `ratio` times
    its own; the root is where the forms of forms end. Numbers grow along them, so there is
    no circle, and a chain has few links.
    """
    words = stored(words, "words")
    near = stored(near_words(words), "near-words")
    joined = words.join(near, "word", "left")
    formed = F.col("form_n") >= ratio * F.col("n")
    result = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("form")).alias("form"),
            F.when(formed, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = stored(result.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("after"))
        further = roots.join(nexts, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved"))
        further = stored(further, "roots")
        moved = further.where("moved").limit(1).count()
        roots = further.select("word", "root")
        if not moved:
            break
    return result.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
