"""Language identification of words, spans and documents.

A word is a letter and the letters and marks after it. Its script, from ranges of code points,
narrows the languages to those that training has seen in that script; each of
them scores the word by its letter triples, word edges included. A Viterbi pass
over the words of a text, with a penalty for a change of language, labels spans;
the language with most letters is the document's and its share of the letters
the score.

The model is a table of log probabilities, `BUCKETS` hashed triples x languages.
Its counts are made over all training rows, combined per task and then per
(language, triple), so at most BUCKETS x languages numbers reach the driver;
more than `MAX_LANGUAGES` languages are refused.

Defined cases: null, empty and letterless texts (marks alone are no letters) are
`und` with score 0 and no spans; words in a script that no language was seen in are open to all languages
and weigh the same for all; ties go to the language first in order; without
training rows every text is `und`; repeated rows are labelled alike. Other
columns are carried along.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, pieces, schema_with

BUCKETS = 1 << 16
MAX_LANGUAGES = 500
UNKNOWN = "und"
CHUNK = 1 << 19  # letters labelled at a time

# Ranges of code points by script, from the Unicode standard; everything else is script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Is a code point a letter; a mark; and its script. Beyond the second plane, letters are what a script lists."""
    scripts = np.zeros(0x110000, np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for low, high in ranges:
            scripts[low : high + 1] = number
    letters = scripts > 0
    known = 0x20000
    letters[:known] = np.fromiter((chr(c).isalpha() for c in range(known)), bool, known)
    marks = np.zeros(0x110000, bool)
    marks[[c for c in range(0x300, known) if unicodedata.category(chr(c))[0] == "M"]] = True
    return letters, marks, scripts


def _words(texts: list[str | None], tables: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Of many texts at once: triple bucket and word per letter; text, start, end and script per word."""
    letters, marks, scripts = tables
    # Lower case only where the length stays, so that places in the text stay.
    texts = [t or "" for t in texts]
    lower = [x if len(x := t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    joined = "\n" + "\n".join(lower) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters[code]
    mark = np.flatnonzero(marks[code] & ~inside)
    if len(mark):
        # A mark belongs to a word if the nearest place before it without a mark is a letter.
        base = np.ones(len(code), bool)
        base[mark] = False
        nearest = np.maximum.accumulate(np.where(base, np.arange(len(code)), 0))
        inside[mark] = inside[nearest[mark]]
    at = np.flatnonzero(inside)
    begins = at[~inside[at - 1]]
    ends = at[~inside[at + 1]] + 1
    masked = np.where(inside, code, 0).astype(np.uint64)
    mixed = masked[at - 1] * np.uint64(0x9E3779B97F4A7C15) + masked[at] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + masked[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    bucket = (mixed >> np.uint64(48)).astype(np.int64)
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(starts, begins, "right") - 1
    first = np.searchsorted(at, begins)
    return bucket, first, owner, begins - starts[owner], ends - starts[owner], scripts[code[begins]]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples and letters by script per language, summed over the task."""
    width, tables = BUCKETS + len(SCRIPTS) + 1, _tables()
    sums: dict[str, np.ndarray] = {}
    for batch in pieces(batches, 0):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for low, high in _chunks(texts):
            bucket, first, owner, start, end, script = _words(texts[low:high], tables)
            names, lang = np.unique(np.array(langs[low:high], object), return_inverse=True)
            size = end - start
            for k, name in enumerate(names):
                chosen = lang[owner] == k
                total = sums.setdefault(name, np.zeros(width, np.int64))
                total[:BUCKETS] += np.bincount(bucket[np.repeat(chosen, size)], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(script[chosen], size[chosen], len(SCRIPTS) + 1).astype(np.int64)
    for name, total in sums.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used])],
            ["lang", "feature", "n"],
        )


class LanguageModel:
    """Log probabilities of triples (buckets x languages) and the languages of each script."""

    def __init__(self, languages: list[str], scores: np.ndarray, scripts: np.ndarray):
        self.languages, self.scores, self.scripts = languages, scores, scripts


def train(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", rare_script: float = 0.001) -> LanguageModel:
    """Learns from all rows with a text and a language.

    A language counts as written in a script if at least `rare_script` of its
    letters are.
    """
    counts = (
        documents.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(_count, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
    )
    rows = counts.toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} are supported")
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    where = {n: i for i, n in enumerate(names)}
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(names)))
    table[rows["feature"].to_numpy(), [where[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    triples = table[:BUCKETS] + 0.5
    scores = np.log(triples / triples.sum(0))
    letters = table[BUCKETS:]
    return LanguageModel(names, scores.astype(np.float32), letters >= np.maximum(1, rare_script * letters.sum(0)))


def _viterbi(emit: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; all texts advance together, one word a step.

    `emit` holds the words of the texts one after another; text i has count[i]
    words from first[i].
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    back = np.zeros(emit.shape, np.uint16)
    path = np.zeros(len(emit), np.uint16)
    best = np.zeros((len(count), emit.shape[1]), np.float32)
    active = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")
    for step, n in enumerate(active.tolist()):
        words = first[:n] + step
        if step:
            before = best[:n]
            top = before.argmax(1)
            change = before[np.arange(n), top] - np.float32(penalty)
            stay = before >= change[:, None]
            back[words] = np.where(stay, np.arange(emit.shape[1]), top[:, None])
            best[:n] = np.where(stay, before, change[:, None]) + emit[words]
        else:
            best[:n] = emit[words]
    label = best.argmax(1)
    for step in range(len(active) - 1, -1, -1):
        n = int(active[step])
        words = first[:n] + step
        path[words] = label[:n]
        label[:n] = back[words, label[:n]]
    return path


def _labels(model: tuple, tables: tuple, texts: list[str | None], penalty: float):
    """Per text: language, score, spans (start, end, language number)."""
    languages, table, scripts = model
    bucket, first, owner, start, end, script = _words(texts, tables)
    n, k = len(texts), len(languages)
    langs, scores, spans = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
    if not len(owner) or not k:
        return langs, scores, spans
    emit = np.add.reduceat(table[bucket], first, 0)
    known = scripts[script]
    known[~known.any(1)] = True
    # A language outside the script is as unlikely as the worst candidate and the penalty twice.
    emit = np.where(known, emit, emit.min(1, keepdims=True) - 2 * np.float32(penalty))
    emit -= emit.max(1, keepdims=True)
    count = np.bincount(owner, minlength=n)
    begin = np.cumsum(count) - count
    used = np.flatnonzero(count)
    path = _viterbi(emit, begin[used], count[used], penalty)
    share = np.zeros((n, k))
    np.add.at(share, (owner, path), end - start)
    total = share.sum(1)
    top = share.argmax(1)
    cut = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | (np.diff(path.astype(int), prepend=-1) != 0))
    last = np.append(cut[1:], len(owner)) - 1
    for i, a, b, lang in zip(owner[cut].tolist(), start[cut].tolist(), end[last].tolist(), path[cut].tolist(), strict=True):
        spans[i].append({"start": a, "end": b, "lang": languages[lang]})
    for i in used.tolist():
        langs[i], scores[i] = languages[top[i]], float(share[i, top[i]] / total[i])
    return langs, scores, spans


def identify(
    documents: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = 8.0, spans: bool = True
) -> DataFrame:
    """The documents with `lang_pred`, `score` (share of letters) and `lang_spans` (start, end, lang; in characters)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.scripts))
    rows = packed(documents, ["lang_pred", "score", "lang_spans"]).select("row.*")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            langs, scores, marks = [], [], []
            for low, high in _chunks(texts):
                a, b, c = _labels(shared.value, tables, texts[low:high], penalty)
                langs, scores = langs + a, scores + b
                marks += c if spans else [None] * len(a)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(marks, kind)],
                [*batch.schema.names, "lang_pred", "score", "lang_spans"],
            )

    return rows.mapInArrow(
        run,
        schema_with(
            rows.schema, lang_pred="string", score="double", lang_spans="array<struct<start:int,end:int,lang:string>>"
        ),
    )
