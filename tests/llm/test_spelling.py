"""Spelling variants against a plain version."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from tidemark.llm import spelling


def corpus(seed: int) -> list[tuple]:
    """Texts of frequent words with rare variants, anagrams, long runs and chains of forms."""
    draw = random.Random(seed)
    base = ["".join(draw.choices("abcdeé", k=draw.randint(6, 9))) for _ in range(60)] + ["x" * 70, "y" * 65 + "z", "ÀÿÖ×÷abc"]
    words = []
    for k, w in enumerate(base):
        words += [w] * (5 + 7 * (k % 23))
        for _ in range(4):
            at, letter = draw.randrange(len(w)), draw.choice("abcdeé")
            variant = draw.choice([w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :], "".join(draw.sample(w, len(w)))])
            words += [variant if draw.random() < 0.8 else variant.upper()] * draw.choice([1, 3, 5, 6, 40])
    for n, w in ((6, "chainedw"), (60, "chainedwo"), (600, "chainedwor")):
        words += [w] * n
    draw.shuffle(words)
    rows = [(i, " ".join(words[i::90]) + ",\n7") for i in range(90)]
    return rows + [(None, " ".join(base)), (7, rows[7][1]), (500, None), (501, ""), (502, "12 34 漢字"), (503, "short"), (None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_spelling(spark, monkeypatch, small):
    if small:
        for name, value in (("GROUP", 6), ("LEAF", 1), ("COUNTED", 9), ("VERIFIED", 5), ("WIDE", 8), ("DEPTHS", (1, 2))):
            monkeypatch.setattr(spelling, name, value)
    rows = corpus(3)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string").repartition(3)
    for every in (199, 3):
        wanted = brute.spelling(*zip(*rows, strict=True), every)
        assert sum(w[4] for w in wanted) > 60 and (every == 3 or any(w[1] and w[1] != w[2] for w in wanted))
        found = spelling.spelling_variants(spelling.frequent_words(frame, every=every))
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert Counter(map(tuple, found.collect())) == Counter(wanted)
    assert spelling.spelling_variants(spelling.frequent_words(frame.limit(0))).count() == 0


def test_odd_rows(spark, documents, rows):
    found = spelling.spelling_variants(spelling.frequent_words(documents))
    assert Counter(map(tuple, found.collect())) == Counter(brute.spelling(*zip(*rows, strict=True)))


def test_one_edit():
    draw = random.Random(1)
    words = ["".join(draw.choices("ab", k=draw.randint(1, 5))) for _ in range(150)]
    sizes = np.array([len(w) for w in words])
    letters = np.zeros((len(words), spelling.WIDE + 1), np.uint16)
    for k, w in enumerate(words):
        letters[k, : len(w)] = [ord(c) for c in w]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(150), np.arange(150)))
    edits = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + x :] for k in range(len(w) + 1) for c in "ab" for x in (0, 1)}
    reach = [edits(w) - {w} for w in words]
    wanted = [words[b] in reach[a] for a, b in zip(i, j, strict=True)]
    assert [spelling.one_edit(words[a], words[b]) for a, b in zip(i, j, strict=True)] == wanted
    assert spelling.verified(words, letters, sizes, i, j).tolist() == wanted


def test_prefixes():
    near = lambda p, q: sum(max(b - a, 0) for a, b in zip(p, q, strict=True)) <= 1 >= sum(max(a - b, 0) for a, b in zip(p, q, strict=True))
    cells = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    for p in cells:
        assert sorted(q for q in spelling.greater_prefixes(p) if max(q) < 4) == [q for q in cells if q > p and near(p, q)]
