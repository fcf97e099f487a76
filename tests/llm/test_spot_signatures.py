"""Spot signatures against plain versions, on odd rows and small ranges."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from tidemark.llm import spot_signatures as spot


@pytest.mark.parametrize("small", [False, True])
def test_edited_likeness(spark, documents, empty, rows, monkeypatch, small):
    if small:
        for name, value in (("RANGE_BYTES", 6000), ("BATCH_BYTES", 900), ("BLOCK_WORDS", 50), ("COMPARE", 3)):
            monkeypatch.setattr(spot, name, value)
    more = [(1000, "漢字かな交じり文" * 5), (1001, "the the the"), (1002, "under_score x" * 40), (1003, "y" * 300), (1004, "the " * 4000)]
    frame = documents.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(*r, "x") for r in more], "doc_id long, text string, row string"))
    data = [(i, t or "") for i, t in rows + more]
    keys = {r.text or "": r.k for r in frame.selectExpr("text", "xxhash64(coalesce(text, '')) as k").collect()}
    order = sorted(range(len(data)), key=lambda n: (data[n][0] is not None, data[n][0] or 0, keys[data[n][1]]), reverse=True)
    anchors = brute.common_words([t for _, t in data])
    assert set(spot.common_words(frame)[0]) == anchors and anchors
    wanted = Counter()
    for place, n in enumerate(order):
        (i, text), other = data[n], data[order[(place + 1) % len(order)]][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + other[:cut]
        a, b, c = (brute.spots(t, anchors) for t in (text, new, other))
        wanted[(i, len(text), len(a), brute.sha(new.encode()), brute.jaccard(a, b), brute.jaccard(a, c))] += 1
    found = spot.edited_likeness(frame.repartition(3)).collect()
    assert Counter((r.id, r.n_chars, r.n_signatures, r.edited_sha256, r.near_edited, r.near_next) for r in found) == wanted
    assert all((r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1) for r in found)
    assert spot.edited_likeness(empty).count() == 0


def test_one_row(spark):
    frame = spark.createDataFrame([("b", "one two three four five six")], "name string, body string")
    row = spot.edited_likeness(frame, "name", "body").first()
    assert row.near_next == 1 and 0 <= row.near_edited < 1 and row.edited_sha256 == brute.sha(b"one two three four" + b"one two t"[:9])


def test_pruned_jaccard():
    draw = random.Random(4)
    for _ in range(400):
        a, b = (set(draw.sample(range(60), draw.randint(0, 40))) for _ in "ab")
        exact = brute.jaccard(a, b)
        x, y = (np.array(sorted(s), np.uint32) for s in (a, b))
        for least in (0.0, 0.3, 0.8, 1.0):
            assert spot.pruned_jaccard(x, y, least) == (exact if exact >= least else 0.0)


def test_length_parts():
    for least in (0.5, 0.8, 0.95):
        for n in range(1, 400):
            for m in range(n, 401):
                if n >= least * m:
                    assert spot.length_part(m, least) - spot.length_part(n, least) <= 1


def test_fingerprints(spark, documents, rows):
    anchors, size = spot.common_words(documents)
    assert size == sum(len((t or "").encode()) for _, t in rows)
    found = spot.fingerprints(documents, anchors)
    assert found.columns == [*documents.columns, "signatures"]
    got = Counter((r.doc_id, len(r.signatures)) for r in found.collect())
    assert got == Counter((i, len(brute.spots(t or "", set(anchors)))) for i, t in rows)
    assert spot.set_of(spot.fingerprint(np.array([1, 2**32 - 1], np.uint32))).tolist() == [1, 2**32 - 1]
