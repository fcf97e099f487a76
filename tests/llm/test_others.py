"""Language identification, pages and vectors."""

import base64
import hashlib
import random
from collections import Counter

import brute
import pytest

from tidemark.llm import language_id, vector_dedup, warc

GREEK, CYRILLIC = "αβγδεζηθικλμ", "абвгдежзиклм"


def text_in(letters: str, seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randint(3, 7))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    made = {"xa": "abcdefgh", "xb": "qrstuvwxyz", "el": GREEK, "ru": CYRILLIC}
    rows = [(text_in(letters, i, 120), lang) for lang, letters in made.items() for i in range(6)]
    rows += [(None, "xa"), ("words", None), ("", "xb")]
    return language_id.train(spark.createDataFrame(rows, "text string, lang string"))


def test_languages(spark, model, documents, empty):
    texts = [
        (1, text_in("abcdefgh", 99, 20), "xa"), (2, text_in(GREEK, 98, 5), "el"), (3, None, "und"), (4, "", "und"),
        (5, "12 34 !!", "und"), (7, "\u0301", "und"), (8, " \u0301\u0302, 5\u0940 ", "und"), (9, "\u0301a\u0301bc", "xa"), (6, text_in("qrstuvwxyz", 97, 9000), "xb"), (6, text_in("qrstuvwxyz", 97, 9000), "xb"),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string, score string")
    found = language_id.identify(frame, model).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in found) == Counter((i, w) for i, _, w in texts)
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") == (not r.lang_spans) for r in found)
    assert language_id.identify(documents, model).count() == documents.count()
    assert language_id.identify(empty, model).count() == 0


def test_mixed_spans(spark, model):
    parts = [text_in("abcdefgh", 1, 12), text_in("qrstuvwxyz", 2, 12), text_in(CYRILLIC, 3, 6), text_in("abcdefgh", 4, 12)]
    text = ", 7 ".join(parts)
    row = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(text[s.start : s.end], s.lang) for s in row.lang_spans] == list(zip(parts, ["xa", "xb", "ru", "xa"], strict=True))
    assert row.lang_pred == "xa" and 0.4 < row.score < 0.8


def test_labels_are_the_best_path(spark, model):
    """The labels of a text score as much as the best of all paths does, word by word."""
    scripts = [range_ for _, range_ in language_id.SCRIPTS]

    def script_of(code: int) -> int:
        return next((n for n, ranges in enumerate(scripts, 1) if any(a <= code <= b for a, b in ranges)), 0)

    draw, penalty = random.Random(5), 8.0
    letters = ["abcdefgh", "qrstuvwxyz", GREEK, CYRILLIC, "abqr\u0301xy", "אבגד", "abαбQ\u0301"]
    texts = []
    for i in range(60):
        parts = [text_in(draw.choice(letters), 1000 * i + k, draw.randint(1, 4)) for k in range(draw.randint(1, 6))]
        texts.append(draw.choice([" ", ", 7 ", "-", " \u0301 "]).join(parts))
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    switches = 0
    for row in language_id.identify(frame, model, penalty=penalty).collect():
        words = brute.letter_words(row.text)
        scores = brute.language_scores(row.text, model, script_of)
        spans = [(s.start, s.end, model.languages.index(s.lang)) for s in row.lang_spans]
        path = [next(k for a, b, k in spans if a <= w[0] and w[1] <= b) for w in words]
        changes = sum(a != b for a, b in zip(path, path[1:], strict=False))
        made = sum(s[k] for s, k in zip(scores, path, strict=True)) - penalty * changes
        assert abs(made - brute.best_path(scores, penalty)) < 1e-3 * (1 + len(words))
        switches += changes
    assert switches > 30


def test_without_training(spark, documents):
    model = language_id.train(documents)
    assert model.languages == []
    assert {r.lang_pred for r in language_id.identify(documents, model).select("lang_pred").collect()} == {"und"}


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op4_language_id

    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = [r for r in op4_language_id(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert len(found) > 40 and sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.97 * len(found)


def pages_of(spark):
    html = ["<p>one</p>", "<p>two ünï\r\n\r\nWARC/1.1\r\n</p>", "", None, "x" * 100_000]
    rows = [(i, f"http://a.example/{i}", html[i % 5]) for i in range(40)] + [(100, None, "only"), (101, "http://b/ a\n\x7fb", "only too")]
    rows += [(None, "http://n", "<p>one</p>"), (200, "u", "twice"), (200, "u", "twice"), (200, "u", "other")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def expected(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = Counter()
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        largest = max(ids, key=lambda x: (x is not None, x or 0))
        responses = 0
        for i in ids:
            first = i == largest and not responses
            responses += first
            out[(None if i is None else str(i), len(payload), digest, "response" if first else "revisit", None if first else str(largest))] += 1
    return out


def test_warc_round_trip(spark, tmp_path):
    rows, pages = pages_of(spark)
    made = []
    for name in ("a", "b"):
        manifest = warc.write_warc(pages, str(tmp_path / name), roll_bytes=300)
        made.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in manifest.collect()))
        assert {p.name for p in (tmp_path / name).glob("*.warc.gz")} == {x[0] for x in made[-1]}
        assert not list((tmp_path / name / ".temporary").iterdir())
    assert made[0] == made[1] and len(made[0]) > 3
    for name, _, size, sha in made[0]:
        data = (tmp_path / "a" / name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, sha)
    records = warc.read_warc(spark, str(tmp_path / "a"), manifest).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == expected(rows)
    payload = {(str(i), (html or "").encode()) for i, _, html in rows if i is not None}
    assert all((r.page_id, bytes(r.payload)) in payload for r in records if r.payload is not None and r.page_id)
    assert {r.url for r in records} >= {None, "http://b/%20a%0A%7Fb", "http://a.example/0"}


def test_warc_minimum(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, str(tmp_path / "a"), min_revisit_bytes=3)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(spark, str(tmp_path / "a"), manifest).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_warc_empty(spark, tmp_path):
    _, pages = pages_of(spark)
    manifest = warc.write_warc(pages.limit(0), str(tmp_path / "a"))
    assert warc.read_warc(spark, str(tmp_path / "a"), manifest).count() == 0


def vector_rows(n: int = 260, length: int = 12) -> list[tuple]:
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(length)] for _ in range(6)]
    rows = []
    for i in range(n):
        spread = draw.choice([0.0, 0.05, 0.2, 0.35])
        rows.append((i, [c + draw.gauss(0, spread) for c in centres[i % 6]] if i % 5 else [draw.gauss(0, 1) for _ in range(length)]))
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * length, [1.0] * (length - 1) + [None], [inf] + [1.0] * (length - 1), [nan] * length, [1.0] * 3, [2.0] * 3, [5.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(1100 + i, rows[7][1]) for i in range(5)] + [(7, rows[7][1]), (None, rows[8][1]), (None, [3.0, -1.0])]
    rows += [(1200, [-0.0, 1.0, 0.0, 0.0]), (1201, [0.0, 1.0, -0.0, 0.0])]
    return rows


@pytest.mark.parametrize("block, tile", [(256, 4096), (4, 16)])
def test_vectors(spark, monkeypatch, block, tile):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    monkeypatch.setattr(vector_dedup, "DIGIT", 2 if tile == 16 else 6)
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, v string, node string")
    found = vector_dedup.near_vectors(frame.repartition(5))
    wanted = brute.vectors(*zip(*rows, strict=True))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == Counter(
        (i, *x) for (i, _), x in zip(rows, wanted, strict=True)
    )
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.collect() if r.vec_id is not None)
    assert [c for c in found.columns if c in ("v", "node")] == ["v", "node"]
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0
