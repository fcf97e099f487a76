"""Registered queries against SQL or plain versions, and the pipeline stage by stage."""

import os
import sys
from collections import Counter

import brute
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tidemark.llm import language_id, mixing  # noqa: E402
from tidemark.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries()) >= {*QUERIES, "pipeline"} and set(oracle_sql()) >= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare.differences(spark, QUERIES[name], ORACLES[name], SF_DIR, compare.connect(SF_DIR)) is None


def test_items_without_id(spark, tmp_path):
    """A hit depends on the text alone; an item without an id is in no list."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:15]), " ".join(words[20:35]), " ".join(words[10:30]), "w1 w2", None]
    items = [(None, " ".join(words[:12])), (1, " ".join(words[22:34])), (None, " ".join(words[22:34]))]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: (r.n_hit, r.n_items) for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert found == {0: (12, 0), 1: (12, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0)}
    left = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()


def test_suffix_query(spark, docs):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, SF_DIR).collect()}
    assert found == dict(zip([d.doc_id for d in docs], brute.suffix([d.text for d in docs]), strict=True))


def test_near_query(spark, docs):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_near_dedup"](spark, SF_DIR).collect()}
    wanted = brute.near([d.doc_id for d in docs], [d.text for d in docs], 2)
    assert found == {d.doc_id: (n, c, c == d.doc_id) for d, (n, c) in zip(docs, wanted, strict=True)}


def test_alignment_query(spark, docs):
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op13_token_alignment"](spark, SF_DIR).collect()}
    assert found == dict(zip([d.doc_id for d in docs], brute.alignment([d.text for d in docs]), strict=True))


def test_spot_query(spark, docs):
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op11_spot_signatures"](spark, SF_DIR).collect()}
    texts = [d.text or "" for d in docs]
    after = [texts[i - 1] for i in range(len(texts))]  # in falling order of ids
    anchors = brute.common_words(texts)
    for d, text, other in zip(docs, texts, after, strict=True):
        new = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        sets = [brute.spots(t, anchors) for t in (text, new, other)]
        n_chars, sha, own, edited, near_edited, near_next, n = found[d.doc_id]
        assert (n_chars, sha, n) == (len(text), brute.sha(new.encode()), len(sets[0]))
        assert (near_edited, near_next) == (brute.jaccard(sets[0], sets[1]), brute.jaccard(sets[0], sets[2]))
        assert (len(own), len(edited)) == (8 * len(sets[0]), 8 * len(sets[1]))
    assert len({r[2] for r in found.values()}) == len(set(texts))
    near = sorted(r[4] for r in found.values())
    assert near[len(near) // 20] > 0.3 and sum(r[5] < 0.1 for r in found.values()) > 0.9 * len(found)


def test_spelling_query(spark, docs):
    wanted = brute.spelling([d.doc_id for d in docs], [d.text for d in docs])
    assert Counter(map(tuple, QUERIES["op12_spelling_variants"](spark, SF_DIR).collect())) == Counter(wanted)


def test_vector_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_vector_dedup"](spark, SF_DIR).collect()}
    assert found == dict(zip([i for i, _ in rows], brute.vectors(*zip(*rows, strict=True)), strict=True))


def test_pipeline(spark, docs):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    model = language_id.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    found = language_id.identify(spark.read.parquet(f"{SF_DIR}/documents.parquet"), model, spans=False).collect()
    good = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SHARE}
    rows = [(d.doc_id, d.source, d.text) for d in docs if d.doc_id in good]
    left = brute.lines([r[0] for r in rows], [r[2] for r in rows])
    rows = [(i, s, x[2]) for (i, s, _), x in zip(rows, left, strict=True)]
    groups = brute.near([r[0] for r in rows], [r[2] for r in rows], 5)
    rows = [r for r, (_, c) in zip(rows, groups, strict=True) if c == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contaminated([r[2] for r in rows], items)
    rows = [r for r, (_, h, _) in zip(rows, hits, strict=True) if not h]
    assert 0 < len(rows) < len(docs)
    weights = {s: 1.0 for _, s, _ in rows}
    wanted = brute.mixed(rows, weights, corpus_pipeline.MIX_SEED, mixing.poisson_count)
    made = corpus_pipeline.run(spark, SF_DIR)
    assert made.columns == [*columns, "copy", "shuffle_key"]
    made = made.collect()
    assert Counter((r.doc_id, r.copy, r.shuffle_key) for r in made) == Counter(wanted)
    text = {i: t for i, _, t in rows}
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in made)


def test_equal_rows_pass_once(spark):
    """A table loaded twice leaves near dedup as it would loaded once; equal texts of other ids go, too."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(i, t, None, f"s{i}", None) for i, t in enumerate([*texts, None, "", "one"])]
    rows += [(None, "no id here", None, "s", None), (3, texts[3], None, "a", None), (20, texts[3], None, "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    once = Counter(map(tuple, stage(spark, spark.createDataFrame(rows, schema), SF_DIR).collect()))
    twice = Counter(map(tuple, stage(spark, spark.createDataFrame(rows + rows, schema).repartition(4), SF_DIR).collect()))
    assert once == twice and set(once.values()) == {1}
    assert {r[0] for r in once} == {*range(9), None} and (3, texts[3], None, "a", None) in once


def test_stages_on_nothing(spark, empty):
    empty = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0


def test_stages_on_odd_rows(spark, documents):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, documents, SF_DIR)
        assert made.columns[: len(columns)] == columns and made.count() >= 0, name
