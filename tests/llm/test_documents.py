"""Operators on documents against plain versions, on rows with everything odd in them."""

import hashlib
import random
import tracemalloc
from collections import Counter

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    decontamination,
    line_dedup,
    lm_score,
    mixing,
    near_dedup,
    suffix_dedup,
    token_count,
)
from tidemark.llm.common import connected_components


def passes(frame, documents, made):
    """All columns of the input that the operator doesn't make are still there."""
    return [c for c in documents.columns if c not in made] == [c for c in frame.columns if c not in made]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)] + [(200, 300 + i) for i in range(50)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(6)
    found = {r.node: r.component for r in connected_components(frame).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 90, 95: 90, 90: 90} | {200: 200} | {300 + i: 200 for i in range(50)}
    assert connected_components(frame.limit(0)).count() == 0


def test_suffix_dedup(documents, empty, rows):
    found = suffix_dedup.removal_digest(documents)
    wanted = [(i, *x) for (i, _), x in zip(rows, brute.suffix([t for _, t in rows]), strict=True)]
    assert sum(x[2] > 0 for x in wanted) > 12
    assert Counter(map(tuple, found.collect())) == Counter(wanted)
    kept = suffix_dedup.remove_repeats(documents)
    assert passes(kept, documents, ["spans", "kept"])
    assert Counter((r.doc_id, brute.sha(bytes(r.kept))) for r in kept.collect()) == Counter((x[0], x[4]) for x in wanted)
    assert suffix_dedup.removal_digest(empty).count() == 0


@pytest.mark.parametrize("length", [264, 399])
def test_suffix_lengths(spark, length):
    base = hashlib.sha256(b"x").hexdigest() * 30
    texts = [base[: 300 + 7 * i] + f"<{i}>" + base[i : 900 + i] for i in range(9)] + ["ab" * 700, "z" * length, "z" * length]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digest(frame, length=length).collect()}
    assert found == dict(enumerate(brute.suffix(texts, length)))


def test_suffix_parts(spark, documents, rows, monkeypatch):
    """Texts cut into many parts, sets ranked a few at a time."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "ROWS", 50)
    found = suffix_dedup.removal_digest(documents)
    wanted = [(i, *x) for (i, _), x in zip(rows, brute.suffix([t for _, t in rows]), strict=True)]
    assert Counter(map(tuple, found.collect())) == Counter(wanted)


def test_suffix_copies(spark, monkeypatch):
    """Joins on texts are split where one text has very many copies."""
    draw, plans, store = random.Random(2), {}, suffix_dedup.stored
    texts = [draw.randbytes(300).hex() for _ in range(60)]
    texts += [texts[0]] * 300 + [t[:500] + draw.randbytes(50).hex() for t in texts[1:]]
    draw.shuffle(texts)
    other = spark.newSession()
    for name, value in {
        "autoBroadcastJoinThreshold": "-1",
        "shuffle.partitions": "16",
        "adaptive.coalescePartitions.enabled": "false",
        "adaptive.advisoryPartitionSizeInBytes": "2k",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        other.conf.set(f"spark.sql.{name}", value)

    def rows(frame, label):
        found = frame.collect()
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return found

    def watched(frame, label):
        if label == "suffix-texts":
            rows(frame, label)
        return store(frame, label)

    monkeypatch.setattr(suffix_dedup, "stored", watched)
    frame = other.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    found = {r[0]: tuple(r)[1:] for r in rows(suffix_dedup.removal_digest(frame), "result")}
    assert found == dict(enumerate(brute.suffix(texts)))
    assert all("skew=true" in plans[label].split("Initial Plan")[0] for label in ("suffix-texts", "result"))


def test_suffix_memory():
    """What a task holds does not grow with the length of a text, nor with the sets of a batch."""

    def peak(run, batch):
        tracemalloc.start()
        n, most = 0, 0
        for out in run(iter([batch])):
            n, most = n + out.num_rows, max(most, out.num_rows)
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most, size

    text = random.Random(1).randbytes(1 << 22).hex()  # 8 MB
    ids = [pa.array([7], pa.int64()), pa.array([8], pa.int32()), pa.array([text])]
    n, _, size = peak(suffix_dedup._first_ranks(400), pa.RecordBatch.from_arrays(ids, ["t1", "t2", "text"]))
    assert n > len(text) / 256
    assert size < 25 * len(text)
    sets = pa.array([[{"at": at, "low": 0, "high": 255} for at in range(255, 1 << 20, 130)]])
    n, most, size = peak(suffix_dedup._next_ranks(400, 16), pa.RecordBatch.from_arrays([*ids, sets], ["t1", "t2", "text", "sets"]))
    assert n == 16 * len(sets[0]) and most <= suffix_dedup.ROWS
    assert size < 6 * len(text)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(documents, empty, rows, words):
    made = ["n_shingles", "component_id", "kept"]
    found = near_dedup.near_duplicates(documents, words=words)
    assert passes(found, documents, made)
    got = found.select("doc_id", *made).collect()
    wanted = [(i, *x) for (i, _), x in zip(rows, brute.near(*zip(*rows, strict=True), words), strict=True)]
    assert Counter(tuple(r)[:3] for r in got) == Counter(wanted)
    distinct = {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.kept}
    assert all(i == c for i, _, c in distinct)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_chunks(spark, monkeypatch):
    """A group of near copies whose members do not all link with the first; chunks of a few rows."""
    monkeypatch.setattr(near_dedup, "LARGE", 8)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:i] + [f"v{i}"] + base[i + 1 : 100 - k]) for k in range(0, 24, 2) for i in range(0, 60, 9)]
    rows = list(enumerate(texts))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == dict(
        enumerate(brute.near(*zip(*rows, strict=True), 2))
    )


def test_bayes_bounds():
    bounds = near_dedup.fewest_matches(0.8, 180, 1e-6)
    assert bounds == sorted(bounds) and 100 < bounds[-1] < 144
    assert 1 - (1 - 0.8**5) ** near_dedup.plan_bands(0.8, 5, 1e-6) >= 1 - 1e-6


def test_decontamination(spark, documents, empty, rows):
    texts = [t for _, t in rows]
    items = [(1, texts[3]), (20, " ".join(texts[9].upper().split()[5:25])), (3, "be"), (4, None), (5, "..."), (2, texts[3]), (None, texts[1])]
    items += [(6, "ünïcode ÀÉ ß"), (7, "nowhere to be found"), (8, " ".join(texts[8].split()[:9]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.decontaminate(documents, benchmark)
    made = ["n_words", "n_hit", "items", "spans", "contaminated"]
    assert passes(found, documents, made)
    wanted = brute.contaminated(texts, [x for x in items if x[0] is not None])
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.select("doc_id", *made).collect())
    assert got == Counter((i, n, h, tuple(f), h > 0) for (i, _), (n, h, f) in zip(rows, wanted, strict=True))
    assert sum(h > 0 for _, h, _ in wanted) > 5
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert decontamination.decontaminate(documents, benchmark.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [phrase, phrase.replace("gamma", "gamma so"), "alpha beta gamma", phrase.replace("beta", "beta a b c d e f g")]
    frame = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    near = lambda slop: {r.id for r in decontamination.proximity_matches(frame, benchmark, slop).collect()}
    assert near(0) >= {0} and near(1) >= {0, 1} and near(9) == {0, 1, 3}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_of_all_words(spark, slop):
    """The three rarest words in their places are no match without the other seven."""
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [phrase, *["alpha beta gamma delta epsilon zeta eta"] * 10, "a b c d e f g theta iota kappa"]
    texts += [f"... {phrase.upper()}", phrase.replace("gamma ", ""), phrase.replace("zeta", "so zeta too"), phrase.replace("alpha", "beta")]
    rows = [*enumerate(texts), (0, phrase), (90, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(1, phrase), (2, phrase)], "item_id long, text string")
    words = phrase.split()
    frequency = Counter(w for _, t in rows for w in brute.bench_words(t))
    rarest = min(range(10), key=lambda i: (frequency[words[i]], i))

    def matches(text):
        found = brute.bench_words(text)
        starts = [i - rarest for i, w in enumerate(found) if w == words[rarest]]
        near = lambda s, i: found[max(0, s + i - slop) : max(0, s + i + slop + 1)]
        return any(all(w in near(s, i) for i, w in enumerate(words)) for s in starts)

    got = Counter(map(tuple, decontamination.proximity_matches(frame, benchmark, slop).collect()))
    assert got == Counter((i, item) for i, t in rows if matches(t) for item in "12")
    assert (0, "1") in got and (11, "1") not in got


def test_line_dedup(documents, empty, rows):
    made = ["kept_text", "n_lines", "n_dropped"]
    bitmaps = line_dedup.line_bitmaps(documents)
    found = line_dedup.keep_lines(documents, bitmaps)
    assert passes(found, documents, made)
    wanted = brute.lines(*zip(*rows, strict=True))
    assert sum(x[1] > 0 for x in wanted) > 5
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.select("doc_id", *made).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, wanted, strict=True))
    assert line_dedup.line_bitmaps(empty).count() == 0
    assert line_dedup.keep_lines(empty, bitmaps).count() == 0


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_lines_over_task_edges(spark, partitions):
    """Few lines in very many documents: they begin in one task and end in another."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = [c * 50 for c in "abcd"]
        rows = [(i, "\n".join(long[j] for j in range(4) if i % (j + 1) == 0)) for i in range(300)] + [(1000 + i, "e" * 41) for i in range(5)]
        rows += [(2000 + i, "f" * 41) for i in range(4)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        found = line_dedup.keep_lines(frame, line_dedup.line_bitmaps(frame)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in found} == dict(
        zip([i for i, _ in rows], brute.lines(*zip(*rows, strict=True)), strict=True)
    )


ODD = [
    "", " ", "  a", "a  b ", "\n", "a\n\nb\t", "<s> hi</s>", "ﬁ①Å", "a▁b ▁▁", "　a\xa0b", "a\r\nb \r", "\x00a", "🙂 ok🙂🙂",
    "x" * 3000, " " * 70 + "y", "\n \n  \n", "if (a) {\r\n}\r", "a " * 700,
]


def test_token_counts(spark, documents, empty, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    data = rows + [(900 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    wanted = Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in data)
    assert Counter(map(tuple, token_count.token_counts(frame, path).collect())) == wanted
    assert token_count.token_counts(documents, path).count() == len(rows)
    assert token_count.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("weights", [{"s0": 1.0, "s1": 3.0, None: 2.0}, {"s0": 900000.0, "s1": 1.0, "s2": 1.0, "gone": 0.0}])
def test_mixing(spark, documents, empty, weights):
    frame = spark.createDataFrame(list(weights.items()), "source string, weight double")
    found = mixing.mix(documents, frame, seed=4, partitions=6)
    assert passes(found, documents, ["copy", "shuffle_key"])
    got = [(r.doc_id, r.copy, r.shuffle_key) for r in found.select("doc_id", "copy", "shuffle_key").collect()]
    assert [x[2] for x in got] == sorted(x[2] for x in got)
    rows = [(r.doc_id, r.source, r.text) for r in documents.select("doc_id", "source", "text").collect()]
    weights = {s: w for s, w in weights.items() if w > 0}
    assert Counter(got) == Counter(brute.mixed(rows, weights, 4, mixing.poisson_count))
    assert mixing.mix(empty, frame).count() == 0
    assert mixing.mix(documents, frame.limit(0)).count() == 0


def test_mixing_large_rates(spark):
    rows = [(0, "a", "x"), (1, "b", "y" * 4000), (2, "b", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = Counter(r.doc_id for r in mixing.mix(frame, weights, seed=1, partitions=2).collect())
    assert got == Counter(x[0] for x in brute.mixed(rows, {"a": 1, "b": 1}, 1, mixing.poisson_count))
    assert 1700 < got[0] < 2300


def test_poisson():
    draws = [mixing.poisson_count(2.5, (i + 0.5) / 20000) for i in range(20000)]
    assert abs(sum(draws) / 20000 - 2.5) < 0.01
    assert abs(sum(d * d for d in draws) / 20000 - 2.5**2 - 2.5) < 0.05


def test_lm_score(spark, documents, empty, rows):
    import math

    targets = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 3, 700, None, 9999)], "doc_id long")
    made = ["n_tokens", "target_loss", "background_loss", "score"]
    found = lm_score.score(documents, targets)
    assert passes(found, documents, made)
    wanted_ids = {0, 1, 2, 3, 700}
    tokens = lm_score.Tokens()
    parts = [(i in wanted_ids, *(x.tolist() for x in tokens([t])[1:])) for i, t in rows]
    models = {}
    for flag in (True, False):
        words, before, pairs = Counter(), Counter(), Counter()
        for mine, w, b, p in parts:
            if mine or not flag:
                words.update(w), before.update(b), pairs.update(p)
        models[flag] = words, before, pairs, sum(words.values())
    scale = models[True][3] / models[False][3]

    def loss(flag, mine, w, b, p):
        words, before, pairs, n = models[flag]
        own, k = (mine if flag else 1), (1 if flag else scale)
        total = 0
        for x, y, z in zip(w, b, p, strict=True):
            one = ((words[x] - own) * k + 1) / ((n - own) * k + len(models[False][0]))
            total -= math.log(((pairs[z] - own) * k + lm_score.PRIOR * one) / ((before[y] - own) * k + lm_score.PRIOR))
        return total / len(w) if w else None

    wanted = sorted(((i, len(x[1]), loss(True, *x), loss(False, *x)) for (i, _), x in zip(rows, parts, strict=True)), key=repr)
    got = sorted((tuple(r) for r in found.select("doc_id", *made).collect()), key=repr)
    assert [x[:2] for x in sorted(wanted, key=lambda x: repr(x[:2]))] == [x[:2] for x in sorted(got, key=lambda x: repr(x[:2]))]
    near = lambda x: None if x is None else round(x, 4)
    assert Counter((i, near(t), near(b)) for i, _, t, b in wanted) == Counter((i, near(t), near(b)) for i, _, t, b, _ in got)
    assert lm_score.score(empty, targets).count() == 0
    assert lm_score.score(documents, targets.limit(0)).where(F.col("score").isNull() & (F.col("n_tokens") > 0)).count() == 0


def test_lm_score_counts_exactly(spark, monkeypatch):
    """Many words and pieces; the plain model has a dictionary of its own, and hashes nothing."""
    import math

    monkeypatch.setattr(lm_score, "PIECE", 1 << 16)
    texts = [" ".join(f"w{i * 450 + j} The" for j in range(600)) for i in range(150)]
    texts += ["the w1 the", "w1 the w1", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    wanted = set(range(0, 153, 3))
    found = lm_score.score(frame, spark.createDataFrame([(i,) for i in wanted], "doc_id long"))
    lists = [(t or "").lower().split() for t in texts]
    models = {}
    for flag in (True, False):
        chosen = [w for i, w in enumerate(lists) if i in wanted or not flag]
        models[flag] = (
            Counter(x for w in chosen for x in w),
            Counter(x for w in chosen for x in [None, *w][:-1]),
            Counter(x for w in chosen for x in zip([None, *w], w, strict=False)),
        )
    n = {flag: sum(m[0].values()) for flag, m in models.items()}
    size = len(models[False][0])
    assert size > 1 << 16

    def loss(flag, i):
        words, before, pairs = models[flag]
        own, k, total = (i in wanted, 1, 0) if flag else (1, n[True] / n[False], 0)
        for v, w in zip([None, *lists[i]], lists[i], strict=False):
            one = ((words[w] - own) * k + 1) / ((n[flag] - own) * k + size)
            total -= math.log(((pairs[v, w] - own) * k + lm_score.PRIOR * one) / ((before[v] - own) * k + lm_score.PRIOR))
        return total / len(lists[i]) if lists[i] else None

    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        if lists[i]:
            assert got[i].target_loss == pytest.approx(loss(True, i), abs=1e-9)
            assert got[i].background_loss == pytest.approx(loss(False, i), abs=1e-9)
        else:
            assert got[i].n_tokens == 0 and got[i].score is None
