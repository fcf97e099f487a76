"""Cross-tokenizer alignment against plain versions on whole texts."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tidemark.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = [
    "a\u2581b", "\x00a\x1cb .\x1c", "<s>x</s> <|endoftext|> <0x41><unk>", "\n\n  a  \r\n b\t\tc };\r\n\r x \r", "a\u00a0  b\u00a0\u3000 c\u2028\n",
    "it's we'll 'tis ''s", "漢字かな交じり文 ελληνικά русский 🙂👍🏽", " " * 3000 + "end", "x" * 5000, "a" + "\n" * 1500 + " b" + " " * 7, "e\u0301 \ufb01 \ufffd \uffff",
    " lead", "trail \n", "\t", " ", "123456 7.89e-10 \x85 x\x85y", "0" * 4001,
]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, documents, empty, rows, monkeypatch, small):
    if small:
        for name, value in (("TEXT_BYTES", 500), ("PRODUCT", 64), ("SEGMENTS", 60), ("BLOCK_DOCS", 5)):
            monkeypatch.setattr(alignment, name, value)
    more = [(2000 + i, t) for i, t in enumerate(ODD)]
    frame = documents.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(*r, "x") for r in more], "doc_id long, text string, row string"))
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    found = alignment.token_alignment(frame.repartition(4), A, B).select(*columns).collect()
    rows = rows + more
    wanted = brute.alignment([t for _, t in rows])
    assert sum(w[0] > 0 for w in wanted) > 50 and wanted[len(rows) - len(more)][0] == 0
    assert Counter(map(tuple, found)) == Counter((i, *w) for (i, _), w in zip(rows, wanted, strict=True))
    assert alignment.token_alignment(empty, A, B).count() == 0


def _stored_blocks(monkeypatch):
    """Frames of stored blocks, in the order they are made."""
    made, real = [], alignment.stored

    def stored(frame, label, **options):
        out = real(frame, label, **options)
        made.extend([out] if label == "token-pairs" else [])
        return out

    monkeypatch.setattr(alignment, "stored", stored)
    return made


def test_stored_rows_and_row_groups_are_small(spark, monkeypatch):
    """What a reader or writer of the blocks holds at once does not grow with a block or a file."""
    draw, made = random.Random(7), _stored_blocks(monkeypatch)
    texts = [(i, " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(1000))) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert alignment.token_alignment(frame, A, B).count() == len(texts)
    files = [pq.ParquetFile(p.removeprefix("file://")) for p in made[0].inputFiles()]
    sizes = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(sizes) > 6e6 and max(sizes) < 5e6
    assert max(batch.nbytes for f in files for batch in f.iter_batches(1)) < 1 << 18


def test_alignment_of_chunks(spark, documents, rows, monkeypatch):
    for name, value in (("CHUNK", 64), ("SEGMENTS", 200)):
        monkeypatch.setattr(alignment, name, value)
    made = _stored_blocks(monkeypatch)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    found = alignment.token_alignment(documents.repartition(3), A, B).select(*columns).collect()
    wanted = brute.alignment([t for _, t in rows])
    assert Counter(map(tuple, found)) == Counter((i, *w) for (i, _), w in zip(rows, wanted, strict=True))
    assert made[0].where("first > 0 and data is not null").count() and made[0].where("first > 0 and pairs is not null").count()


def test_segments_of_random_texts():
    """Segments give what both libraries give for whole texts."""
    draw, alphabet = random.Random(5), "ab Z9.'\t\n\r\x0b\x0c\x1c\x85\u00a0\u2003\u3000});éß漢🙂_s"
    tokenizers = alignment.Tokenizers(A, B)
    texts = ["".join(draw.choices(alphabet, k=draw.randint(1, 30))) for _ in range(6000)] + [t for t in ODD if "\u2581" not in t]
    for text, (a, _, b, _) in zip(texts, brute.tokenized(texts), strict=True):
        parts = tokenizers.segments(text)
        assert "".join(parts) == " " + text
        if a:
            found = alignment.align(parts, tokenizers)
            assert (found.a.tolist(), found.b.tolist()) == (a, b), repr(text)


def test_links(spark):
    texts = [(1, "unbelievable, isn't it? 漢字🙂"), (2, None), (3, ""), (None, "x" * 90), (5, "a\u2581b")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {kind: alignment.token_links(frame, A, B, kind).collect() for kind in ("overlap", "end", "group")}
    wanted = {kind: Counter() for kind in got}
    for (i, _), (a, ends_a, b, ends_b) in zip(texts, brute.tokenized([t for _, t in texts]), strict=True):
        joint = sorted(set(ends_a) & set(ends_b))
        for x, (p, e) in enumerate(zip(a, ends_a, strict=True)):
            for y, (q, f) in enumerate(zip(b, ends_b, strict=True)):
                shared = min(e, f) - max(ends_a[x - 1] if x else 0, ends_b[y - 1] if y else 0)
                if shared > 0:
                    wanted["overlap"][(i, x, y, p, q, shared)] += 1
                    if e == f:
                        wanted["end"][(i, x, y, p, q, shared)] += 1
                if sum(j < e for j in joint) == sum(j < f for j in joint):
                    wanted["group"][(i, x, y, p, q, None)] += 1
    for kind, rows in got.items():
        assert Counter(map(tuple, rows)) == wanted[kind], kind
    with pytest.raises(ValueError):
        alignment.token_links(frame, A, B, "other")


def test_product(monkeypatch):
    draw = np.random.default_rng(3)
    for stretch in (1, 7, 1 << 20):
        monkeypatch.setattr(alignment, "PRODUCT", stretch)
        left, right = draw.integers(0, 3, (9, 6)) * draw.integers(0, 2, (9, 6)), draw.integers(0, 3, (6, 8))
        csr = lambda m: alignment.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])
        out = np.zeros((9, 8), int)
        for first, part in alignment.product(csr(left), csr(right)):
            i, j, v = alignment.entries(part)
            out[first + i, j] = v
        assert (out == left @ right).all()
        assert (alignment.product_sizes(csr(left), csr(right)) == ((left != 0).astype(int) @ (right != 0).astype(int)).sum(1)).all()
        again = alignment.transposed(csr(right))
        assert np.array_equal(again.indptr, csr(right.T).indptr) and np.array_equal(again.indices, csr(right.T).indices)
