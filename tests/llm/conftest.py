import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names the operators use or make; none of them may be lost or mixed up.
CLASHES = (
    "row id key text_key t1 t2 bitmap n_lines score lang_pred copy shuffle_key of n sums parts component component_id kept "
    "spans signature w hits v node wanted _target least links position word kind"
).split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(words))


def corpus_rows() -> list[tuple]:
    """(doc_id, text) with nulls, blanks, copies, near copies, shared passages, ties and a long text."""
    texts = [prose(i, 30 + 9 * i) for i in range(12)]
    passage, line = prose(50, 90), "This line is shared by many documents, and it is long."
    rows = list(enumerate(texts))
    rows += [(100 + i, t) for i, t in enumerate([None, "", " \n\t", "a", "Ünïcode ÀÉ ß 漢字 words", "x" * 2000, "ab" * 900])]
    rows += [(200 + i, texts[5]) for i in range(4)]
    rows += [(300 + i, texts[11].replace(" ", f" w{i} ", 1 + i)) for i in range(6)]
    rows += [(400 + i, f"{prose(60 + i, 20)} {passage} {prose(80 + i, 25)}") for i in range(4)]
    rows += [(500 + i, f"{prose(90 + i, 12)}\n  {line.upper() if i % 2 else line}\r\n{prose(95 + i, 8)}\n{line}") for i in range(7)]
    rows += [(600, prose(7, 9000)), (601, f"{passage} {passage}"), (602, " ".join(["be"] * 400))]
    rows += [(700, texts[3]), (700, texts[3]), (700, texts[4]), (None, texts[2]), (None, None), (None, prose(8, 70))]
    rows += [(701, texts[6].upper()), (702, f"{line}\n" * 30)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The rows with null columns and columns that clash with names of the operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    data = [(i, t, None, None if n % 7 == 0 else f"s{n % 3}", None, *(["x"] * len(CLASHES))) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
