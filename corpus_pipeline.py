"""A corpus pipeline: five operators one after another, each over all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a frame with the columns of
documents; the last adds `copy` and `shuffle_key`. `run` writes each result below
the shared folder and reads it again, so a stage starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from tidemark.llm.common import packed, same, stored, table, text_key

MIN_SHARE = 0.5  # of the letters in the language of the document
MIX_SEED = 20


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The documents' columns with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return docs.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in no one language; fills in missing languages."""
    model = language_id.train(docs)
    found = language_id.identify(docs, model, spans=False)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SHARE))
    return kept.select(
        *(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns)
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes long lines out that five documents or more hold, but for one of them."""
    return _with_text(line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs)), "kept_text")


def _equal_rows_once(docs: DataFrame) -> DataFrame:
    """One of the rows that repeat both id and text, the first in the order of their JSON.

    Ids and hashes of texts tell whether there are such rows; only theirs are read as groups.
    """
    rows = packed(docs, [], id=F.col("doc_id"), key=text_key("text"))
    again = rows.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").select("id", "key")
    again = stored(again, "equal-rows")
    if again.isEmpty():
        return docs
    others = rows.join(again, same(rows, again, ["id", "key"]), "left_anti").select("row")
    groups = rows.join(again, same(rows, again, ["id", "key"]), "left_semi").groupBy("id", "row.text")
    chosen = groups.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return stored(others.unionByName(chosen).select("row.*"), "rows-once")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    found = near_dedup.near_duplicates(_equal_rows_once(docs))
    return found.where("kept").select(*(f"`{c}`" for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.where("not contaminated").select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents so that all sources have the same share, in global random order."""
    weights = docs.select("source").distinct().withColumn("weight", F.lit(1.0))
    return mixing.mix(docs, weights, seed=MIX_SEED)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Language identification and sets of shingles at this size are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
