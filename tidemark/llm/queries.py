"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment,
    decontamination,
    language_id,
    line_dedup,
    lm_score,
    mixing,
    near_dedup,
    spelling,
    spot_signatures,
    suffix_dedup,
    token_count,
    vector_dedup,
    warc,
)
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
MIX_SEED = 20


def registered(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def held_out_row(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


@registered
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 400-byte strings that occur elsewhere, too."""
    found = suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@registered
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate texts by the similarity of their 2-word shingles."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dedup.near_duplicates(documents, words=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@registered
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that lie in a ten-word window of a benchmark item."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(documents, table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op3_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n
),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, k)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@registered
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned from the rows that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(documents.where(~F.coalesce(held_out_row(), F.lit(False))))
    found = language_id.identify(documents.drop("lang"), model, spans=False)
    return found.select("doc_id", F.coalesce(held_out_row(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@registered
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every text between the good documents and all."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    found = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return found.select("doc_id", "n_tokens", "target_loss", "background_loss", "score")


@registered
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed so that every source has the same share of its bytes, in global random order."""
    documents = table(spark, sf_dir, "documents")
    weights = documents.select("source").distinct().withColumn("weight", F.lit(1.0))
    return mixing.mix(documents, weights, seed=MIX_SEED)


ORACLES["op6_mixing"] = f"""
WITH RECURSIVE
sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY source
),
rates AS (
  SELECT source, CAST((SELECT sum(size) FROM sizes) AS DOUBLE) * 1.0 / (SELECT CAST(count(*) AS DOUBLE) FROM sizes)
         / size AS rate
  FROM sizes WHERE size > 0
),
parts AS (
  SELECT source, greatest(CAST(ceil(rate / 500) AS INT), 1) AS parts, rate / greatest(CAST(ceil(rate / 500) AS INT), 1) AS r
  FROM rates
),
steps AS (
  SELECT source, parts, r, 0 AS k, exp(-r) AS p, exp(-r) AS total FROM parts
  UNION ALL
  SELECT source, parts, r, k + 1, p * r / (k + 1), total + p * r / (k + 1) FROM steps
  WHERE k < ceil(r + 12 * sqrt(r) + 24)
),
tables AS (SELECT source, any_value(parts) AS parts, list(total) AS totals FROM steps GROUP BY source),
drawn AS (
  SELECT d.*, part,
         len(list_filter(totals, lambda s: s <= CAST(('0x' || substr(md5(concat_ws('|', '{MIX_SEED}',
           coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''), CAST(part AS VARCHAR))), 1, 13)) AS BIGINT)
           / 4503599627370496.0)) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source, unnest(range(1, parts + 1)) u(part)
),
counts AS (
  SELECT doc_id, text, lang, source, n_chars, sum(n) AS n FROM drawn GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy,
       CAST(('0x' || substr(md5(concat_ws('|', 'order {MIX_SEED}', coalesce(CAST(doc_id AS VARCHAR), ''),
         coalesce(text, ''), CAST(copy AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS shuffle_key
FROM counts, unnest(range(1, CAST(n AS BIGINT) + 1)) u(copy)
"""


@registered
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    root = warc.new_root(spark)
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), root)
    records = warc.read_warc(spark, root, manifest, payloads=False)
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@registered
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text as the sentencepiece library counts them."""
    import public_tokenizers

    counts = token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


@registered
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that other documents repeat."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.keep_lines(documents, line_dedup.line_bitmaps(documents))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLES["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT doc_id, pos, line, r.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@registered
def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vector_dedup.near_vectors(vectors)
    return found.select("vec_id", "n_links", "component_id", "kept")


@registered
def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spot_signatures.edited_likeness(documents)
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"
    )


@registered
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with the words one letter apart, their usual form and its root."""
    words = spelling.frequent_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.spelling_variants(words)


@registered
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by two tokenizers, the groups both cut it into and the links of what ends together."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.token_alignment(documents, public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(MODEL))
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"
    )
