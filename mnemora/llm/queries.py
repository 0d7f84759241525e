"""The registered queries of this package: ``opN_<name>`` and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment, archives, bwt_merge, exact, langid, lempel_ziv, mixing, negatives, packing, simhash_bk, token_counts, token_files,
    votes,
)
from .frames import tokenizer_path

WORD_TOKENS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_TOKENS = "byte_bpe_50k.json"
LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENS))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op2_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs, tokenizer_path(PIECES)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.without_repeats(table(spark, sf_dir, "documents"))


def op8_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.without_repeats(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes.document_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", hex16("fp").alias("fingerprint"),
        hex16("edited_fp").alias("edited_fingerprint"),
        votes.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), votes.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENS))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENS), end_id=2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 100 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENS), tokenizer_path(PIECES))


def hex16(bits: str):
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


#: Texts are equal without white space; the most code points, then the smallest doc_id, stays.
_EXACT_SQL = r"""
WITH rows AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
)
SELECT doc_id,
       first(doc_id) OVER same AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER same = 1 AS kept,
       sha256(norm) AS text_sha256
FROM rows
WINDOW same AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

_REVISIT_SQL = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
    FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

#: Components become whole numbers, so their products are exact in doubles.
_NEGATIVES_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n
  ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10
"""

QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_zip_archives, op3_mixture, op4_language, op5_near_duplicates, op6_exact_duplicates,
    op7_repeated_bytes, op8_repeated_words, op9_fingerprints, op10_packing,
    op11_token_files, op12_hard_negatives, op13_alignment,
)}
ORACLES = {"op2_zip_archives": _REVISIT_SQL, "op6_exact_duplicates": _EXACT_SQL, "op12_hard_negatives": _NEGATIVES_SQL}
