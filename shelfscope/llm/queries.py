"""The operators over whole tables, by the name under which they are registered."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import (
    dac_codes,
    hash_ring,
    html_templates,
    lockstep_alignment,
    ngram_jaccard,
    perspectives,
    pow2_packing,
    quality_llr,
    rns_negatives,
    template_decontam,
    tfidf_votes,
    token_counts,
    url_gbdt,
)
from shelfscope.llm.tables import read

WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_llr.judged(docs, quality_llr.fit(docs, read(spark, sf_dir, "labels")))


def op2_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hash_ring.sharded(read(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbdt.judged(read(spark, sf_dir, "pages"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac_codes.read_back(dac_codes.written(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.extracted(read(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotated(read(spark, sf_dir, "conversations"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.joined(read(spark, sf_dir, "documents"))


def op9_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pow2_packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op11_rns_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rns_negatives.mined(read(spark, sf_dir, "embeddings"), noisy)


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, (BYTE_VOCABULARY, PIECE_VOCABULARY))
    return lockstep_alignment.linked(read(spark, sf_dir, "documents"), a, b)


def op13_tfidf_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = tfidf_votes.fit(docs, read(spark, sf_dir, "labels"))
    return tfidf_votes.scored(docs, model).withColumn("held_out", tfidf_votes.held_out())


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_llr,
        op2_hash_ring_shards,
        op3_url_filter,
        op4_token_files,
        op5_html_text,
        op6_decontaminate,
        op7_perspectives,
        op8_ngram_jaccard,
        op9_pow2_packing,
        op10_token_counts,
        op11_rns_negatives,
        op12_lockstep_alignment,
        op13_tfidf_votes,
    )
}

# Turns in order, each seen by every participant; offsets are running sums of rendered lengths.
_PERSPECTIVES = """
WITH turns AS (
  SELECT conv_id, turn, trim(role) AS name, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, trim(role) NULLS FIRST,
      replace(coalesce(text, ''), '<|', '< |') NULLS FIRST) - 1 AS turn_index
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, name AS perspective FROM turns WHERE name <> 'system'),
seen AS (
  SELECT t.*, s.perspective,
    CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS kind
  FROM turns t JOIN speakers s ON t.conv_id = s.conv_id),
headed AS (
  SELECT *, CASE WHEN kind = 'user' THEN '<|user name=' || name || '|>' ELSE '<|' || kind || '|>' END || chr(10) AS header
  FROM seen),
rendered AS (SELECT *, header || text || '<|end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn_index) AS BIGINT) AS char_end
  FROM rendered)
SELECT conv_id, perspective, turn_index, turn, kind, name, rendered, char_end - length(rendered) AS char_start, char_end,
  kind = 'assistant' AS is_target,
  CASE WHEN kind = 'assistant' THEN char_end - length(rendered) + length(header) ELSE char_end END AS mask_start,
  CASE WHEN kind = 'assistant' THEN char_end - 1 ELSE char_end END AS mask_end
FROM placed
"""

# All pairs of anchors and rows; a vector with a null, infinite or NaN component has no finite sum of squares.
_NEGATIVES = """
WITH codes AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM codes a JOIN codes r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id) AS n
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE n <= 10
"""

ORACLES = {"op7_perspectives": _PERSPECTIVES, "op11_rns_negatives": _NEGATIVES}
