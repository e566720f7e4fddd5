"""Registered queries of the corpus operators, over whole tables with production parameters.

``op11`` to ``op13`` have a SQL twin. Tokenizers, fingerprints with XXH64, trained models and wrappers are outside SQL; the tests of the
others compare with brute force instead (tests/llm).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligner.llm import ann, exact, imatch, langid, mixing, negatives, packing, quality, repeats, resampling, simhash, tokens, wrappers
from aligner.llm.common import table

PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_texts(table(spark, sf_dir, "documents"), path).select(*PIECE_COLUMNS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.with_language(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_imatch": op4_imatch,
    "op5_neighbours": op5_neighbours,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_repeats": op9_repeats,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_resampling": op13_resampling,
}
_OP11 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS vec_id, b.label AS label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP12 = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""

#: CRC-32 of a word, a byte at a time: eight steps of the reflected polynomial 0xEDB88320.
_OP13 = f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS steps
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
t AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
tw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM t) GROUP BY ALL),
vocabulary AS (SELECT word FROM dw UNION SELECT word FROM tw),
bucketed AS (
  SELECT word, xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, b: xor(c // 256, steps[1 + xor(c % 256, b)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN bucketed USING (word) GROUP BY bucket),
tt AS (SELECT bucket, sum(n) AS n FROM tw JOIN bucketed USING (word) GROUP BY bucket),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln(
      CAST((coalesce(tt.n, 0) + 1) AS DOUBLE) * CAST((SELECT sum(n) FROM s) + 10000 AS DOUBLE)
      / (CAST(s.n + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(n) FROM tt), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM s LEFT JOIN tt USING (bucket)),
w AS (SELECT doc_id, sum(dw.n * g) AS weight FROM dw JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) FROM ranked) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""

ORACLES: dict[str, str] = {"op11_hard_negatives": _OP11, "op12_exact_dedup": _OP12, "op13_resampling": _OP13}
