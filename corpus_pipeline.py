"""Corpus preparation as stages over ``documents``; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligner.llm import minhash, mixing, packing, quality, repeats
from aligner.llm.catalog import PIECE_COLUMNS
from aligner.llm.common import table
from aligner.session import release, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; all of them if the labels teach it nothing (fewer than three rows of either kind)."""
    return quality.not_rejected(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints within three bits are linked first, min-hash bands find the pairs that differ in more; every link is checked on the
    shingles. The smallest id stays (nulls last). Texts without words are one group, repeated rows leave one; whole texts count; no rows give none.
    """
    return minhash.one_of_each(docs.select(*COLUMNS), shingle=5, similarity=0.8, distance=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of earlier ones; texts that lose nothing stay as they are.

    Every row stays, also with a null or empty text or one that loses all its words; rows of equal ids never remove each other's words.
    """
    kept = repeats.remove_repeats(docs.select("doc_id", "text", "lang", "source"), layout=True)
    kept = kept.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice; null sources are a source, texts without words add nothing to the mix."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 4096 tokens; a null or empty text is one piece with the end id, repeated rows are packed as often as they occur."""
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json")).select(*PIECE_COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Not expressible in SQL (trained classifier, fingerprints, tokenizer); tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``, each stage written and read again; an empty table gives no piece. Extra columns go
    with the first stage."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, sf_dir), name)
        release(before)  # leaves the input alone
    return STAGES[-1][1](spark, docs, sf_dir)
