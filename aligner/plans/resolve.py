"""Tiered resolution of a table of strings: exact, then fuzzy, then ranked tokens, then no match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.functions.text import trimmed
from aligner.operators.exact import exact_lookup
from aligner.operators.fuzzy import THRESHOLD, two_passes
from aligner.operators.tokens import NO_MATCH, token_topk
from aligner.plans import maps
from aligner.session import stage

EMPTY_VALUE = "Empty value"


def tiered_resolve(queries: DataFrame, forward: DataFrame, targets: DataFrame, terms: DataFrame,
                   threshold: float = THRESHOLD, use_fuzzy: bool = True) -> DataFrame:
    """``(query_id, query)`` -> ``(query_id, source, target, method, confidence, matched_key)``.

    The maps are prepared first; jobs that resolve against the same maps more than once keep them (``maps.maps_of``) and call
    ``resolve_with``.
    """
    return resolve_with(queries, maps.prepare(forward, targets, terms, use_fuzzy), threshold)


def resolve_with(queries: DataFrame, known: maps.Maps, threshold: float = THRESHOLD) -> DataFrame:
    """``tiered_resolve`` against prepared maps; without key tables there is no fuzzy tier.

    Every tier sees only the distinct texts the tiers before it left, and the verdict per distinct text is joined
    back to the rows once at the end: repeated values cost one resolution.
    """
    rows = queries.select("query_id", trimmed(F.coalesce("query", F.lit(""))).alias("source"))
    texts = rows.select(F.col("source").alias("query")).filter(F.col("query") != "").distinct()
    exact = stage(
        exact_lookup(texts, known.exact)
        .select("query", "target", "method", "confidence", F.lit(None).cast("string").alias("matched_key")), "exact")
    rest = stage(texts.join(exact.select("query"), "query", "left_anti"), "rest")
    verdicts = exact
    if known.forward is not None and known.targets is not None:
        fuzzy = two_passes(rest, known.forward, known.targets, threshold).select(
            "query", "target", F.lit("fuzzy").alias("method"), F.col("score").alias("confidence"), "matched_key")
        verdicts = verdicts.unionByName(fuzzy)
        rest = stage(rest.join(fuzzy.select("query"), "query", "left_anti"), "rest")
    ranked = token_topk(rest.select(F.col("query").alias("query_id"), "query"), known.terms, k=1).select(
        F.col("query_id").alias("query"), F.col("term").alias("target"), F.lit("ProfileRank").alias("method"),
        F.col("score").alias("confidence"), F.lit(None).cast("string").alias("matched_key"))
    verdicts = verdicts.unionByName(ranked).withColumnRenamed("query", "source")
    unresolved = F.when(F.col("source") == "", EMPTY_VALUE).otherwise(NO_MATCH)
    return rows.join(verdicts, "source", "left").select(
        "query_id", "source", F.coalesce("target", unresolved).alias("target"),
        F.coalesce("method", F.lit("no_match")).alias("method"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "matched_key")


def learned_pairs(resolved: DataFrame, forward: DataFrame, reverse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps after a resolution run: fuzzy and ranked hits overwrite forward keys, add missing reverse keys."""
    learned = resolved.filter(F.col("method").isin("fuzzy", "ProfileRank"))
    pairs = learned.groupBy("source").agg(F.min("target").alias("target"))
    new_forward = forward.select("source", "target").join(pairs, "source", "left_anti").unionByName(pairs)
    firsts = pairs.groupBy("target").agg(F.min("source").alias("alias"))
    new_reverse = reverse.select("target", "alias").unionByName(firsts.join(reverse.select("target"), "target", "left_anti").select("target", "alias"))
    return new_forward, new_reverse
