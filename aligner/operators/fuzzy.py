"""Fuzzy tier: the best key by greedy word similarity.

Keys are searched best first under bounds from letters (``keysearch``); the forward keys come before the targets, which only see the texts
that found nothing there. ``similar_words`` joins two vocabularies by edit similarity where such a table is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.functions.similarity import edit_similarity
from aligner.functions.text import normalized_words, trimmed
from aligner.operators.keysearch import best_keys
from aligner.operators.tokens import block_join
from aligner.session import stage, written

THRESHOLD = 0.7
_SLACK = 1e-9


@dataclass(frozen=True)
class KeyTable:
    """Written keys by their words: ``rows`` is ``(k_id, first, words, k_no)``, numbers follow the order of the keys."""

    rows: DataFrame


def key_table(keys: DataFrame, path: str | None = None) -> KeyTable:
    """``(key, target, key_ord)`` prepared for any number of searches, at ``path`` or in a staged table.

    Keys of equal words are equally similar to anything, so the first of them stands for all.
    """
    known = (
        keys.select("key", "target", "key_ord", normalized_words("key").alias("words"))
        .groupBy(F.array_join("words", " ").alias("k_id")).agg(F.min(F.struct("key_ord", "key", "target")).alias("first"), F.first("words").alias("words"))
    )
    numbered = known.orderBy("first").withColumn("k_no", F.monotonically_increasing_id())
    return KeyTable(written(numbered, path) if path else stage(numbered, "fuzzy-keys"))


def fuzzy_best(queries: DataFrame, keys: DataFrame | KeyTable, threshold: float = THRESHOLD) -> DataFrame:
    """Best key per distinct query text: ``(query, matched_key, target, score)``; ties keep the first key.

    ``queries`` has ``query``; ``keys`` has ``(key, target, key_ord)`` with a sortable, unique ``key_ord``, or is a table
    made of them by ``key_table``. A text without words matches the first key without words.
    """
    texts = _texts(queries)
    return _with_texts(texts, _best(_probes(texts), keys, threshold))


def _texts(queries: DataFrame) -> DataFrame:
    texts = queries.select("query").distinct().withColumn("words", normalized_words("query"))
    return stage(texts.withColumn("q_id", F.array_join("words", " ")), "fuzzy-texts")


def _probes(texts: DataFrame) -> DataFrame:
    return texts.select("q_id", "words").dropDuplicates(["q_id"])


def _best(probes: DataFrame, keys: DataFrame | KeyTable, threshold: float) -> DataFrame:
    """``q_id, score, first``: the best key of every probe that has any at the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    known = (keys if isinstance(keys, KeyTable) else key_table(keys)).rows
    hits = best_keys(probes.filter(F.size("words") > 0), known.filter(F.size("words") > 0).select("k_no", "words"), threshold)
    empty = probes.filter(F.size("words") == 0).join(known.filter(F.col("k_id") == "").select("first"), F.col("q_id") == "")
    return stage(hits.join(known.select("k_no", "first"), "k_no").select("q_id", "score", "first").unionByName(
        empty.select("q_id", F.lit(1.0).alias("score"), "first")), "fuzzy-hits")


def _with_texts(texts: DataFrame, best: DataFrame) -> DataFrame:
    return texts.select("query", "q_id").join(best, "q_id").select(
        "query", F.col("first.key").alias("matched_key"), F.col("first.target").alias("target"), "score")


def similar_words(left: DataFrame, right: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs ``(word, other, similarity)`` of two distinct vocabularies with edit similarity >= the bound.

    Lossless segment join: with at most d edits between two words, cutting one into d + 1 segments leaves at
    least one segment untouched, and it starts within d places of its position in the other word. A word too short for
    d + 1 segments has a longer partner, of whose m letters at least m - d stand in both in the same order: these meet on two such
    letters (or on one, where only one is certain).
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be in (0, 1]")

    def edits(longer: Column) -> Column:
        return F.floor(longer * (1 - min_similarity) + _SLACK).cast("int")

    def band(n: Column) -> Column:
        return F.sequence(F.greatest(F.ceil(n * min_similarity - _SLACK), F.lit(1)).cast("int"),
                          F.floor(n / min_similarity + _SLACK).cast("int"))

    # right words: segments for every edit bound that a partner length can ask for
    cut_start = F.floor(F.col("seg") * F.col("n") / (F.col("d") + 1)).cast("int")
    cut_end = F.floor((F.col("seg") + 1) * F.col("n") / (F.col("d") + 1)).cast("int")
    segments = (
        right.select(F.col("word").alias("other"), F.length("word").alias("n"))
        .withColumn("d", F.explode(F.array_distinct(F.transform(band(F.col("n")), lambda m: edits(F.greatest(m, F.col("n")))))))
        .filter(F.col("n") > F.col("d")).withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .select("other", "n", "d", "seg", F.substring(F.col("other"), cut_start + 1, cut_end - cut_start).alias("piece"))
    )
    # left words: for every partner length the pieces its segments could match
    asked = left.select("word", F.explode(band(F.length("word"))).alias("n")).withColumn(
        "d", edits(F.greatest(F.length("word"), F.col("n"))))
    probes = (
        asked.filter(F.col("n") > F.col("d")).withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .withColumn("from", cut_start).withColumn("size", cut_end - cut_start)
        .withColumn("at", F.explode(F.sequence(F.greatest(F.col("from") - F.col("d"), F.lit(0)),
                                               F.greatest(F.least(F.col("from") + F.col("d"), F.length("word") - F.col("size")), F.lit(0)))))
        .select("word", "n", "d", "seg", F.substring(F.col("word"), F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    )
    near = block_join(probes, segments, ["n", "d", "seg", "piece"]).select("word", "other")

    short = asked.filter((F.col("n") <= F.col("d")) & (F.length("word") - F.col("d") <= F.col("n"))).withColumn(
        "letters", F.least(F.length("word") - F.col("d"), F.lit(2)))
    asked_letters = short.select("word", "n", "letters", F.explode(_ordered_letters(F.col("word"), F.col("letters"))).alias("piece"))
    held_letters = right.select(F.col("word").alias("other"), F.length("word").alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("letters")).select(
        "other", "n", "letters", F.explode(_ordered_letters(F.col("other"), F.col("letters"))).alias("piece"))
    near = near.unionByName(block_join(asked_letters, held_letters, ["n", "letters", "piece"]).select("word", "other")).distinct()
    longest = F.greatest(F.length("word"), F.length("other"))
    return (
        near.filter((F.abs(F.length("word") - F.length("other")) <= edits(longest)))
        .withColumn("similarity", edit_similarity(F.col("word"), F.col("other")))
        .filter(F.col("similarity") >= min_similarity - _SLACK)
    )


def _ordered_letters(word: Column, count: Column) -> Column:
    """The distinct letters of a word, or its distinct pairs of letters in order."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    pairs = F.flatten(F.transform(letters, lambda a, i: F.transform(F.filter(letters, lambda _, k: k > i), lambda b: F.concat(a, b))))
    return F.array_distinct(F.when(count == 1, letters).otherwise(pairs))


def fuzzy_two_pass(queries: DataFrame, forward: DataFrame, targets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Forward keys first; queries without a hit there are compared with the targets.

    ``queries`` has ``query`` (trimmed, not empty), ``forward`` ``(source, target, key_ord)``, ``targets``
    ``(target, key_ord)``. Result ``(query, matched_key, target, score, direction)``.
    """
    return two_passes(queries, key_table(forward_keys(forward)), key_table(target_keys(targets)), threshold)


def forward_keys(forward: DataFrame) -> DataFrame:
    return forward.select(F.col("source").alias("key"), "target", "key_ord")


def target_keys(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("target").alias("key"), "target", "key_ord")


def two_passes(queries: DataFrame, forward: KeyTable, targets: KeyTable, threshold: float = THRESHOLD) -> DataFrame:
    """``fuzzy_two_pass`` over prepared keys."""
    texts = _texts(queries)
    probes = _probes(texts)
    ahead = _best(probes, forward, threshold)
    left = stage(probes.join(ahead, "q_id", "left_anti"), "fuzzy-probes")
    back = _best(left, targets, threshold)
    return _with_texts(texts, ahead).withColumn("direction", F.lit("forward")).unionByName(
        _with_texts(texts, back).withColumn("direction", F.lit("reverse")))


def fuzzy_input(queries: DataFrame, query: str = "query") -> DataFrame:
    """Trimmed, non-empty, distinct query texts."""
    return queries.select(trimmed(query).alias("query")).filter(F.col("query") != "").distinct()
