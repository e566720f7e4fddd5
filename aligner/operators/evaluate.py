"""Evaluation metrics. The reference defines them in its specifications and leaves their computation to a consumer.

Truth is ``(query_id, expected)``; ``--`` marks a query for which no match exists. All metrics aggregate map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.operators.tokens import NO_MATCH

NO_MATCH_MARK = "--"


def is_correct(target: Column, expected: Column) -> Column:
    """Top-1 correctness; for a query without a match, giving none is right."""
    none_given = target.isNull() | (target == NO_MATCH)
    return F.when(expected == NO_MATCH_MARK, none_given).otherwise(F.coalesce(target == expected, F.lit(False)))


def judged(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return predictions.join(truth, "query_id").withColumn("correct", is_correct(F.col("target"), F.col("expected")))


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def accuracy(predictions: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share answered right; every query of the truth without a prediction (in the group) counts as one that was given none.

    The unanswered queries of a group are differences of counts, so groups and truth are never paired.
    """
    none_expected = F.col("expected") == NO_MATCH_MARK
    totals = truth.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(none_expected, 1)).alias("none"))
    answered = judged(predictions, truth).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col("correct"), 1)).alias("_correct"),
        F.count_distinct("query_id").alias("_asked"), F.count_distinct(F.when(none_expected, F.col("query_id"))).alias("_none"))
    queries = F.col("_rows") + totals.select("n").scalar() - F.col("_asked")
    right = F.col("_correct") + totals.select("none").scalar() - F.col("_none")
    return answered.withColumn("queries", queries).withColumn("accuracy", right / F.col("queries")).select(*(by or []), "queries", "accuracy")


def _answerable(truth: DataFrame) -> DataFrame:
    return truth.filter(F.col("expected") != NO_MATCH_MARK)


def _first_hits(candidates: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Best rank of the truth among the candidates per query (and ``by``)."""
    return (
        candidates.join(_answerable(truth), "query_id").filter(F.col("term") == F.col("expected"))
        .groupBy("query_id", *by).agg(F.min("rank").alias("rank"))
    )


def source_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Fraction of answerable queries whose truth is among the candidates; queries without candidates count."""
    hits = _first_hits(candidates, truth, [])
    return _answerable(truth).join(hits, "query_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), _share(F.col("rank").isNotNull()).alias("source_recall"))


def candidate_recall(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """The same over ranked queries only."""
    hits = _first_hits(ranked, truth, [])
    queries = _answerable(truth).join(ranked.select("query_id"), "query_id", "left_semi")
    return queries.join(hits, "query_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), _share(F.col("rank").isNotNull()).alias("candidate_recall"))


def cache_hit_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("queries"), _share(F.col("method") == "cached").alias("cache_hit_rate"))


def composite(metrics: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted sum of one-row metrics (column of the same name), missing ones counting zero."""
    names = [n for n in weights if n in metrics]
    row = metrics[names[0]].select(names[0])
    for name in names[1:]:
        row = row.withColumn(name, metrics[name].select(name).scalar())
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(name, F.lit(0.0)) * weights[name]
    return row.withColumn("composite", total)


def mrr(candidates: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean reciprocal rank over answerable queries, 0 where the truth is absent."""
    by = by or []
    hits = _first_hits(candidates, truth, by).groupBy(*by).agg(F.sum(1 / (F.col("rank") + 1)).alias("total"))
    n = _answerable(truth).agg(F.count(F.lit(1))).scalar()
    return hits.select(*by, (F.col("total") / n).alias("mrr"))


def hit_at_k(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Fraction of answerable queries with the truth within the first k, per step."""
    hits = _first_hits(candidates, truth, ["step"]).groupBy("step").agg(F.count(F.when(F.col("rank") < k, 1)).alias("hits"))
    n = _answerable(truth).agg(F.count(F.lit(1))).scalar()
    return hits.select("step", (F.col("hits") / n).alias("hit_at_k"))


def mcnemar(judged_a: DataFrame, judged_b: DataFrame) -> DataFrame:
    """Discordant counts of two configurations on the same queries and (b - c)^2 / (b + c)."""
    pairs = judged_a.select("query_id", F.col("correct").alias("a")).join(judged_b.select("query_id", F.col("correct").alias("b")), "query_id")
    out = pairs.agg(F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("b"), F.count(F.when(~F.col("a") & F.col("b"), 1)).alias("c"))
    diff = (F.col("b") - F.col("c")).cast("double")
    return out.withColumn("statistic", diff * diff / F.nullif(F.col("b") + F.col("c"), F.lit(0)))


def compare_runs_per_query(judged_all: DataFrame) -> DataFrame:
    """Best configuration per query: correct first, then confidence, then name; with how many were correct."""
    rank = F.struct((~F.col("correct")).alias("wrong"), (-F.col("confidence")).alias("low"), F.col("config"))
    return judged_all.groupBy("query_id").agg(
        F.min(rank).alias("best"), F.count(F.when(F.col("correct"), 1)).alias("correct_configs"), F.count(F.lit(1)).alias("configs")
    ).select("query_id", F.col("best.config").alias("best_config"), (~F.col("best.wrong")).alias("best_correct"), "correct_configs", "configs")


def strategy_comparison(judged_all: DataFrame) -> DataFrame:
    """Accuracy and web cost per evidence strategy."""
    return judged_all.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("queries"), _share(F.col("correct")).alias("accuracy"),
        F.avg("evidence_chars").alias("avg_evidence_chars"), F.sum("scrape_attempts").alias("scrape_attempts"))
