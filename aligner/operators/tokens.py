"""Token retrieval: inverted index, candidates by query coverage, exact top-k.

Scores follow the query: shared tokens / distinct query tokens. Ties are ordered by term.

Top-k and candidates by coverage read packed posting lists of blocks of terms (``postings``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.functions.text import TOKEN_PATTERN, tokens
from aligner.operators import postings
from aligner.session import stage

#: Rows of one token set that a task answers.
_EQUAL_SETS = 4096


def tokenize(df: DataFrame, text: str, pattern: str = TOKEN_PATTERN) -> DataFrame:
    return df.withColumn("tokens", tokens(text, pattern))


def inverted_index(terms: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """One row per (token, term) over the distinct terms; kept exploded so that no posting list is one value."""
    return terms.select("term").distinct().select(F.explode(tokens("term", pattern)).alias("token"), "term")


def token_frequencies(terms: DataFrame, pattern: str = TOKEN_PATTERN) -> DataFrame:
    return inverted_index(terms, pattern).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def token_candidates(queries: DataFrame, terms: DataFrame | postings.TermIndex, min_score: float | None = None, short_term: int = 16,
                     pattern: str = TOKEN_PATTERN, block_tokens: int = postings.BLOCK_TOKENS, chunk_tokens: int = postings.BLOCK_TOKENS) -> DataFrame:
    """All (query, term) pairs that share a token, or only those with coverage >= ``min_score``: ``(query_id, term, score)``.

    ``queries`` is ``(query_id, query)``; equal token sets are matched once for up to ``_EQUAL_SETS`` rows. ``terms`` has ``term``, or is an index
    of them as in ``token_topk``. Chunks of queries meet blocks of packed posting lists, so no pair that fails leaves a task and no pair is joined
    or shuffled. Sets with up to ``short_term`` tokens in a block add bitmaps, others lists; that and the last two arguments, which bound what a
    task holds, change no result. The result grows with queries times terms where a token is common.
    """
    if min_score is not None and not 0 < min_score <= 1:
        raise ValueError("min_score must be in (0, 1]")
    index = terms if isinstance(terms, postings.TermIndex) else postings.term_index(terms, pattern, block_tokens)
    by_query, token_sets = _query_token_sets(queries, index.pattern)
    floor = F.lit(1) if min_score is None else F.greatest(F.ceil(F.size("tokens") * F.lit(min_score) - 1e-9), F.lit(1)).cast("int")
    parts = by_query.groupBy("p_no").agg(F.ceil(F.count(F.lit(1)) / _EQUAL_SETS).alias("parts"))
    sets = token_sets.withColumn("floor", floor).join(parts, "p_no")
    rows = by_query.join(sets, "p_no").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    return postings.covering(rows, index, chunk_tokens, short_term)


def block_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join of exploded keys. Their size is not that of the table they come from, so no side may be broadcast on that
    table's estimate; a sort-merge join also lets Spark split hot keys."""
    return left.join(right.hint("merge"), keys)


def token_topk(queries: DataFrame, terms: DataFrame | postings.TermIndex, k: int = 20, pattern: str = TOKEN_PATTERN,
               block_tokens: int = postings.BLOCK_TOKENS, chunk_tokens: int = postings.BLOCK_TOKENS) -> DataFrame:
    """The k best terms per query: ``(query_id, term, score, rank)``, rank from 0, exact.

    ``terms`` has ``term``, or is an index of them prepared by ``postings.term_index``, whose pattern then counts. Queries without tokens or
    without a token of any term get no rows. The last two arguments bound what a task holds and change no result.
    """
    index = terms if isinstance(terms, postings.TermIndex) else postings.term_index(terms, pattern, block_tokens)
    by_query, token_sets = _query_token_sets(queries, index.pattern)
    return by_query.join(postings.topk(token_sets, index, k, chunk_tokens), "p_no").select("query_id", "term", "score", "rank")


def _query_token_sets(queries: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(query_id -> p_no) and the distinct non-empty token sets (p_no, tokens).

    Token sets are numbered once and written, so that their tokens are spread with a long, not with the whole text.
    """
    keyed = (
        queries.select("query_id", F.array_sort(tokens("query", pattern)).alias("tokens"))
        .filter(F.size("tokens") > 0).withColumn("set_id", F.array_join("tokens", " "))
    )
    sets = stage(keyed.select("set_id", "tokens").dropDuplicates(["set_id"]).withColumn("p_no", F.monotonically_increasing_id()), "token-sets")
    return keyed.select("query_id", "set_id").join(sets.select("set_id", "p_no"), "set_id").drop("set_id"), sets.select("p_no", "tokens")


def candidate_sample(candidates: DataFrame, sample_size: int = 20, seed: int = 0) -> DataFrame:
    """Display order of the best candidates: a seeded hash order instead of a random one, position from 0."""
    shown = candidates.filter(F.col("rank") < sample_size)
    order = Window.partitionBy("query_id").orderBy(F.xxhash64("query_id", "term", F.lit(seed)), "term")
    return shown.withColumn("position", F.row_number().over(order) - 1)


def token_fallback_ranking(topk: DataFrame) -> DataFrame:
    """Ranking made of token scores: relevance = core concept score = token score, spec score 0."""
    return topk.select("query_id", "rank", F.col("term").alias("candidate"), F.col("score").alias("relevance_score"),
                       F.col("score").alias("core_concept_score"), F.lit(0.0).alias("spec_score"))


def relevance_score(core: Column, spec: Column, weight_core: float = 0.7) -> Column:
    """Weighted relevance rounded to 4 places, a missing score counts 0."""
    core, spec = F.coalesce(core, F.lit(0.0)), F.coalesce(spec, F.lit(0.0))
    return F.bround(core * weight_core + spec * (1 - weight_core), 4)


NO_MATCH = "No matches found"


def rank_and_pick(queries: DataFrame, ranking: DataFrame, order_by: str = "rank") -> DataFrame:
    """Target and confidence of every query: its first ranked candidate, else no match with confidence 0.

    ``order_by='relevance'`` picks by relevance score instead of the given order.
    """
    if order_by == "relevance":
        key = F.struct((-F.col("relevance_score")).alias("o"), F.col("rank"))
    else:
        key = F.struct(F.col("rank").alias("o"))
    first = ranking.groupBy("query_id").agg(F.min_by(F.struct("candidate", "relevance_score"), key).alias("f"))
    return queries.join(first, "query_id", "left").select(
        *queries.columns, F.coalesce("f.candidate", F.lit(NO_MATCH)).alias("target"),
        F.coalesce("f.relevance_score", F.lit(0.0)).alias("confidence"))
