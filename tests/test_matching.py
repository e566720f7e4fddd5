"""Blocked joins against brute force, and the traps of the matching tiers."""

import random

import pytest
from pyspark.sql import functions as F

from aligner.functions.similarity import edit_similarity, word_similarity
from aligner.functions.text import normalized_words, tokens
from aligner.operators import exact, fuzzy, scoring
from aligner.operators import tokens as tok
from aligner.plans.resolve import learned_pairs, tiered_resolve


def _texts(rng, n, vocabulary, most):
    return sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, most))) for _ in range(n)})


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(5)
    vocabulary = ["steel", "stel", "steal", "cold", "colt", "rolled", "roled", "sheet", "sheets", "a", "ab", "of", "x1", "x12", "12", "13"]
    terms = spark.createDataFrame([(t,) for t in _texts(rng, 120, vocabulary, 7)] + [("!!",)], "term string")
    queries = spark.createDataFrame(list(enumerate(_texts(rng, 60, vocabulary, 7))), "query_id long, query string")
    return terms.cache(), queries.cache()


@pytest.mark.parametrize("level", [0.5, 2 / 3, 0.8])
def test_similar_words_lose_nothing(spark, level, rows_of):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    left = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    right = spark.createDataFrame([(w,) for w in words[1::2] + ["a", "ab"]], "word string").distinct()
    got = fuzzy.similar_words(left, right, level).select("word", "other")
    pairs = left.join(right.withColumnRenamed("word", "other"), F.expr("word is not null and other is not null"))
    want = pairs.filter(edit_similarity(F.col("word"), F.col("other")) >= level - 1e-9)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.92, 1.0])
def test_fuzzy_best_equals_brute_force(spark, labels, threshold, rows_of):
    terms, queries = labels
    keys = terms.select(F.col("term").alias("key"), F.col("term").alias("target"), F.col("term").alias("key_ord"))
    got = fuzzy.fuzzy_best(queries, keys, threshold).select("query", "matched_key", F.round("score", 9))
    pairs = queries.join(terms, F.expr("query is not null and term is not null"))
    scored = pairs.withColumn("s", word_similarity(normalized_words("query"), normalized_words("term"))).filter(F.col("s") >= threshold)
    want = scored.groupBy("query").agg(F.min(F.struct(-F.col("s"), "term")).alias("b")).select("query", "b.term", F.round(-F.col("b.col1"), 9))
    assert rows_of(got) == rows_of(want)


def test_fuzzy_empty_words_match_empty_words(spark):
    queries = spark.createDataFrame([("??",)], "query string")
    keys = spark.createDataFrame([("!!", "T", 2), ("--", "U", 1), ("a", "V", 0)], "key string, target string, key_ord int")
    assert [tuple(r) for r in fuzzy.fuzzy_best(queries, keys).collect()] == [("??", "--", "U", 1.0)]


def test_fuzzy_ties_keep_the_first_key(spark):
    queries = spark.createDataFrame([("cold steel",)], "query string")
    keys = spark.createDataFrame([("steel cold", "B", 2), ("cold steel!", "A", 5), ("cold-steel", "C", 1)], "key string, target string, key_ord int")
    assert fuzzy.fuzzy_best(queries, keys).head()["target"] == "C"


@pytest.mark.parametrize("block_tokens, chunk_tokens, k", [(1 << 20, 1 << 20, 4), (1 << 20, 100, 4), (400, 1 << 20, 4), (60, 100, 4), (1, 300, 4), (60, 1 << 20, 1), (200, 200, 300)])
def test_token_topk_equals_brute_force(spark, labels, block_tokens, chunk_tokens, k, rows_of):
    terms, queries = labels
    got = tok.token_topk(queries, terms, k=k, block_tokens=block_tokens, chunk_tokens=chunk_tokens)
    q = queries.select("query_id", F.explode(tokens("query")).alias("token")).withColumn("n", F.expr("count(*) over (partition by query_id)"))
    pairs = q.join(tok.inverted_index(terms), "token").groupBy("query_id", "term").agg((F.count("*") / F.max("n")).alias("score"))
    want = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, term) - 1")).filter(f"rank < {k}")
    assert rows_of(got) == rows_of(want.select("query_id", "term", "score", "rank"))


@pytest.mark.parametrize("min_score, short_term", [(0.34, 16), (0.6, 16), (0.6, 2), (1.0, 3)])
def test_token_candidates_equal_brute_force(spark, labels, min_score, short_term, rows_of):
    terms, queries = labels
    got = tok.token_candidates(queries, terms, min_score, short_term=short_term)
    q = queries.select("query_id", F.explode(tokens("query")).alias("token")).withColumn("n", F.expr("count(*) over (partition by query_id)"))
    pairs = q.join(tok.inverted_index(terms), "token").groupBy("query_id", "term").agg((F.count("*") / F.max("n")).alias("score"))
    assert rows_of(got) == rows_of(pairs.filter(F.col("score") >= min_score - 1e-9))


def test_score_divides_by_query_tokens_and_ties_order_by_term(spark):
    terms = spark.createDataFrame([("steel unalloyed very long label",), ("unalloyed steel",), ("copper",)], "term string")
    queries = spark.createDataFrame([(1, "Steel, unalloyed!"), (2, "steel steel pipe"), (3, "..")], "query_id int, query string")
    got = [tuple(r) for r in tok.token_topk(queries, terms).orderBy("query_id", "rank").collect()]
    assert got == [(1, "steel unalloyed very long label", 1.0, 0), (1, "unalloyed steel", 1.0, 1),
                   (2, "steel unalloyed very long label", 0.5, 0), (2, "unalloyed steel", 0.5, 1)]


def test_candidate_sample_is_a_seeded_permutation(spark):
    topk = spark.createDataFrame([(1, f"t{i}", 1.0, i) for i in range(10)], "query_id int, term string, score double, rank int")
    first, again, other = (tuple(r["term"] for r in tok.candidate_sample(topk, 5, seed=s).orderBy("position").collect()) for s in (1, 1, 2))
    assert first == again and sorted(first) == [f"t{i}" for i in range(5)] and first != other


def test_rank_keeps_input_order_unless_asked(spark):
    ranking = spark.createDataFrame([(1, 0, "a", 0.2), (1, 1, "b", 0.9)], "query_id int, rank int, candidate string, relevance_score double")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    pick = lambda **k: sorted(tuple(r) for r in tok.rank_and_pick(queries, ranking, **k).collect())
    assert pick() == [(1, "a", 0.2), (2, "No matches found", 0.0)]
    assert pick(order_by="relevance") == [(1, "b", 0.9), (2, "No matches found", 0.0)]


def test_exact_trims_only(spark):
    queries = spark.createDataFrame([(1, " Foo\t"), (2, "foo"), (3, "Bar"), (4, "  ")], "query_id int, query string")
    forward = spark.createDataFrame([("Foo", "T1"), ("Bar", "T2")], "source string, target string")
    targets = spark.createDataFrame([("Bar",), ("foo",)], "target string")
    got = sorted((r["query_id"], r["target"]) for r in exact.exact_match(queries, forward, targets).collect())
    assert got == [(1, "T1"), (2, "foo"), (3, "T2")]  # the forward map wins over the target itself


def test_tiers(spark):
    queries = spark.createDataFrame([(1, " alias "), (2, "cold roled steel"), (3, "zinc pipe fitting xyz"), (4, " "), (5, "???"), (6, "Zinc pipe")],
                                    "query_id int, query string")
    forward = spark.createDataFrame([("alias", "Cold rolled steel", 1)], "source string, target string, key_ord int")
    targets = spark.createDataFrame([("Cold rolled steel", 1), ("Zinc pipe", 2)], "target string, key_ord int")
    terms = targets.select(F.col("target").alias("term"))
    resolved = tiered_resolve(queries, forward, targets, terms)
    got = {r["query_id"]: (r["target"], r["method"], round(r["confidence"], 4)) for r in resolved.collect()}
    assert got == {1: ("Cold rolled steel", "cached", 1.0), 2: ("Cold rolled steel", "fuzzy", round((2 + 5 / 6) / 3, 4)),
                   3: ("Zinc pipe", "ProfileRank", 0.5), 4: ("Empty value", "no_match", 0.0),
                   5: ("No matches found", "no_match", 0.0), 6: ("Zinc pipe", "cached", 1.0)}
    reverse = spark.createDataFrame([("Cold rolled steel", "alias")], "target string, alias string")
    new_forward, new_reverse = learned_pairs(resolved, forward, reverse)
    assert {tuple(r) for r in new_forward.collect()} == {("alias", "Cold rolled steel"), ("cold roled steel", "Cold rolled steel"), ("zinc pipe fitting xyz", "Zinc pipe")}
    assert {tuple(r) for r in new_reverse.collect()} == {("Cold rolled steel", "alias"), ("Zinc pipe", "zinc pipe fitting xyz")}


def test_scoring_of_offered_candidates(spark):
    pairs = spark.createDataFrame([(1, "steel", "steel", 0), (1, "steel", "steal", 1), (1, "steel", "zinc", 2), (2, "steel", "copper", 0)],
                                  "query_id int, query string, candidate string, list_ord int")
    best = [(r["query_id"], r["candidate"], r["score"]) for r in scoring.fuzzy_topk(pairs, "ratio", 70, 5).orderBy("query_id", "rank").collect()]
    assert best == [(1, "steel", 1.0), (1, "steal", 0.8)]
    answers = spark.createDataFrame([(1, "steel", 0.4), (2, "steel", 0.4), (3, "x", 0.9)], "query_id int, query string, confidence double")
    out = {r["query_id"]: r for r in scoring.validate_free_text(answers, pairs).collect()}
    assert (out[1]["target"], out[1]["confidence"], out[1]["fuzzy_corrected"], out[1]["needs_user_selection"]) == ("steel", 0.4, False, False)
    assert (out[2]["target"], out[2]["confidence"], out[2]["needs_user_selection"], len(out[2]["candidates"])) == ("steel", 0.0, True, 1)
    assert (out[3]["fuzzy_score"], out[3]["needs_user_selection"]) == (0.0, True)


def test_candidates_snap_to_the_offered_string(spark):
    offered = spark.createDataFrame([(1, "steel sheet", 0), (1, "steel pipe", 1)], "query_id int, candidate string, list_ord int")
    returned = spark.createDataFrame([(1, 0, "Steel pipe"), (1, 1, "steel sheet")], "query_id int, rank int, candidate string")
    got = [tuple(r) for r in scoring.correct_candidates(returned, offered).orderBy("rank").collect()]
    assert got == [(1, 0, "steel pipe", "Steel pipe", 0.9), (1, 1, "steel sheet", None, 1.0)]


def test_token_candidates_join_no_pairs_by_token(spark, monkeypatch):
    def refused(*_args, **_options):
        raise AssertionError("pairs that share some tokens only are joined")

    monkeypatch.setattr(tok, "block_join", refused)
    queries = spark.createDataFrame([(1, "Red steel"), (2, "steel red!"), (3, "red blue"), (4, " "), (5, None)], "query_id long, query string")
    terms = spark.createDataFrame([("red steel plate",), ("blue plate",), ("red steel plate",), (None,)], "term string")
    got = tok.token_candidates(queries, terms, 0.5).collect()
    assert sorted((r.query_id, r.term, r.score) for r in got) == [
        (1, "red steel plate", 1.0), (2, "red steel plate", 1.0), (3, "blue plate", 0.5), (3, "red steel plate", 0.5)]


def test_token_candidates_keep_every_pair_that_shares_a_token(spark, labels, rows_of, monkeypatch):
    monkeypatch.setattr(tok, "_EQUAL_SETS", 2)
    terms, queries = labels
    queries = queries.unionByName(queries.filter("query_id < 20").select(F.lit(None).cast("long").alias("query_id"), F.concat(F.lit(" "), "query").alias("query")))
    numbered = queries.withColumn("row", F.concat_ws("|", "query_id", "query"))
    q = numbered.select("row", "query_id", F.explode(tokens("query")).alias("token")).withColumn("n", F.expr("count(*) over (partition by row)"))
    pairs = q.join(tok.inverted_index(terms), "token").groupBy("row", "query_id", "term").agg((F.count("*") / F.max("n")).alias("score")).drop("row")
    for block_tokens, chunk_tokens in ((1 << 20, 1 << 20), (300, 200)):
        assert rows_of(tok.token_candidates(queries, terms, block_tokens=block_tokens, chunk_tokens=chunk_tokens)) == rows_of(pairs)


def test_registered_token_candidates_have_no_least_coverage(spark):
    from aligner.plans import registry

    got = registry.all_queries()["token_candidates"](spark, "/root/testdata/sf0.001")
    assert got.agg(F.min("score")).first()[0] < 0.5
