"""Queries: exact, fuzzy and token matching, scorers, tiered resolution."""

from pyspark.sql import functions as F

from aligner.functions import similarity
from aligner.functions.text import normalized_words, tokens, trimmed
from aligner.operators import allterms, exact, fuzzy, mapping, profiles, scoring
from aligner.operators import tokens as tok
from aligner.plans import resolve
from aligner.plans.all_terms_sql import SCORED, WEIGHTED_TOP
from aligner.plans.registry import query

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\w\s%]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_TOKENS = "list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z0-9]+'))"

# greedy word similarity of word lists {q} and {k}: fold over the query words, state = used places and total
_GREEDY = """list_reduce(list_transform({q}, lambda x: {{'w': x, 'used': CAST([] AS BIGINT[]), 'total': CAST(0 AS DOUBLE)}}),
  lambda st, x: list_transform([list_max(list_transform(
      list_filter(range(1, len({k}) + 1), lambda i: NOT list_contains(st.used, i)),
      lambda i: {{'s': 1 - levenshtein(x.w, {k}[i]) / greatest(length(x.w), length({k}[i])), 'n': -i}}))],
    lambda b: CASE WHEN b.s > 0 THEN {{'w': '', 'used': list_append(st.used, -b.n), 'total': st.total + b.s}}
      ELSE {{'w': '', 'used': st.used, 'total': st.total}} END)[1],
  {{'w': '', 'used': CAST([] AS BIGINT[]), 'total': CAST(0 AS DOUBLE)}}).total / greatest(len({q}), len({k}))"""


def _fuzzy_ctes(p, queries, keys):
    """CTEs {p}best(query, matched_key, target, score): best key of ``keys(key, target, ord)`` >= 0.7 per ``queries(query)``.

    Pairs are cut by word counts and by the sum of the best word similarities before the greedy fold.
    """
    return f"""
  {p}q AS (SELECT query, {_WORDS.format(x='query')} AS qw FROM {queries}),
  {p}k AS (SELECT key, target, ord, {_WORDS.format(x='key')} AS kw FROM {keys}),
  {p}qv AS (SELECT DISTINCT unnest(qw) AS w FROM {p}q),
  {p}kw AS (SELECT DISTINCT ord, unnest(kw) AS v FROM {p}k),
  {p}kv AS (SELECT DISTINCT v FROM {p}kw),
  {p}s AS (SELECT w, v, 1 - levenshtein(w, v) / greatest(length(w), length(v)) AS s FROM {p}qv, {p}kv),
  {p}top AS (SELECT s.w, k.ord, max(s.s) AS s FROM {p}s s JOIN {p}kw k ON k.v = s.v GROUP BY s.w, k.ord),
  {p}qx AS (SELECT query, unnest(qw) AS w FROM {p}q),
  {p}cand AS (SELECT x.query, t.ord, sum(t.s) AS upper_sum FROM {p}qx x JOIN {p}top t ON t.w = x.w GROUP BY x.query, t.ord),
  {p}near AS (SELECT q.query, q.qw, k.key, k.target, k.ord, k.kw FROM {p}cand c JOIN {p}q q ON q.query = c.query
    JOIN {p}k k ON k.ord = c.ord WHERE c.upper_sum >= 0.7 * greatest(len(q.qw), len(k.kw)) - 1e-9
      AND least(len(q.qw), len(k.kw)) >= 0.7 * greatest(len(q.qw), len(k.kw)) - 1e-9),
  {p}sim AS (SELECT query, key, target, ord, {_GREEDY.format(q='qw', k='kw')} AS score FROM {p}near),
  {p}best AS (SELECT query, key AS matched_key, target, score FROM {p}sim WHERE score >= 0.7
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) = 1)"""


_TEXTS = "texts AS (SELECT DISTINCT trim(query) AS query FROM {v_queries} WHERE trim(query) <> '')"
_FWD_KEYS = "fkeys AS (SELECT source AS key, target, row_num AS ord FROM {v_aliases})"
_REV_KEYS = "rkeys AS (SELECT term AS key, term AS target, row_number() OVER (ORDER BY term) AS ord FROM {v_terms})"
_TOKEN_PAIRS = f"""qt AS (SELECT query_id, {_TOKENS.format(x='query')} AS toks FROM {{v_queries}}),
  q AS (SELECT query_id, len(toks) AS n, unnest(toks) AS token FROM qt),
  t AS (SELECT term, unnest({_TOKENS.format(x='term')}) AS token FROM {{v_terms}}),
  pairs AS (SELECT q.query_id, t.term, count(*) / max(q.n) AS score FROM q JOIN t ON t.token = q.token GROUP BY q.query_id, t.term)"""
TOPK = f"""{_TOKEN_PAIRS},
  topk AS (SELECT query_id, term, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) - 1 AS rank
    FROM pairs QUALIFY rank < 20)"""


def _forward(w):
    return mapping.combine_forward(mapping.forward_map(w.v_aliases))


def _targets(w):
    return w.v_terms.select(F.col("term").alias("target"), F.col("term").alias("key_ord"))


def _term_keys(w):
    return w.v_terms.select(F.col("term").alias("key"), F.col("term").alias("target"), F.col("term").alias("key_ord"))


@query("exact_forward", """SELECT q.query_id, trim(q.query) AS key, a.target, 'cached' AS method, 1.0::DOUBLE AS confidence
  FROM {v_queries} q JOIN {v_aliases} a ON a.source = trim(q.query)""")
def _exact_forward(w):
    return exact.exact_forward(w.v_queries, _forward(w)).select("query_id", "key", "target", "method", "confidence")


@query("exact_reverse", """SELECT q.query_id, trim(q.query) AS key, t.term AS target, 'cached' AS method, 1.0::DOUBLE AS confidence
  FROM {v_queries} q JOIN {v_terms} t ON t.term = trim(q.query)""")
def _exact_reverse(w):
    return exact.exact_reverse(w.v_queries, _targets(w)).select("query_id", "key", "target", "method", "confidence")


@query("normalize_words", f"SELECT query_id, array_to_string({_WORDS.format(x='query')}, '|') AS words FROM {{v_queries}}")
def _normalize(w):
    return w.v_queries.select("query_id", F.array_join(normalized_words("query"), "|").alias("words"))


@query("word_similarity", f"""WITH p AS (SELECT query_id, {_WORDS.format(x='query')} AS qw, {_WORDS.format(x='expected')} AS kw FROM {{v_queries}})
  SELECT query_id, round(CASE WHEN len(qw) = 0 AND len(kw) = 0 THEN 1 WHEN len(qw) = 0 OR len(kw) = 0 THEN 0
    ELSE {_GREEDY.format(q='qw', k='kw')} END, 6) AS similarity FROM p""")
def _word_similarity(w):
    return w.v_queries.select("query_id", F.round(similarity.word_similarity(
        normalized_words("query"), normalized_words("expected")), 6).alias("similarity"))


@query("fuzzy_best", f"""WITH {_TEXTS}, {_REV_KEYS}, {_fuzzy_ctes('r', 'texts', 'rkeys')}
  SELECT query, matched_key, target, round(score, 6) AS score FROM rbest""")
def _fuzzy_best(w):
    best = fuzzy.fuzzy_best(fuzzy.fuzzy_input(w.v_queries), _term_keys(w))
    return best.withColumn("score", F.round("score", 6))


@query("fuzzy_two_pass", f"""WITH {_TEXTS}, {_FWD_KEYS}, {_REV_KEYS}, {_fuzzy_ctes('f', 'texts', 'fkeys')},
  left_over AS (SELECT query FROM texts WHERE query NOT IN (SELECT query FROM fbest)), {_fuzzy_ctes('r', 'left_over', 'rkeys')}
  SELECT query, matched_key, target, round(score, 6) AS score, 'forward' AS direction FROM fbest
  UNION ALL SELECT query, matched_key, target, round(score, 6), 'reverse' FROM rbest""")
def _fuzzy_two_pass(w):
    return fuzzy.fuzzy_two_pass(fuzzy.fuzzy_input(w.v_queries), _forward(w), _targets(w)).withColumn("score", F.round("score", 6))


_LCS = """list_reduce(list_transform(string_split({a}, ''), lambda x: {{'c': x, 'r': CAST([] AS BIGINT[])}}),
  lambda st, x: {{'c': '', 'r': list_reduce(list_transform(range(1, length({b}) + 1), lambda i: {{'i': i, 'acc': CAST([] AS BIGINT[])}}),
      lambda s2, y: {{'i': y.i, 'acc': list_append(s2.acc, greatest(s2.acc[-1], st.r[y.i + 1],
        st.r[y.i] + CASE WHEN substr({b}, y.i, 1) = x.c THEN 1 ELSE 0 END))}},
      {{'i': CAST(0 AS BIGINT), 'acc': [CAST(0 AS BIGINT)]}}).acc}},
  {{'c': '', 'r': list_transform(range(length({b}) + 1), lambda i: CAST(0 AS BIGINT))}}).r[-1]"""


def _scorer_query(name):
    def run(w):
        return w.v_queries.select("query_id", F.round(similarity.score(name, "query", "expected"), 4).alias("score"))
    return run


query("scorer_ratio", f"""SELECT query_id, round(200.0 * {_LCS.format(a='query', b='expected')} / (length(query) + length(expected)), 4) AS score
  FROM {{v_queries}}""")(_scorer_query("ratio"))
query("scorer_token_sort_ratio", f"""WITH p AS (SELECT query_id,
    array_to_string(list_sort(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')), ' ') AS a,
    array_to_string(list_sort(list_filter(string_split_regex(expected, '\\s+'), lambda w: w <> '')), ' ') AS b FROM {{v_queries}})
  SELECT query_id, round(CASE WHEN a = '' THEN 0 ELSE 200.0 * {_LCS.format(a='a', b='b')} / (length(a) + length(b)) END, 4) AS score FROM p""")(
    _scorer_query("token_sort_ratio"))

# pairs of short strings for the scorers built on many alignments; the oracle scores distinct pairs
_SHORT_PAIRS = """pairs AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 2 = 0 THEN concat(p_type, ' ', split_part(p_name, ' ', 2))
      ELSE concat(p_type, ' ', p_name, ' item') END AS b FROM {part}), d AS (SELECT DISTINCT a, b FROM pairs)"""
_PARTIAL = f"""{_SHORT_PAIRS},
  sl AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM d
    UNION ALL SELECT a, b, b, a FROM d WHERE length(a) = length(b)),
  win AS (SELECT a, b, s, l, unnest(range(1 - length(s), length(l))) AS i FROM sl),
  cut AS (SELECT DISTINCT a, b, s, substr(l, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) AS w FROM win),
  partial AS (SELECT a, b, max(200.0 * {_LCS.format(a='s', b='w')} / (length(s) + length(w))) AS partial_ratio FROM cut GROUP BY a, b)"""
_SET = f"""{_SHORT_PAIRS},
  tk AS (SELECT a, b, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb FROM d),
  parts AS (SELECT a, b, array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS c,
    array_to_string(list_sort(list_filter(list_distinct(ta), lambda x: NOT list_contains(tb, x))), ' ') AS oa,
    array_to_string(list_sort(list_filter(list_distinct(tb), lambda x: NOT list_contains(ta, x))), ' ') AS ob FROM tk),
  glued AS (SELECT *, trim(concat(c, ' ', oa)) AS ca, trim(concat(c, ' ', ob)) AS cb FROM parts),
  token_set AS (SELECT a, b, CASE WHEN c <> '' AND (oa = '' OR ob = '') THEN 100.0 ELSE greatest(200.0 * {_LCS.format(a='ca', b='cb')} / (length(ca) + length(cb)),
    CASE WHEN c <> '' THEN 200.0 * length(c) / (length(c) + length(ca)) ELSE 0 END, CASE WHEN c <> '' THEN 200.0 * length(c) / (length(c) + length(cb)) ELSE 0 END) END AS token_set_ratio
    FROM glued)"""


def _short_scorer_query(name):
    def run(w):
        second = F.get(F.split("p_name", " "), 1)
        b = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_type", second)).otherwise(F.concat_ws(" ", "p_type", "p_name", F.lit("item")))
        return w.part.select("p_partkey", F.round(similarity.score(name, "p_name", b), 4).alias("score"))
    return run


query("scorer_partial_ratio", f"""WITH {_PARTIAL} SELECT p.p_partkey, round(x.partial_ratio, 4) AS score FROM pairs p JOIN partial x ON x.a = p.a AND x.b = p.b""")(
    _short_scorer_query("partial_ratio"))
query("scorer_token_set_ratio", f"""WITH {_SET} SELECT p.p_partkey, round(x.token_set_ratio, 4) AS score FROM pairs p JOIN token_set x ON x.a = p.a AND x.b = p.b""")(
    _short_scorer_query("token_set_ratio"))
query("scorer_wratio", f"""WITH {_PARTIAL}, {_SET.replace(_SHORT_PAIRS + ',', '')},
  simple AS (SELECT a, b, 200.0 * {_LCS.format(a='a', b='b')} / (length(a) + length(b)) AS r, greatest(length(a), length(b)) / least(length(a), length(b)) AS lr,
    200.0 * {_LCS.format(a="array_to_string(list_sort(string_split(a, ' ')), ' ')", b="array_to_string(list_sort(string_split(b, ' ')), ' ')")} / (length(a) + length(b)) AS ts FROM d),
  w AS (SELECT s.a, s.b, CASE WHEN lr < 1.5 THEN greatest(r, 0.95 * greatest(ts, t.token_set_ratio))
    ELSE greatest(r, 0.9 * p.partial_ratio, 0.95 * 0.9 * 100) END AS score
    FROM simple s JOIN token_set t ON t.a = s.a AND t.b = s.b JOIN partial p ON p.a = s.a AND p.b = s.b)
  SELECT p.p_partkey, round(w.score, 4) AS score FROM pairs p JOIN w ON w.a = p.a AND w.b = p.b""")(_short_scorer_query("WRatio"))


@query("tokenize", f"SELECT query_id, array_to_string(list_sort({_TOKENS.format(x='query')}), ' ') AS tokens FROM {{v_queries}}")
def _tokenize(w):
    return w.v_queries.select("query_id", F.array_join(F.array_sort(tokens("query")), " ").alias("tokens"))


@query("inverted_index", f"SELECT unnest({_TOKENS.format(x='term')}) AS token, term FROM {{v_terms}}")
def _index(w):
    return tok.inverted_index(w.v_terms)


@query("inverted_index_documents", f"""WITH d AS (SELECT DISTINCT text FROM {{documents}}),
  x AS (SELECT unnest({_TOKENS.format(x='text')}) AS token FROM d) SELECT token, count(*) AS df FROM x GROUP BY token""")
def _index_documents(w):
    return tok.token_frequencies(w.documents.select(F.col("text").alias("term")))


@query("expand_query_tokens", """WITH p AS (SELECT p_partkey AS query_id,
    list_distinct(string_split(concat_ws(' ', p_name, p_type, p_brand, p_name), ' ')) AS words FROM {part})
  SELECT query_id, array_to_string(list_sort(words), ' ') AS words, len(words) AS n FROM p""")
def _expand(w):
    docs = w.part.select(F.col("p_partkey").alias("query_id"), "p_name", F.struct(
        "p_type", F.array("p_brand", "p_name").alias("names"),
        F.struct(F.lit("hidden words").alias("query")).alias("_metadata")).alias("profile"))
    words = profiles.expanded_words(F.col("p_name"), profiles.flatten_profile(docs, "profile"))
    return docs.select("query_id", F.array_join(F.array_sort(words), " ").alias("words"), F.size(words).alias("n"))


@query("token_candidates", f"WITH {_TOKEN_PAIRS} SELECT query_id, term, round(score, 6) AS score FROM pairs")
def _candidates(w):
    return tok.token_candidates(w.v_queries, w.v_terms).withColumn("score", F.round("score", 6))


@query("token_topk", f"WITH {TOPK} SELECT query_id, term, round(score, 6) AS score, rank FROM topk")
def _topk(w):
    return tok.token_topk(w.v_queries, w.v_terms, k=20).withColumn("score", F.round("score", 6))


@query("token_topk_documents", f"""WITH qt AS (SELECT item_id AS query_id, {_TOKENS.format(x='text')} AS toks FROM {{benchmark}}),
  q AS (SELECT query_id, len(toks) AS n, unnest(toks) AS token FROM qt),
  d AS (SELECT DISTINCT text AS term FROM {{documents}}), t AS (SELECT term, unnest({_TOKENS.format(x='term')}) AS token FROM d),
  pairs AS (SELECT q.query_id, t.term, count(*) / max(q.n) AS score FROM q JOIN t ON t.token = q.token GROUP BY q.query_id, t.term)
  SELECT query_id, md5(term) AS term, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) - 1 AS rank
    FROM pairs QUALIFY rank < 20""")
def _topk_documents(w):
    queries = w.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    topk = tok.token_topk(queries, w.documents.select(F.col("text").alias("term")), k=20)
    return topk.select("query_id", F.md5("term").alias("term"), F.round("score", 6).alias("score"), "rank")


@query("candidate_sample", f"WITH {TOPK} SELECT query_id, term FROM topk WHERE rank < 10")
def _sample(w):
    return tok.candidate_sample(tok.token_topk(w.v_queries, w.v_terms, k=20), 10, seed=7).select("query_id", "term")


@query("token_fallback_ranking", f"""WITH {TOPK} SELECT query_id, rank, term AS candidate, round(score, 6) AS relevance_score,
  round(score, 6) AS core_concept_score, 0.0::DOUBLE AS spec_score FROM topk""")
def _fallback(w):
    ranking = tok.token_fallback_ranking(tok.token_topk(w.v_queries, w.v_terms, k=20))
    return ranking.withColumns({c: F.round(c, 6) for c in ("relevance_score", "core_concept_score")})


@query("rank_and_pick", f"""WITH {TOPK} SELECT v.query_id, coalesce(k.term, 'No matches found') AS target,
  round(coalesce(k.score, 0), 6) AS confidence FROM {{v_queries}} v LEFT JOIN topk k ON k.query_id = v.query_id AND k.rank = 0""")
def _pick(w):
    ranking = tok.token_fallback_ranking(tok.token_topk(w.v_queries, w.v_terms, k=20))
    picked = tok.rank_and_pick(w.v_queries.select("query_id"), ranking)
    return picked.withColumn("confidence", F.round("confidence", 6))


@query("relevance_score", """SELECT l_orderkey, l_linenumber, l_extendedprice,
  round(coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 53 END, 0) * 0.7 + coalesce(l_discount, 0) * (1 - 0.7), 4) AS relevance
  FROM {lineitem}""")
def _relevance(w):
    core = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 53)
    return w.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", tok.relevance_score(core, F.col("l_discount")).alias("relevance"))


def _offered_by_tokens(w):
    topk = tok.token_topk(w.v_queries, w.v_terms, k=20)
    return w.v_queries.join(topk, "query_id").select(
        "query_id", trimmed("query").alias("query"), F.col("term").alias("candidate"), F.col("rank").alias("list_ord"))


@query("fuzzy_topk", f"""WITH {WEIGHTED_TOP} SELECT v.query_id, f.query, f.candidate, f.score, f.rank
  FROM {{v_queries}} v JOIN first f ON f.query = trim(v.query)""")
def _fuzzy_topk(w):
    return allterms.topk_of_all(w.v_queries, w.v_terms, "WRatio", 70, 5)


@query("fuzzy_topk_ratio", f"WITH {SCORED} SELECT query_id, query, candidate, score, rank FROM near WHERE s >= 70 AND rank < 5")
def _fuzzy_topk_ratio(w):
    return allterms.topk_of_all(w.v_queries, w.v_terms, "ratio", 70, 5)


@query("nearest_terms", f"WITH {SCORED} SELECT query_id, query, candidate, score, rank FROM near WHERE rank < 10")
def _nearest(w):
    return allterms.topk_of_all(w.v_queries, w.v_terms, "ratio", 0, 10)


# every returned string has one character replaced, so its nearest offered string is the one it came from: 1 of n differs
@query("correct_candidates", f"""WITH {TOPK} SELECT query_id, rank, term AS candidate, replace(term, '#', ' ') AS original_string,
  round_even((length(term) - 1) / length(term), 4) AS correction_confidence FROM topk WHERE rank < 5""")
def _correct(w):
    offered = _offered_by_tokens(w)
    returned = offered.filter(F.col("list_ord") < 5).select(
        "query_id", F.col("list_ord").alias("rank"), F.regexp_replace("candidate", "#", " ").alias("candidate"))
    return scoring.correct_candidates(returned, offered)


@query("validate_free_text", f"""WITH {SCORED}, best AS (SELECT query_id, max(score) FILTER (WHERE rank = 0) AS score, max(candidate) FILTER (WHERE rank = 0) AS candidate,
    string_agg(candidate, '|' ORDER BY rank) FILTER (WHERE rank < 10) AS listed FROM near GROUP BY query_id),
  j AS (SELECT v.query_id, trim(v.query) AS query, coalesce(b.score, 0) AS score, b.candidate, coalesce(b.listed, '') AS listed FROM {{v_queries}} v LEFT JOIN best b ON b.query_id = v.query_id)
  SELECT query_id, CASE WHEN score >= 0.75 THEN candidate ELSE query END AS target, CASE WHEN score >= 0.75 THEN 0.5 ELSE 0 END::DOUBLE AS confidence, score::DOUBLE AS fuzzy_score,
    score >= 0.75 AND candidate <> query AS fuzzy_corrected, CASE WHEN score >= 0.75 AND candidate <> query THEN query END AS original_target,
    score < 0.75 AS needs_user_selection, CASE WHEN score >= 0.75 THEN '' ELSE listed END AS candidates FROM j""")
def _validate(w):
    answers = w.v_queries.select("query_id", trimmed("query").alias("query"), F.lit(0.5).alias("confidence"))
    return scoring.validate_free_text(answers, allterms.best_of_all(w.v_queries, w.v_terms, scoring.CORRECTION_TOP_N)).withColumn("candidates", F.array_join(F.col("candidates.candidate"), "|"))


TIERED = f"""{_TEXTS}, {_FWD_KEYS}, {_REV_KEYS},
  exact AS (SELECT t.query, coalesce(f.target, r.target) AS target, 'cached' AS method, 1.0::DOUBLE AS confidence, NULL::VARCHAR AS matched_key
    FROM texts t LEFT JOIN fkeys f ON f.key = t.query LEFT JOIN rkeys r ON r.key = t.query
    WHERE f.key IS NOT NULL OR r.key IS NOT NULL),
  rest1 AS (SELECT query FROM texts WHERE query NOT IN (SELECT query FROM exact)), {_fuzzy_ctes('f', 'rest1', 'fkeys')},
  rest2 AS (SELECT query FROM rest1 WHERE query NOT IN (SELECT query FROM fbest)), {_fuzzy_ctes('r', 'rest2', 'rkeys')},
  rest3 AS (SELECT query FROM rest2 WHERE query NOT IN (SELECT query FROM rbest)),
  tt AS (SELECT query, {_TOKENS.format(x='query')} AS toks FROM rest3),
  tq AS (SELECT query, len(toks) AS n, unnest(toks) AS token FROM tt),
  tk AS (SELECT term, unnest({_TOKENS.format(x='term')}) AS token FROM {{v_terms}}),
  tp AS (SELECT tq.query, tk.term, count(*) / max(tq.n) AS score FROM tq JOIN tk ON tk.token = tq.token GROUP BY tq.query, tk.term),
  ranked AS (SELECT query, term, score FROM tp QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, term) = 1),
  verdict AS (SELECT * FROM exact
    UNION ALL SELECT query, target, 'fuzzy', score, matched_key FROM fbest
    UNION ALL SELECT query, target, 'fuzzy', score, matched_key FROM rbest
    UNION ALL SELECT query, term, 'ProfileRank', score, NULL FROM ranked),
  resolved AS (SELECT q.query_id, trim(q.query) AS source,
      coalesce(v.target, CASE WHEN trim(q.query) = '' THEN 'Empty value' ELSE 'No matches found' END) AS target,
      coalesce(v.method, 'no_match') AS method, round(coalesce(v.confidence, 0), 6) AS confidence, v.matched_key
    FROM {{v_queries}} q LEFT JOIN verdict v ON v.query = trim(q.query))"""


def _resolved(w):
    out = resolve.tiered_resolve(w.v_queries, _forward(w), _targets(w), w.v_terms)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("tiered_resolve", f"WITH {TIERED} SELECT * FROM resolved")
def _tiered(w):
    return _resolved(w)


@query("learned_pairs", f"""WITH {TIERED}, pairs AS (SELECT source, min(target) AS target FROM resolved
    WHERE method IN ('fuzzy', 'ProfileRank') GROUP BY source),
  fresh AS (SELECT target, min(source) AS alias FROM pairs GROUP BY target)
  SELECT 'forward' AS direction, source AS key, target AS value FROM {{v_aliases}} WHERE source NOT IN (SELECT source FROM pairs)
  UNION ALL SELECT 'forward', source, target FROM pairs
  UNION ALL SELECT 'reverse', target, source FROM {{v_aliases}}
  UNION ALL SELECT 'reverse', target, alias FROM fresh WHERE target NOT IN (SELECT target FROM {{v_aliases}})""")
def _learned(w):
    reverse = mapping.combine_reverse(mapping.reverse_map(w.v_aliases))
    new_forward, new_reverse = resolve.learned_pairs(_resolved(w), _forward(w), reverse)
    return new_forward.select(F.lit("forward").alias("direction"), F.col("source").alias("key"), F.col("target").alias("value")).unionByName(
        new_reverse.select(F.lit("reverse").alias("direction"), F.col("target").alias("key"), F.col("alias").alias("value")))
