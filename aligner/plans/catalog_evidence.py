"""Queries: evidence preparation from crawled pages."""

from pyspark.sql import functions as F

from aligner.operators import evidence as ev
from aligner.plans.registry import query


def _sql_text(x):
    text = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "header", "footer"):
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    return rf"regexp_replace(regexp_replace({_sql_unescaped(text)}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def _sql_unescaped(x):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_FILTERED = f"""cleaned AS (SELECT *, lower(url) AS u, {_sql_text('html')} AS body,
    substr(trim({_sql_unescaped("title")}), 1, 100) AS page_title FROM {{v_search_records}}),
  filtered AS (SELECT query_id, rank, page_id, url, title, snippet, page_title, CASE
      WHEN u LIKE '%.doc%' OR u LIKE '%.ppt%' OR u LIKE '%.xls%' THEN 'skip_extension'
      WHEN u LIKE '%linkedin.com%' OR u LIKE '%facebook.com%' OR u LIKE '%instagram.com%' OR u LIKE '%twitter.com%' OR u LIKE '%x.com%' THEN 'skip_domain'
      WHEN status <> 200 THEN concat('http_', status)
      WHEN content_type LIKE '%pdf%' OR u LIKE '%.pdf' OR NOT (content_type LIKE '%html%' OR content_type LIKE '%text%') THEN 'non_html'
      WHEN length(body) < 50 THEN 'too_short' END AS rejection, body FROM cleaned),
  pages2 AS (SELECT *, CASE WHEN rejection IS NULL THEN substr(body, 1, 800) END AS content FROM filtered)"""
_KEPT = f"""{_FILTERED},
  kept AS (SELECT query_id, rank, CASE WHEN rejection IS NULL THEN page_title ELSE title END AS title, url,
      CASE WHEN rejection IS NULL THEN content ELSE substr(snippet, 1, 800) END AS content
    FROM pages2 WHERE rejection IS NULL OR snippet <> ''
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3),
  filled AS (SELECT query_id, max(rank) AS last_rank FROM kept GROUP BY query_id HAVING count(*) >= 3),
  stats AS (SELECT p.query_id, count(*) AS scrape_attempts, count(*) FILTER (WHERE rejection IS NULL) AS scrape_ok,
      count(*) FILTER (WHERE rejection IS NOT NULL) AS scrape_failed
    FROM pages2 p LEFT JOIN filled f ON f.query_id = p.query_id WHERE f.last_rank IS NULL OR p.rank <= f.last_rank GROUP BY p.query_id)"""
_SITES = 3


def _filtered(w):
    return ev.page_filter(w.v_search_records)


def _queries(w):
    """One query per group of records: the first title, framed."""
    return w.v_search_records.groupBy("query_id").agg(F.min_by("title", "rank").alias("query"))


@query("search_records", """SELECT page_id, url, CASE WHEN title = '' THEN url ELSE title END AS title,
    trim(array_to_string(list_filter([CASE WHEN page_id % 3 = 0 THEN '' ELSE snippet END, title], lambda p: p <> ''), chr(10))) AS snippet,
    trim(concat('material ', title, ' data')) AS framed
  FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN concat('ftp://', url) ELSE url END AS url,
    CASE WHEN page_id % 4 = 0 THEN '' ELSE title END AS title, snippet FROM {v_search_records}) WHERE url LIKE 'http%'""")
def _records(w):
    hits = w.v_search_records.select(
        "page_id", F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("snippet")).alias("description"))
    hits = hits.withColumn("extra_snippets", F.array("title"))
    framed = hits.select("page_id", ev.framed_query(F.col("title"), "material", "data").alias("framed"))
    return ev.search_records(hits).join(framed, "page_id").select("page_id", "url", "title", "snippet", "framed")


@query("page_text", f"""SELECT page_id, {_sql_text('html')} AS body, substr(trim({_sql_unescaped(
    "regexp_extract(html, '<title>([^<]*)</title>', 1)")}), 1, 100) AS title FROM {{pages}}""")
def _page_text(w):
    return w.pages.select("page_id", ev.page_text(F.col("html")).alias("body"),
                          ev.page_title(F.col("html"), F.col("url")).alias("title"))


@query("page_filter", f"WITH {_FILTERED} SELECT page_id, rejection, content FROM pages2")
def _page_filter(w):
    return _filtered(w).select("page_id", "rejection", "content")


@query("evidence_snippets", f"""SELECT query_id, rank, title, url, substr(snippet, 1, 800) AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM {{v_search_records}}) WHERE n <= {_SITES} AND snippet <> ''""")
def _snippets(w):
    return ev.evidence_snippets(w.v_search_records, _SITES)


@query("evidence_hybrid", f"WITH {_KEPT} SELECT * FROM kept")
def _hybrid(w):
    return ev.evidence_pages(_filtered(w), _SITES)


@query("evidence_scrape", f"""WITH {_FILTERED} SELECT query_id, rank, page_title AS title, url, content FROM pages2
  WHERE rejection IS NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {_SITES}""")
def _scrape(w):
    return ev.evidence_pages(_filtered(w), _SITES, snippet_fallback=False)


@query("scrape_stats", f"WITH {_KEPT} SELECT * FROM stats")
def _stats(w):
    filtered = _filtered(w)
    return ev.scrape_stats(filtered, ev.evidence_pages(filtered, _SITES), _SITES)


@query("web_cost", f"""WITH {_KEPT}, chars AS (SELECT query_id, CAST(sum(length(content)) AS BIGINT) AS evidence_chars FROM kept GROUP BY query_id)
  SELECT q.query_id, 'hybrid' AS strategy, 1 AS search_queries, coalesce(c.evidence_chars, 0) AS evidence_chars,
    coalesce(scrape_attempts, 0) AS scrape_attempts, coalesce(scrape_ok, 0) AS scrape_ok, coalesce(scrape_failed, 0) AS scrape_failed
  FROM (SELECT DISTINCT query_id FROM {{v_search_records}}) q LEFT JOIN chars c ON c.query_id = q.query_id
  LEFT JOIN stats s ON s.query_id = q.query_id""")
def _cost(w):
    filtered = _filtered(w)
    kept = ev.evidence_pages(filtered, _SITES)
    return ev.web_cost(_queries(w), kept, ev.scrape_stats(filtered, kept, _SITES), "hybrid")


@query("evidence_warnings", f"""WITH {_FILTERED}, kept AS (SELECT query_id FROM pages2 WHERE rejection IS NULL
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 4),
  n AS (SELECT q.query_id, count(k.query_id) AS usable FROM (SELECT DISTINCT query_id FROM {{v_search_records}}) q
    LEFT JOIN kept k ON k.query_id = q.query_id GROUP BY q.query_id)
  SELECT query_id, 'web_search' AS step, CASE WHEN usable = 0 THEN 'no_results' ELSE 'low_document_count' END AS code,
    'transient' AS kind, usable, 4 AS target FROM n WHERE usable < 4""")
def _warnings(w):
    return ev.evidence_warnings(_queries(w), ev.evidence_pages(_filtered(w), 4, snippet_fallback=False), 4)


@query("keyword_fallback", r"""SELECT page_id, array_to_string(list_filter(string_split_regex(replace(replace(title, '/', ' '), '-', ' '), '\s+'),
    lambda w: length(w) >= 3)[1:8], ', ') AS keywords FROM {v_search_records}""")
def _keywords(w):
    return w.v_search_records.select("page_id", F.array_join(ev.fallback_keywords(F.col("title")), ", ").alias("keywords"))


@query("combined_text", f"""WITH {_FILTERED}, kept AS (SELECT query_id, rank, page_title, content,
      row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM pages2 WHERE rejection IS NULL QUALIFY i <= {_SITES}),
  q AS (SELECT query_id, arg_min(title, rank) AS query FROM {{v_search_records}} GROUP BY query_id),
  s AS (SELECT query_id, substr(string_agg(concat(i, '. ', page_title, chr(10), substr(content, 1, 500)), chr(10) || chr(10) ORDER BY i), 1, 5000) AS joined
    FROM kept GROUP BY query_id)
  SELECT q.query_id, concat('Research about: ', query, chr(10), chr(10), coalesce(joined, concat('Query contains terms: ',
    array_to_string(list_filter(string_split_regex(replace(replace(query, '/', ' '), '-', ' '), '\\s+'), lambda w: length(w) >= 3)[1:8], ', ')))) AS combined_text
  FROM q LEFT JOIN s ON s.query_id = q.query_id""")
def _combined(w):
    kept = ev.evidence_pages(_filtered(w), _SITES, snippet_fallback=False)
    return ev.combined_text(_queries(w), kept)
