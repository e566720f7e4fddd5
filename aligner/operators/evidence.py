"""Evidence from crawled pages: search records, page text, snippet and page strategies, costs, combined text.

Search records are rows ``(query_id, rank, url, title, snippet)``; pages add ``html``, ``status`` and ``content_type``.
"""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.functions.text import trimmed

# Lists and limits that decide results.
SKIP_EXTENSIONS = [".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"]
SKIP_DOMAINS = ["linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com"]
STRIP_TAGS = ["script", "style", "nav", "header", "footer"]
KEYWORD_SEPARATORS = ["/", "-"]
MIN_PAGE_TEXT = 50
TITLE_LENGTH = 100
MAX_SITES = 7
CONTENT_CHAR_LIMIT = 800
MIN_KEYWORD_LENGTH = 3
FALLBACK_KEYWORDS = 8
RAW_CONTENT_LIMIT = 5000
PER_SITE_LIMIT = 500


def framed_query(query: Column, prefix: str = "", suffix: str = "") -> Column:
    return trimmed(F.concat(F.lit(prefix + " " if prefix else ""), query, F.lit(" " + suffix if suffix else "")))


def search_records(hits: DataFrame) -> DataFrame:
    """Raw search hits (url, title, description, extra_snippets) as records; only http(s) URLs are kept."""
    parts = F.filter(F.concat(F.array(F.coalesce("description", F.lit(""))),
                              F.coalesce("extra_snippets", F.array().cast("array<string>"))), lambda p: p != "")
    kept = [c for c in hits.columns if c not in ("title", "description", "extra_snippets")]
    return hits.filter(F.col("url").startswith("http")).select(
        *kept, F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")).alias("title"),
        trimmed(F.array_join(parts, "\n")).alias("snippet"))


_NAMED = {name[:-1]: char for name, char in _html.entities.html5.items() if name.endswith(";")} | {"nbsp": " "}


def _unescaped(col: Column) -> Column:
    """Character references decoded once: decimal, hexadecimal and the standard's names; unknown ones stay."""
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    digits = lambda part: F.regexp_extract(part, r"^&#([0-9]+);", 1)
    hexed = lambda part: F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]+);", 1)

    def character(code: Column) -> Column:
        usable = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def decoded(part: Column) -> Column:
        code = F.coalesce(F.nullif(digits(part), F.lit("")).try_cast("long"), F.conv(F.nullif(hexed(part), F.lit("")), 16, 10).try_cast("long"))
        named = F.try_element_at(names, F.regexp_extract(part, r"^&([A-Za-z][A-Za-z0-9]*);", 1))
        numeric = part.rlike(r"^&#([0-9]+|[xX][0-9a-fA-F]+);")
        char = F.when(numeric, F.coalesce(character(code), F.lit("\ufffd"))).otherwise(named)
        return F.when(char.isNull(), part).otherwise(F.concat(char, F.regexp_extract(part, "(?s)^&[^;]*;(.*)$", 1)))

    parts = F.transform(F.split(col, "(?=&)"), lambda p: F.when(p.startswith("&"), decoded(p)).otherwise(p))
    return F.when(F.contains(col, F.lit("&")), F.array_join(parts, "")).otherwise(col)


def page_text(html: Column, max_bytes: int | None = None) -> Column:
    """Visible text of a page: comments, stripped blocks and tags removed, white space collapsed.

    The whole page is read unless ``max_bytes`` cuts it first. Well-formed markup is the contract.
    """
    if max_bytes is not None:
        html = F.decode(F.substring(html.cast("binary"), 1, max_bytes), "UTF-8")
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in STRIP_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = _unescaped(F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", ""))  # a lone < is text
    return F.regexp_replace(trimmed(text), r"\s+", " ")


def page_title(html: Column, url: Column, length: int = TITLE_LENGTH) -> Column:
    """The title element cut to ``length``; without one, the last path segment of the URL."""
    has_title = html.rlike(r"(?i)<title[^>]*>")
    title = trimmed(_unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(has_title, F.substring(title, 1, length)).otherwise(F.element_at(F.split(url, "/"), -1))


def page_filter(pages: DataFrame, char_limit: int = CONTENT_CHAR_LIMIT, max_bytes: int | None = None,
                host_exact: bool = False, min_text: int = MIN_PAGE_TEXT) -> DataFrame:
    """Pages with ``rejection`` (null when usable), ``page_title`` and ``content``.

    Extensions and domains are substring tests on the lower-case URL, as in the reference behaviour;
    ``host_exact`` compares domains with the host and its parents instead.
    """
    url = F.lower("url")
    any_of = lambda tests: F.array_max(F.array(*tests))
    if host_exact:
        host = F.concat(F.lit("."), F.regexp_extract(url, r"^https?://(?:[^@/]*@)?([^/:?#]+)", 1))
        domain_hit = any_of([host.endswith("." + d) for d in SKIP_DOMAINS])
    else:
        domain_hit = any_of([F.contains(url, F.lit(d)) for d in SKIP_DOMAINS])
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    pdf = F.contains(kind, F.lit("pdf")) | url.endswith(".pdf")
    textual = F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text"))
    text = page_text(F.col("html"), max_bytes)
    rejection = (
        F.when(any_of([F.contains(url, F.lit(e)) for e in SKIP_EXTENSIONS]), "skip_extension")
        .when(domain_hit, "skip_domain")
        .when(F.col("status") != 200, F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(pdf | ~textual, "non_html")
        .when(F.length("text") < min_text, "too_short")
    )
    return (
        pages.withColumn("text", text).withColumn("rejection", rejection)
        .withColumn("page_title", page_title(F.col("html"), F.col("url")))
        .withColumn("content", F.when(F.col("rejection").isNull(), F.substring("text", 1, char_limit)))
        .drop("text", "html")
    )


def evidence_snippets(records: DataFrame, max_sites: int = MAX_SITES, char_limit: int = CONTENT_CHAR_LIMIT) -> DataFrame:
    """The first ``max_sites`` records per query, of those the ones with a snippet, cut to the limit."""
    first = Window.partitionBy("query_id").orderBy("rank")
    return (
        records.select("query_id", "rank", "title", "url", "snippet")
        .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max_sites).filter(F.col("snippet") != "")
        .select("query_id", "rank", "title", "url", F.substring("snippet", 1, char_limit).alias("content"))
    )


def evidence_pages(filtered: DataFrame, max_sites: int = MAX_SITES, char_limit: int = CONTENT_CHAR_LIMIT,
                   snippet_fallback: bool = True) -> DataFrame:
    """In rank order the page text, else (hybrid) the snippet, until ``max_sites`` sources are kept.

    Only usable rows are ranked, so Spark keeps the first ``max_sites`` of a query before the shuffle however many
    pages a query has.
    """
    page_ok = F.col("rejection").isNull()
    usable = page_ok | (F.col("snippet") != "") if snippet_fallback else page_ok
    first = Window.partitionBy("query_id").orderBy("rank")
    return (
        filtered.filter(usable).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max_sites)
        .select("query_id", "rank", F.when(page_ok, F.col("page_title")).otherwise(F.col("title")).alias("title"), "url",
                F.when(page_ok, F.col("content")).otherwise(F.substring("snippet", 1, char_limit)).alias("content"))
    )


def scrape_stats(filtered: DataFrame, kept: DataFrame, max_sites: int = MAX_SITES) -> DataFrame:
    """Pages tried, usable and failed per query, counted up to the source that filled the cap."""
    filled = kept.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= max_sites, F.max("rank")).alias("last_rank"))
    tried = filtered.join(filled, "query_id", "left").filter(F.col("last_rank").isNull() | (F.col("rank") <= F.col("last_rank")))
    ok = F.col("rejection").isNull()
    return tried.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("scrape_attempts"), F.count(F.when(ok, 1)).alias("scrape_ok"),
        F.count(F.when(~ok, 1)).alias("scrape_failed"))


def web_cost(queries: DataFrame, kept: DataFrame, stats: DataFrame | None, strategy: str, searched: bool = True) -> DataFrame:
    """Cost row per query: strategy, metered search queries, evidence characters and page counts."""
    chars = kept.groupBy("query_id").agg(F.sum(F.length("content")).cast("long").alias("evidence_chars"))
    out = queries.select("query_id").join(chars, "query_id", "left")
    counts = ("scrape_attempts", "scrape_ok", "scrape_failed")
    if stats is not None:
        out = out.join(stats, "query_id", "left")
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in counts})
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("query_id", F.lit(strategy).alias("strategy"), F.lit(int(searched)).alias("search_queries"),
                      zero("evidence_chars"), *[zero(c) for c in counts])


def evidence_warnings(queries: DataFrame, kept: DataFrame, max_sites: int = MAX_SITES, skipped: bool = False,
                      upstream: DataFrame | None = None) -> DataFrame:
    """Queries short of evidence: fewer sources than asked for, or none.

    ``upstream`` gives ``(query_id, code, kind)`` for the queries whose search failed, as ``http_warning`` classifies them; it
    explains their missing evidence.
    """
    counts = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("usable"))
    usable = F.coalesce("usable", F.lit(0).cast("long"))
    missing = (usable == 0) & F.lit(not skipped)
    asked = queries.select("query_id").distinct().join(counts, "query_id", "left")
    if upstream is None:
        asked = asked.withColumns({"_code": F.lit(None).cast("string"), "_kind": F.lit(None).cast("string")})
    else:
        asked = asked.join(upstream.select("query_id", F.col("code").alias("_code"), F.col("kind").alias("_kind")), "query_id", "left")
    code = F.when((usable > 0) & (usable < max_sites), "low_document_count").when(missing, F.coalesce("_code", F.lit("no_results")))
    return (
        asked.select("query_id", F.lit("web_search").alias("step"), code.alias("code"),
                     F.coalesce(F.when(missing, F.col("_kind")), F.lit("transient")).alias("kind"),
                usable.alias("usable"), F.lit(max_sites).alias("target"))
        .filter(F.col("code").isNotNull())
    )


def fallback_keywords(query: Column, most: int = FALLBACK_KEYWORDS) -> Column:
    """First keywords of a query: split on separators and white space, long enough ones only."""
    spaced = query
    for sep in KEYWORD_SEPARATORS:
        spaced = F.replace(spaced, F.lit(sep), F.lit(" "))
    words = F.filter(F.split(spaced, r"\s+"), lambda w: F.length(w) >= MIN_KEYWORD_LENGTH)
    return F.slice(words, 1, most)


def combined_text(queries: DataFrame, kept: DataFrame, per_site: int = PER_SITE_LIMIT, limit: int = RAW_CONTENT_LIMIT) -> DataFrame:
    """Research context per query: numbered sources after a heading, or keywords when there is no evidence.

    ``kept`` holds at most ``max_sites`` rows per query, so gathering them is bounded. Only the joined sources are
    cut, not the heading.
    """
    blocks = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "content"))).alias("s"))
    numbered = F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit("\n"),
                                                      F.substring(x["content"], 1, per_site)))
    sources = F.substring(F.array_join(numbered, "\n\n"), 1, limit)
    fallback = F.concat(F.lit("Query contains terms: "), F.array_join(fallback_keywords(F.col("query")), ", "))
    return queries.select("query_id", "query").join(blocks, "query_id", "left").select(
        "query_id", F.concat(F.lit("Research about: "), F.col("query"), F.lit("\n\n"), F.coalesce(sources, fallback)).alias("combined_text"))
