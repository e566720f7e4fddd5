"""Workload views over the driver tables, written once in SQL that Spark and DuckDB both accept.

``{name}`` marks a table or another view: Spark gets DataFrames bound to the placeholders, the oracle
gets common table expressions of the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

VIEWS: dict[str, str] = {
    # catalogue of standard terms
    "v_terms": """
        SELECT DISTINCT concat_ws(' ', p_name, p_brand, p_type, concat('s', CAST(p_size AS STRING))) AS term
        FROM {part}""",
    # noisy strings to resolve, with the known answer: blank / alias / exact / normalised / one deletion /
    # partial / unknown word / padded
    "v_queries": """
        SELECT p_partkey AS query_id, term AS expected, CASE
          WHEN p_partkey % 50 = 7 THEN '   '
          WHEN p_partkey % 50 = 14 THEN concat_ws(' ', p_type, p_name, concat('no', CAST(p_partkey AS STRING)))
          WHEN p_partkey % 5 = 0 THEN term
          WHEN p_partkey % 5 = 1 THEN lower(replace(term, '#', ' '))
          WHEN p_partkey % 5 = 2 THEN concat(substr(term, 1, 2), substr(term, 4))
          WHEN p_partkey % 10 = 3 THEN concat_ws(' ', p_name, p_type)
          WHEN p_partkey % 10 = 8 THEN concat_ws(' ', p_name, 'item', p_brand)
          ELSE concat('  ', term, ' ') END AS query
        FROM (SELECT *, concat_ws(' ', p_name, p_brand, p_type, concat('s', CAST(p_size AS STRING))) AS term
              FROM {part}) p""",
    # forward map of the catalogue: alias -> term
    "v_aliases": """
        SELECT CAST(0 AS INT) AS source_id, p_partkey + 2 AS row_num,
          concat_ws(' ', p_type, p_name, concat('no', CAST(p_partkey AS STRING))) AS source,
          concat_ws(' ', p_name, p_brand, p_type, concat('s', CAST(p_size AS STRING))) AS target
        FROM {part}""",
    # two mapping sheets with blanks and duplicate aliases
    "v_mapping": """
        SELECT CAST(p_partkey % 2 AS INT) AS source_id, p_partkey + 2 AS row_num,
          CASE WHEN p_partkey % 23 = 0 THEN '' ELSE concat(' alias ',
            CAST(((CASE WHEN p_partkey % 50 = 3 THEN p_partkey - 2 ELSE p_partkey END) * 7) % 1500 AS STRING)) END AS source,
          CASE WHEN p_partkey % 29 = 0 THEN '' ELSE concat_ws(' ', p_name, p_brand) END AS target
        FROM {part}""",
    # pipeline results
    "v_results": """
        SELECT event_id AS trace_id, ts, user_id AS session_id, concat('src ', CAST(event_id % 211 AS STRING)) AS source,
          CASE WHEN event_id % 41 = 0 THEN 'No matches found'
               ELSE concat('tgt ', CAST((event_id * 13) % 37 AS STRING)) END AS target,
          CASE event_type WHEN 'view' THEN 'cached' WHEN 'purchase' THEN 'fuzzy' WHEN 'signup' THEN 'ProfileRank'
            WHEN 'error' THEN 'DirectPrompt' ELSE 'UserChoice' END AS method,
          CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS confidence, value / 10 AS total_time
        FROM {events}""",
    # full records: results with provider, batch and the sizes of their parts
    "v_records": """
        SELECT *, CASE WHEN method IN ('ProfileRank', 'DirectPrompt') THEN concat('model-', CAST(trace_id % 3 AS STRING)) END AS provider,
          CASE WHEN method = 'DirectPrompt' THEN CAST(trace_id % 17 AS STRING) END AS batch_id,
          CASE WHEN method = 'DirectPrompt' AND trace_id % 2 = 0 THEN 'map it' END AS user_prompt,
          CASE WHEN method = 'ProfileRank' THEN CAST(trace_id % 4 AS INT) ELSE 0 END AS n_web,
          CASE WHEN method = 'ProfileRank' AND trace_id % 5 > 0 THEN concat('thing ', source) END AS core_concept,
          CASE WHEN method = 'ProfileRank' THEN CAST(trace_id % 7 AS INT) ELSE 0 END AS n_tokens,
          CASE WHEN method = 'ProfileRank' AND target <> 'No matches found' THEN CAST(1 + trace_id % 3 AS INT) ELSE 0 END AS n_ranked
        FROM {v_results}""",
    # step records of traces: trace = order, step record = line item
    "v_step_records": """
        SELECT l_orderkey AS trace_id, CAST(l_linenumber AS DOUBLE) * 10000000 + l_extendedprice AS seq,
          CASE l_returnflag WHEN 'R' THEN 'llm_ranking' WHEN 'A' THEN 'token_matching' ELSE 'web_search' END AS step,
          CASE WHEN l_tax = 0.08 THEN 'failed' WHEN l_tax = 0.07 THEN 'degraded' WHEN l_tax = 0.06 THEN 'skipped'
            WHEN l_tax = 0.05 THEN 'precomputed' ELSE 'success' END AS status,
          CASE WHEN l_tax IN (0.06, 0.08) THEN NULL ELSE l_quantity / 10 END AS elapsed
        FROM {lineitem}""",
    "v_step_warnings": """
        SELECT l_orderkey AS trace_id, CASE WHEN l_linestatus = 'F' THEN 'web_search' ELSE 'entity_profiling' END AS step,
          CASE WHEN l_quantity < 3 THEN 'rate_limited' ELSE 'low_document_count' END AS code, 'transient' AS kind
        FROM {lineitem} WHERE l_quantity < 6""",
    # frontend step reports
    "v_step_reports": """
        SELECT event_id AS report_id, ts, event_id % 3000 AS trace_id,
          CASE event_type WHEN 'view' THEN 'cache_lookup' ELSE 'fuzzy_matching' END AS step, source,
          CASE WHEN event_type IN ('view', 'purchase') THEN target END AS target,
          CASE WHEN event_type = 'error' THEN 'miss' ELSE method END AS method, confidence, total_time * 1000 AS latency_ms
        FROM (SELECT e.event_id, e.event_type, r.ts, r.source, r.target, r.method, r.confidence, r.total_time
              FROM {events} e JOIN {v_results} r ON r.trace_id = e.event_id)""",
    "v_corrections": """
        SELECT trace_id, ts, source, target FROM {v_results}
        WHERE method = 'UserChoice' AND target <> 'No matches found'""",
    # raw search hits and the pages behind them
    "v_search_records": """
        SELECT CAST(floor(page_id / 6) AS BIGINT) AS query_id,
          CAST(page_id % 6 + 1 AS INT) AS rank, page_id, url,
          regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
          CASE WHEN page_id % 5 = 0 THEN '' ELSE substr(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 1, 120) END AS snippet,
          CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS status,
          CASE WHEN page_id % 7 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
          html
        FROM {pages}""",
    # experiments: experiment = customer, run = order, step / metric line = line item
    "v_runs": """
        SELECT o_custkey AS experiment_id, o_orderkey AS run_id, o_orderdate AS start_time, o_orderstatus AS status
        FROM {orders}""",
    "v_metrics": "SELECT l_orderkey AS run_id, l_linenumber AS line_no, l_extendedprice AS value FROM {lineitem}",
    "v_steps": """
        SELECT l_orderkey AS run_id, l_linenumber AS pos, l_extendedprice AS tiebreak,
          CASE l_returnflag WHEN 'R' THEN 'LLMGeneration' WHEN 'A' THEN 'DeterministicFunction'
            ELSE 'ExternalService' END AS type,
          CASE l_returnflag WHEN 'R' THEN 'llm_ranking' WHEN 'A' THEN 'token_matching' ELSE 'web_search' END AS name
        FROM {lineitem}""",
    # evaluation: queries = orders with the true term, ranked candidates = line items
    "v_truth": """
        SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 50 = 0 THEN '--' ELSE concat('t', CAST(o_custkey % 23 AS STRING)) END AS expected
        FROM {orders}""",
    "v_ranked": """
        SELECT l_orderkey AS query_id, CASE l_returnflag WHEN 'R' THEN 'llm_ranking' ELSE 'token_matching' END AS step,
          row_number() OVER (PARTITION BY l_orderkey, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_extendedprice) - 1 AS rank,
          concat('t', CAST(l_partkey % 23 AS STRING)) AS term
        FROM {lineitem}""",
    # predictions of several configurations per query
    "v_predictions": """
        SELECT l_orderkey AS query_id, concat(l_returnflag, l_linestatus) AS config, max(concat('t', CAST(l_suppkey % 23 AS STRING))) AS target,
          max(l_discount * 10) AS confidence, CASE max(l_linestatus) WHEN 'F' THEN 'cached' ELSE 'ProfileRank' END AS method,
          CASE max(l_returnflag) WHEN 'R' THEN 'snippets' WHEN 'A' THEN 'scrape' ELSE 'hybrid' END AS strategy,
          CAST(sum(l_quantity) AS BIGINT) AS evidence_chars, count(*) AS scrape_attempts
        FROM {lineitem} GROUP BY l_orderkey, concat(l_returnflag, l_linestatus)""",
    # cell-change stream
    "v_cells": """
        SELECT event_id AS seq, ts, user_id % 5 AS workbook, event_id % 40 AS row, CAST(user_id % 3 AS INT) AS col,
          event_type AS value FROM {events}""",
    # batch items, prompts and answers
    "v_batches": """
        SELECT conv_id AS batch_id, turn, role, text, length(text) AS n_chars FROM {conversations}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def referenced(sql: str) -> list[str]:
    names = dict.fromkeys(_PLACEHOLDER.findall(sql))
    return [n for n in names if n in VIEWS or n in TABLES]


def _unmarked(found: re.Match) -> str:
    return found[1] if found[1] in VIEWS or found[1] in TABLES else found[0]


class Workload:
    """Tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: getattr(self, name) for name in referenced(text)})


def oracle_text(sql: str) -> str:
    """Oracle SQL with the views it refers to put in front as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in referenced(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    plain = lambda text: _PLACEHOLDER.sub(_unmarked, text)
    ctes = [f"{name} AS ({plain(VIEWS[name])})" for name in needed]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
