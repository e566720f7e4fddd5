"""Queries: match database and history."""

from pyspark.sql import functions as F

from aligner.operators import matchdb as db
from aligner.plans.registry import query

_VERIFIED = "(method IN ('UserChoice', 'DirectEdit', 'cached', 'fuzzy') OR confidence >= 0.8)"
_ALIASES = f"""usable AS (SELECT * FROM {{v_results}} WHERE target <> 'No matches found' AND target <> '' AND source <> ''),
  aliases AS (SELECT target, source, ts, trace_id, method, confidence, {_VERIFIED} AS verified FROM usable
    QUALIFY row_number() OVER (PARTITION BY target, source ORDER BY ts DESC, trace_id) = 1)"""


def with_web_sources(records):
    """Records of the fuzzy and ranked methods carry one or two web sources, the others none."""
    n = F.when(F.col("method").isin("fuzzy", "ProfileRank"), F.col("trace_id") % 3).otherwise(F.lit(0)).cast("int")
    page = lambda i: F.struct(F.concat(F.lit("page "), i.cast("string")).alias("title"),
                              F.concat(F.lit("http://w/"), F.col("trace_id").cast("string"), F.lit("/"), i.cast("string")).alias("url"))
    return records.withColumn("web_sources", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), page)).otherwise(
        F.array().cast("array<struct<title:string,url:string>>")))


@query("alias_verified", f"SELECT trace_id, {_VERIFIED} AS verified FROM {{v_results}}")
def _verified(w):
    return w.v_results.select("trace_id", db.alias_verified(F.col("method"), F.col("confidence")).alias("verified"))


@query("match_db_rebuild", f"WITH {_ALIASES} SELECT * FROM aliases")
def _rebuild(w):
    return db.rebuild_aliases(w.v_results)


@query("match_db_targets", f"""WITH {_ALIASES}, web AS (SELECT *, CASE WHEN method IN ('fuzzy', 'ProfileRank') THEN trace_id % 3 ELSE 0 END AS n FROM usable)
  SELECT target, min(ts) AS entry_ts, arg_min(trace_id, row(ts, trace_id)) AS entry_trace,
    coalesce(max(ts) FILTER (WHERE n > 0), min(ts)) AS last_updated,
    coalesce(arg_max(n, row(ts, trace_id)) FILTER (WHERE n > 0), -1) AS n_sources,
    arg_max(concat('http://w/', trace_id, '/1'), row(ts, trace_id)) FILTER (WHERE n > 0) AS first_url FROM web GROUP BY target""")
def _targets(w):
    targets = db.rebuild_targets(with_web_sources(w.v_results))
    return targets.select("target", "entry_ts", "entry_trace", "last_updated", F.coalesce(F.size("web_sources"), F.lit(-1)).alias("n_sources"),
                          F.get("web_sources", 0)["url"].alias("first_url"))


@query("match_db_upsert", f"WITH {_ALIASES} SELECT * FROM aliases")
def _upsert(w):
    cut = "2024-01-15 00:00:00"
    old, new = w.v_results.filter(F.col("ts") < cut), w.v_results.filter(F.col("ts") >= cut)
    return db.upsert_aliases(db.rebuild_aliases(old), new)


@query("alias_supersession", f"""WITH {_ALIASES}, latest AS (SELECT source, arg_max(target, row(ts, target)) AS latest FROM aliases GROUP BY source)
  SELECT a.target, a.source, a.ts, CASE WHEN l.latest <> a.target THEN l.latest END AS current_target
  FROM aliases a JOIN latest l ON l.source = a.source""")
def _supersession(w):
    return db.supersede(db.rebuild_aliases(w.v_results)).select("target", "source", "ts", "current_target")


@query("match_db_counts", f"""WITH {_ALIASES} SELECT count(DISTINCT target) AS identifiers, count(*) AS aliases,
  (SELECT count(*) FROM {{v_results}} WHERE source <> '' AND target <> '') AS records FROM aliases""")
def _counts(w):
    return db.match_db_counts(db.rebuild_aliases(w.v_results), w.v_results)


@query("target_by_source", f"""WITH {_ALIASES}, entries AS (SELECT target, min(row(ts, trace_id)) AS ord FROM usable GROUP BY target)
  SELECT a.source, arg_min(a.target, row(e.ord, a.target)) AS target FROM aliases a JOIN entries e ON e.target = a.target GROUP BY a.source""")
def _by_source(w):
    return db.target_by_source(db.rebuild_aliases(w.v_results), db.rebuild_targets(w.v_results))


@query("aliases_of_identifiers", f"""WITH {_ALIASES}, ids AS (SELECT DISTINCT concat('tgt ', CAST(c_nationkey * 2 AS STRING)) AS target FROM {{customer}})
  SELECT i.target, a.source, a.ts, a.method FROM ids i LEFT JOIN aliases a ON a.target = i.target""")
def _aliases_of(w):
    ids = w.customer.select(F.concat(F.lit("tgt "), (F.col("c_nationkey") * 2).cast("string")).alias("target"))
    return db.aliases_of(ids, db.rebuild_aliases(w.v_results)).select("target", "source", "ts", "method")


_MIXED = "SELECT *, lower(trim(s2)) AS key FROM (SELECT *, CASE WHEN trace_id % 2 = 0 THEN concat(' ', upper(source)) ELSE source END AS s2 FROM {v_results})"


def _mixed(w):
    mixed = F.when(F.col("trace_id") % 2 == 0, F.concat(F.lit(" "), F.upper("source"))).otherwise(F.col("source"))
    return w.v_results.withColumn("source", mixed)


@query("history_by_source", f"""SELECT key, trace_id, target, row_number() OVER (PARTITION BY key ORDER BY ts DESC, trace_id) - 1 AS position,
  count(*) OVER (PARTITION BY key) AS entries FROM ({_MIXED})""")
def _history(w):
    return db.history_by_source(_mixed(w)).select("key", "trace_id", "target", "position", "entries")


@query("history_recent", f"""WITH h AS ({_MIXED}), l AS (SELECT key, ts, trace_id, target, method, confidence, count(*) OVER (PARTITION BY key) AS entries FROM h
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, trace_id) = 1)
  SELECT * FROM l ORDER BY ts DESC, trace_id LIMIT 100""")
def _recent(w):
    return db.history_recent(_mixed(w), 100)


@query("event_list_recent", "SELECT trace_id, source, target FROM {v_results} ORDER BY ts DESC, trace_id LIMIT 999")
def _flat(w):
    return db.event_list_recent(w.v_results).select("trace_id", "source", "target")


@query("snapshot_freshness", """SELECT experiment_id, newest_run, newest_run > TIMESTAMP '1999-06-01' AS needs_rebuild,
    CAST(date_diff('second', TIMESTAMP '1999-06-01', TIMESTAMP '2002-01-01') AS BIGINT) AS age_seconds, true AS is_stale
  FROM (SELECT experiment_id, max(start_time) AS newest_run FROM {v_runs} GROUP BY experiment_id)""")
def _freshness(w):
    return db.snapshot_freshness(w.v_runs, "1999-06-01 00:00:00", "2002-01-01 00:00:00")


@query("session_usage", """SELECT session_id, target, count(*) AS times, max(queries) AS queries
  FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS queries FROM {v_results}) GROUP BY session_id, target""")
def _usage(w):
    return db.session_usage(w.v_results)
