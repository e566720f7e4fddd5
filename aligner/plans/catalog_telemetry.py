"""Queries: telemetry construction, corrections, diagnostics, trace conversion."""

from pyspark.sql import functions as F

from aligner.operators import telemetry as tel
from aligner.plans.registry import query

_TID = "concat(strftime(ts, '%y%m%d%H%M%S'), substr(md5(CAST(trace_id AS VARCHAR)), 1, 20))"
_ITEM = "concat('item-', substr(md5(source), 1, 24))"
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def records(w):
    """Records of the workload with their parts built from the sizes in the view."""
    def parts(n, make):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1))), make))

    site = lambda i: F.struct(F.concat(F.lit("page "), i.cast("string")).alias("title"), F.concat(F.lit("http://w/"), i.cast("string")).alias("url"))
    term = lambda i: F.struct(F.concat(F.lit("term "), i.cast("string")).alias("term"), (F.lit(1.0) / i).alias("score"))
    cand = lambda i: F.struct(F.concat(F.lit("term "), i.cast("string")).alias("name"), (F.lit(1.0) / i).alias("score"))
    return w.v_records.withColumns({
        "web_sources": parts("n_web", site), "token_matches": parts("n_tokens", term), "candidates": parts("n_ranked", cand),
        "entity_profile": F.when(F.col("core_concept").isNotNull(), F.to_json(F.struct("core_concept")))})


@query("build_traces", f"""SELECT {_TID} AS id, {_TS.format(c='ts')} AS timestamp, source AS query, target, method, confidence, CAST(session_id AS VARCHAR) AS user_id,
    concat_ws(';', concat('method=', method), 'provider=' || provider, 'batch_id=' || batch_id, 'user_prompt=' || user_prompt) AS metadata,
    'production' AS tags FROM {{v_records}}""")
def _traces(w):
    t = tel.build_traces(records(w))
    meta = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return t.select("id", _stamp("timestamp").alias("timestamp"), "input.query", "output.target", "output.method", "output.confidence", "user_id",
                    meta.alias("metadata"), F.array_join("tags", ",").alias("tags"))


_OBS = f"""obs AS (SELECT {_TID} AS trace_id, unnest(list_filter([
      CASE WHEN n_web > 0 THEN {{'type': 'span', 'name': 'web_search', 'model': NULL, 'n': n_web}} END,
      CASE WHEN core_concept IS NOT NULL THEN {{'type': 'generation', 'name': 'entity_profiling', 'model': coalesce(provider, 'unknown'), 'n': NULL}} END,
      CASE WHEN n_tokens > 0 THEN {{'type': 'span', 'name': 'token_matching', 'model': NULL, 'n': n_tokens}} END,
      CASE WHEN n_ranked > 0 THEN {{'type': 'generation', 'name': 'llm_ranking', 'model': coalesce(provider, 'unknown'), 'n': NULL}} END,
      CASE WHEN method = 'DirectPrompt' THEN {{'type': 'generation', 'name': 'direct_mapping', 'model': coalesce(provider, 'unknown'), 'n': NULL}} END],
      lambda x: x IS NOT NULL)) AS o FROM {{v_records}})"""
_SCORES = f"""scores AS (SELECT {_TID} AS trace_id, 'confidence' AS name, confidence AS value FROM {{v_records}}
    UNION ALL SELECT {_TID}, 'latency_ms', total_time * 1000 FROM {{v_records}} WHERE total_time <> 0)"""
_ITEMS = f"""items AS (SELECT {_ITEM} AS id, source AS query, min(ts) AS created_at, arg_max({_TID}, row(ts, trace_id)) AS source_trace_id
    FROM {{v_records}} GROUP BY source)"""


@query("build_observations", f"""WITH {_OBS} SELECT concat('obs-', substr(md5(concat(trace_id, '|', o.name)), 1, 12)) AS id, trace_id, o.type AS type,
    o.name AS name, o.model AS model, o.n AS n FROM obs""")
def _observations(w):
    n = F.get_json_object("output", "$.count").cast("int")
    return tel.build_observations(records(w)).select("id", "trace_id", "type", "name", "model", n.alias("n"))


@query("build_scores", f"WITH {_SCORES} SELECT trace_id, name, round(value, 6) AS value, 'NUMERIC' AS data_type FROM scores")
def _scores(w):
    return tel.build_scores(records(w)).select("trace_id", "name", F.round("value", 6).alias("value"), "data_type")


@query("build_dataset_items", f"""WITH {_ITEMS} SELECT id, query, {_TS.format(c='created_at')} AS created_at, source_trace_id, 'ACTIVE' AS status,
    NULL::VARCHAR AS expected FROM items""")
def _items(w):
    return tel.build_dataset_items(records(w)).select("id", "input.query", _stamp("created_at").alias("created_at"), "source_trace_id", "status",
                                                      F.col("expected_output.target").alias("expected"))


@query("build_events", f"""SELECT 'pipeline' AS event, {_TID} AS trace_id, {_ITEM} AS item_id, source AS query, target, method, confidence,
    round(total_time * 1000, 6) AS latency_ms, CAST(session_id AS VARCHAR) AS session_id, batch_id, user_prompt FROM {{v_records}}""")
def _events(w):
    return tel.build_events(records(w)).select("event", "trace_id", "item_id", "query", "target", "method", "confidence",
                                               F.round("latency_ms", 6).alias("latency_ms"), "session_id", "batch_id", "user_prompt")


@query("log_short_circuit", f"""WITH r AS (SELECT *, CASE WHEN method = 'cached' THEN 1.0 ELSE confidence END AS conf FROM {{v_results}} WHERE method IN ('cached', 'fuzzy'))
  SELECT {_TID} AS trace_id, 'trace' AS kind, method AS name, conf AS value FROM r
  UNION ALL SELECT {_TID}, 'observation', CASE WHEN method = 'cached' THEN 'cache_lookup' ELSE 'fuzzy_matching' END, NULL FROM r
  UNION ALL SELECT {_TID}, 'score', 'confidence', conf FROM r
  UNION ALL SELECT {_TID}, 'score', 'latency_ms', round(total_time * 1000, 6) FROM r WHERE total_time <> 0
  UNION ALL SELECT {_TID}, 'event', method, conf FROM r""")
def _short(w):
    t = tel.log_short_circuit(w.v_results)
    row = lambda df, kind, name, value: df.select("trace_id" if "trace_id" in df.columns else F.col("id").alias("trace_id"),
                                                  F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    return (
        row(t.traces, "trace", F.col("tags")[0], F.col("output.confidence"))
        .unionByName(row(t.observations, "observation", F.col("name"), F.lit(None).cast("double")))
        .unionByName(row(t.scores, "score", F.col("name"), F.round("value", 6)))
        .unionByName(row(t.events, "event", F.col("method"), F.col("confidence"))))


@query("report_step", """WITH final AS (SELECT * FROM {v_step_reports} WHERE target IS NOT NULL AND target <> '' AND method <> 'miss'),
  last AS (SELECT trace_id, arg_max(target, row(ts, report_id)) AS target, arg_max(confidence, row(ts, report_id)) AS confidence FROM final GROUP BY trace_id)
  SELECT 'trace' AS kind, trace_id, target AS name, confidence AS value FROM last
  UNION ALL SELECT 'observation', trace_id, step, NULL FROM {v_step_reports}
  UNION ALL SELECT 'score', trace_id, 'confidence', confidence FROM final
  UNION ALL SELECT 'score', trace_id, 'latency_ms', round(latency_ms, 4) FROM final WHERE latency_ms <> 0
  UNION ALL SELECT 'event', trace_id, target, confidence FROM final""")
def _report(w):
    t = tel.report_steps(w.v_step_reports)
    row = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), "trace_id", name.alias("name"), value.alias("value"))
    return (
        row(t.traces, "trace", F.col("output.target"), F.col("output.confidence"))
        .unionByName(row(t.observations, "observation", F.col("name"), F.lit(None).cast("double")))
        .unionByName(row(t.scores, "score", F.col("name"), F.round("value", 4)))
        .unionByName(row(t.events, "event", F.col("target"), F.col("confidence"))))


_CORR = f"""corr AS (SELECT trace_id AS correction_id, ts, CASE WHEN trace_id % 7 = 0 THEN concat('new ', source) ELSE source END AS source,
    target FROM {{v_corrections}}), {_ITEMS},
  latest AS (SELECT source, arg_max(target, row(ts, correction_id)) AS expected FROM corr GROUP BY source)"""


def _corrected(w):
    recs = records(w)
    corr = w.v_corrections.select(F.col("trace_id").alias("correction_id"), "ts",
                                  F.when(F.col("trace_id") % 7 == 0, F.concat(F.lit("new "), F.col("source"))).otherwise(F.col("source")).alias("source"), "target")
    return tel.apply_corrections(tel.build_dataset_items(recs), tel.build_traces(recs), corr)


@query("apply_corrections", f"""WITH {_CORR}, traces AS (SELECT {_TID} AS id, source, target, method, confidence FROM {{v_records}}),
  hit AS (SELECT i.source_trace_id AS id, l.expected FROM items i JOIN latest l ON l.source = i.query)
  SELECT 'item' AS kind, coalesce(i.id, concat('item-', substr(md5(l.source), 1, 24))) AS id, l.expected AS target, NULL::VARCHAR AS method
    FROM items i FULL JOIN latest l ON l.source = i.query
  UNION ALL SELECT 'trace', t.id, coalesce(h.expected, t.target), CASE WHEN h.expected IS NOT NULL THEN 'UserChoice' ELSE t.method END
    FROM traces t LEFT JOIN hit h ON h.id = t.id""")
def _apply(w):
    c = _corrected(w)
    return c.items.select(F.lit("item").alias("kind"), "id", F.col("expected_output.target").alias("target"), F.lit(None).cast("string").alias("method")).unionByName(
        c.traces.select(F.lit("trace").alias("kind"), "id", "output.target", "output.method"))


@query("correction_observations", f"""WITH {_CORR}, traces AS (SELECT {_TID} AS id, target FROM {{v_records}})
  SELECT c.correction_id_hash AS id, i.source_trace_id AS trace_id, coalesce(c.earlier, t.target) AS previous_target, c.target AS selected_target
  FROM (SELECT *, concat('obs-', substr(md5(CAST(correction_id AS VARCHAR)), 1, 12)) AS correction_id_hash,
      lag(target) OVER (PARTITION BY source ORDER BY ts, correction_id) AS earlier FROM corr) c
  JOIN items i ON i.query = c.source JOIN traces t ON t.id = i.source_trace_id""")
def _correction_obs(w):
    return _corrected(w).observations.select("id", "trace_id", "previous_target", "selected_target")


@query("item_full_view", f"""WITH {_ITEMS}, {_OBS}, {_SCORES}, traces AS (SELECT {_TID} AS id, target FROM {{v_records}}),
  parts AS (SELECT trace_id, 'observation' AS part, o.name AS name, o.type AS type, o.model AS model, NULL::DOUBLE AS value FROM obs UNION ALL SELECT trace_id, 'score', name, NULL, NULL, round(value, 6) FROM scores)
  SELECT i.id AS item_id, i.query, t.target, coalesce(p.part, 'none') AS part, p.name AS part_name, p.type AS part_type, p.model AS part_model, p.value FROM items i
  LEFT JOIN traces t ON t.id = i.source_trace_id LEFT JOIN parts p ON p.trace_id = i.source_trace_id""")
def _full(w):
    recs = records(w)
    view = tel.item_full_view(tel.build_dataset_items(recs), tel.build_traces(recs), tel.build_observations(recs), tel.build_scores(recs))
    return view.select("item_id", "input.query", "trace_output.target", "part", "part_name", "part_type", "part_model", F.round("value", 6).alias("value"))


def batch_events(w):
    """Start and completion events of the workload's batches; those of more than six items have not completed."""
    b = w.v_batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.count(F.when(F.col("role") == "user", 1)).alias("success_count"),
        F.count(F.when(F.col("role") != "user", 1)).alias("error_count"), F.sum("n_chars").cast("double").alias("total_time_ms"))
    none = lambda t: F.lit(None).cast(t)
    start = b.select(F.lit("batch_start").alias("event"), "batch_id", F.concat(F.lit("prompt "), F.col("batch_id").cast("string")).alias("user_prompt"), "item_count",
                     none("long").alias("success_count"), none("long").alias("error_count"), none("double").alias("total_time_ms"))
    done = b.filter(F.col("item_count") <= 6).select(F.lit("batch_complete").alias("event"), "batch_id", none("string").alias("user_prompt"), none("long").alias("item_count"),
                                                       "success_count", "error_count", "total_time_ms")
    began = F.col("batch_id") + 1_700_000_000
    lasted = F.when(F.col("batch_id") % 10 == 3, 2 * 86_400).otherwise(60)  # every tenth takes two days
    return start.withColumn("timestamp", F.timestamp_seconds(began)).unionByName(done.withColumn("timestamp", F.timestamp_seconds(began + lasted)))


@query("batch_summary", """WITH b AS (SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS ok, count(*) FILTER (WHERE role <> 'user') AS bad,
    CAST(sum(n_chars) AS DOUBLE) AS ms FROM {v_batches} GROUP BY batch_id)
  SELECT batch_id, concat('prompt ', batch_id) AS user_prompt, n AS item_count, CASE WHEN n <= 6 THEN ok END AS success_count,
    CASE WHEN n <= 6 THEN bad END AS error_count, CASE WHEN n <= 6 THEN ms END AS total_time_ms,
    CASE WHEN n <= 6 THEN round(ok / (ok + bad), 6) END AS success_rate, n AS linked FROM b""")
def _batches(w):
    return tel.batch_summary(batch_events(w), w.v_batches).drop("started_at").withColumn("success_rate", F.round("success_rate", 6))


_STATUS = """st AS (SELECT trace_id, step, arg_max(status, seq) AS status, arg_max(coalesce(elapsed, -1), seq) AS elapsed, min(seq) AS first_seq FROM {v_step_records} GROUP BY trace_id, step),
  wn AS (SELECT trace_id, step, count(*) AS n, count(*) FILTER (WHERE code = 'rate_limited') AS limited FROM {v_step_warnings} GROUP BY trace_id, step),
  dg AS (SELECT coalesce(st.trace_id, wn.trace_id) AS trace_id, coalesce(st.step, wn.step) AS step, coalesce(status, 'degraded') AS status, coalesce(n, 0) AS warnings,
    coalesce(limited, 0) AS limited FROM st FULL JOIN wn ON wn.trace_id = st.trace_id AND wn.step = st.step)"""


@query("step_diagnostics", f"WITH {_STATUS} SELECT trace_id, step, status, warnings, limited FROM dg")
def _diagnostics(w):
    limited = F.coalesce(F.try_element_at("codes", F.lit("rate_limited")), F.lit(0).cast("long"))
    return tel.step_diagnostics(w.v_step_records, w.v_step_warnings).select("trace_id", "step", "status", "warnings", limited.alias("limited"))


@query("step_timings", f"""WITH {_STATUS} SELECT trace_id, count(*) FILTER (WHERE status <> 'skipped') AS executed_steps,
    arg_max(step, first_seq) FILTER (WHERE status <> 'skipped') AS terminated_at,
    max(CASE WHEN step = 'web_search' THEN nullif(elapsed, -1) END) AS web_seconds FROM st GROUP BY trace_id""")
def _timings(w):
    return tel.step_timings(w.v_step_records).select("trace_id", "executed_steps", "terminated_at",
                                                     F.try_element_at("timings", F.lit("web_search")).alias("web_seconds"))


@query("run_outcome", f"""WITH {_STATUS} SELECT trace_id, CASE WHEN bool_or(status = 'failed') THEN 'fail'
    WHEN bool_or(warnings > 0 OR status NOT IN ('success', 'skipped')) THEN 'warn' ELSE 'ok' END AS outcome FROM dg GROUP BY trace_id""")
def _outcome(w):
    return tel.run_outcome(tel.step_diagnostics(w.v_step_records, w.v_step_warnings))


_HTTP = """(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 404 WHEN 5 THEN 422 END AS s FROM {events})"""


@query("http_warning_class", f"""SELECT event_id, CASE WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' WHEN s IN (401, 403, 404) THEN 'client_error'
    ELSE 'upstream_error' END AS code, CASE WHEN s = 429 OR s >= 500 THEN 'transient' ELSE 'structural' END AS kind,
    CASE WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' WHEN s IN (401, 403, 404) THEN 'client_error' ELSE 'schema_invalid' END AS model_code FROM {_HTTP}""")
def _http(w):
    codes = {0: 429, 1: 500, 2: 503, 3: 401, 4: 404, 5: 422}
    status = F.lit(None).cast("int")
    for k, v in codes.items():
        status = F.when(F.col("event_id") % 7 == k, v).otherwise(status)
    both = w.events.select("event_id", tel.http_warning(status).alias("u"), tel.http_warning(status, model_call=True).alias("m"))
    return both.select("event_id", "u.code", "u.kind", F.col("m.code").alias("model_code"))


@query("web_status", """SELECT event_id, CASE event_type WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'precomputed' WHEN 'error' THEN 'failed' ELSE 'success' END AS status FROM {events}""")
def _web_status(w):
    t = F.col("event_type")
    return w.events.select("event_id", tel.web_status(F.when(t == "view", "skipped").when(t == "click", "precomputed"),
                                                      F.when(t == "error", "no content")).alias("status"))


def _export(w):
    """Traces = orders, observations = line items, scores = price and priority."""
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("TIMEOUT")
    tid = lambda c: F.concat(F.lpad(F.col(c).cast("string"), 8, "0"), F.lit("-trace"))
    orders = w.orders.withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    traces = orders.select(
        tid("o_orderkey").alias("id"), F.lit(None).cast("string").alias("name"), F.col("t").alias("start_time"), (F.col("t") + 60).alias("end_time"),
        status.alias("status"), F.col("o_totalprice").alias("latency_ms"), F.to_json(F.struct(F.col("o_orderpriority").alias("query"))).alias("input"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("target"))).alias("output"),
        F.create_map(F.lit("session_id"), F.col("o_custkey").cast("string"), F.lit("run_id"), F.lit(None).cast("string")).alias("metadata"))
    kind = F.when(F.col("l_returnflag") == "R", "generation").when(F.col("l_returnflag") == "A", "span").otherwise("event")
    observations = w.lineitem.select(
        tid("l_orderkey").alias("trace_id"), kind.alias("type"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("name"),
        F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("input"), F.col("l_linestatus").alias("output"),
        F.when(F.col("l_returnflag") == "R", "m").alias("model"))
    scores = w.orders.select(tid("o_orderkey").alias("trace_id"), F.lit("price").alias("name"), F.round("o_totalprice", 2).alias("value"))
    return traces, observations, scores


_SQL_STATUS = "CASE o_orderstatus WHEN 'F' THEN '{0}' WHEN 'O' THEN '{1}' ELSE 'ERROR' END"
_SQL_TID = "concat(lpad(CAST({0} AS VARCHAR), 8, '0'), '-trace')"


SPANS = f"""t AS (SELECT {_SQL_TID.format('o_orderkey')} AS id, CAST(epoch(o_orderdate) AS BIGINT) * 1000000000 AS s, {_SQL_STATUS.format('OK', 'UNSET')} AS status,
    concat('{{"query":"', o_orderpriority, '"}}') AS inputs, concat('{{"target":"', o_orderstatus, '"}}') AS outputs, CAST(o_custkey AS VARCHAR) AS session_id FROM {{orders}}),
  o AS (SELECT {_SQL_TID.format('l_orderkey')} AS trace_id, l_returnflag, l_linestatus, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i FROM {{lineitem}}),
  spans AS (SELECT rpad(substr(id, 1, 16), 16, '0') AS span_id, id AS trace_id, NULL AS parent_id, 'alignment_pipeline' AS name, s AS start_ns, s + 60000000000 AS end_ns, status, 'CHAIN' AS span_type, inputs, outputs, 1 AS n_attributes, NULL AS model FROM t
  UNION ALL SELECT concat(substr(trace_id, 1, 8), lpad(lower(to_hex(i)), 8, '0')), trace_id, rpad(substr(id, 1, 16), 16, '0'),
    CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE concat('step_', i) END, s, s + 60000000000, 'OK',
    CASE l_returnflag WHEN 'R' THEN 'LLM' WHEN 'A' THEN 'CHAIN' ELSE 'UNKNOWN' END,
    concat('part ', l_partkey), l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, CASE WHEN l_returnflag = 'R' THEN 'm' END FROM o JOIN t ON t.id = o.trace_id)"""


@query("convert_spans", f"WITH {SPANS} SELECT * FROM spans")
def _spans(w):
    traces, observations, scores = _export(w)
    spans = tel.convert_spans(traces, observations, scores, F.col("line"), ["line", "price"])
    return spans.withColumns({"n_attributes": F.coalesce(F.size("attributes"), F.lit(0)), "model": F.col("attributes")["model"]}).drop("attributes")


@query("convert_trace_info", f"""SELECT {_SQL_TID.format('o_orderkey')} AS trace_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS request_time,
    CAST(trunc(o_totalprice) AS BIGINT) AS execution_duration_ms, {_SQL_STATUS.format('OK', 'IN_PROGRESS')} AS state,
    concat('{{"query":"', o_orderpriority, '"}}') AS request_preview, 'session_id' AS meta_keys, 3 AS n_tags FROM {{orders}}""")
def _info(w):
    info = tel.convert_trace_info(_export(w)[0])
    return info.select("trace_id", "request_time", "execution_duration_ms", "state", "request_preview",
                       F.array_join(F.map_keys("request_metadata"), ",").alias("meta_keys"), F.size("tags").alias("n_tags"))


@query("migrate_pending", f"""SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS migrated, count(*) FILTER (WHERE o_orderstatus = 'F') AS skipped FROM {{orders}}""")
def _migrate(w):
    traces = _export(w)[0]
    done = w.orders.filter(F.col("o_orderstatus") == "F").select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-trace")).alias("trace_id"))
    return tel.migrate_pending(traces, done)[1]
