"""Queries: file sources and sinks. Rows of a workload view are written in the layout, then read through the operator."""

import functools

from pyarrow import fs
from pyspark.sql import functions as F

from aligner.operators import matchdb
from aligner.operators import telemetry as tel
from aligner.plans.catalog_telemetry import _ITEM, _TID, SPANS, _export, records
from aligner.plans.registry import query
from aligner.session import new_path
from aligner.sources import files, sinks


def _written(df, name, fmt="json", **options):
    path = new_path(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("src_reference_table", "SELECT CAST(p_partkey AS VARCHAR) AS row_id, nullif(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END, '') AS alias, p_brand AS reference FROM {part}")
def _reference(w):
    sheet = w.part.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("alias"), F.col("p_brand").alias("reference"))
    return files.read_reference_table(w.spark, _written(sheet, "sheet", "csv", header=True))


@query("src_mappings_tsv", """SELECT p_name AS bom_material, CASE WHEN p_partkey % 10 = 0 THEN '--' WHEN p_partkey % 10 = 1 THEN '' ELSE concat(p_brand, chr(9), p_type) END AS dataset_entry
  FROM {part} WHERE p_partkey % 100 <> 50 AND p_partkey % 100 <> 51""")
def _mappings(w):
    key = F.col("p_partkey")
    entry = F.when(key % 10 == 0, "\t -- ").when(key % 10 == 1, "").otherwise(F.concat(F.lit("\t"), F.col("p_brand"), F.lit("\t"), F.col("p_type")))
    line = F.when(key % 100 == 50, F.concat(F.lit(files.MAPPINGS_HEADER), F.lit("\tEntry"))).when(key % 100 == 51, "   ").otherwise(F.concat(F.lit(" "), F.col("p_name"), entry))
    return files.read_mappings_tsv(w.spark, _written(w.part.select(line.alias("value")), "mappings", "text"))


def _with_broken(df, share):
    """JSON lines of ``df`` with every ``share``-th line cut so that it is no JSON any more."""
    return df.select(F.when(F.col("n") % share == 0, F.concat(F.lit('{"id": "'), F.col("n").cast("string"))).otherwise(F.to_json("row")).alias("value"))


@query("src_traces", f"""SELECT {_TID} AS id, source AS query, target, method, confidence FROM {{v_records}} WHERE trace_id % 50 <> 0""")
def _traces(w):
    r = records(w)
    rows = tel.build_traces(r.withColumn("tid", F.col("trace_id")))
    keyed = rows.join(r.select(tel.trace_key().alias("id"), F.col("trace_id").alias("n")), "id")
    path = _written(_with_broken(keyed.select("n", F.struct(*rows.columns).alias("row")), 50), "traces", "text")
    return files.read_traces(w.spark, path).select("id", "input.query", "output.target", "output.method", "output.confidence")


@query("src_observations", f"""WITH o AS (SELECT {_TID} AS trace_id, unnest(list_filter([CASE WHEN n_web > 0 THEN 'web_search' END, CASE WHEN core_concept IS NOT NULL THEN 'entity_profiling' END,
    CASE WHEN n_tokens > 0 THEN 'token_matching' END, CASE WHEN n_ranked > 0 THEN 'llm_ranking' END, CASE WHEN method = 'DirectPrompt' THEN 'direct_mapping' END], lambda x: x IS NOT NULL)) AS name
  FROM {{v_records}}) SELECT trace_id, name FROM o""")
def _observations(w):
    return files.read_observations(w.spark, _written(tel.build_observations(records(w)), "observations")).select("trace_id", "name")


@query("src_scores", f"""SELECT {_TID} AS trace_id, 'confidence' AS name, round(confidence, 6) AS value FROM {{v_records}}
  UNION ALL SELECT {_TID}, 'latency_ms', round(total_time * 1000, 6) FROM {{v_records}} WHERE total_time <> 0""")
def _scores(w):
    return files.read_scores(w.spark, _written(tel.build_scores(records(w)), "scores")).select("trace_id", "name", F.round("value", 6).alias("value"))


@query("src_dataset_items", f"SELECT DISTINCT {_ITEM} AS id, source AS query, 'ACTIVE' AS status FROM {{v_records}}")
def _items(w):
    items = tel.build_dataset_items(records(w)).drop("created_at")
    return files.read_dataset_items(w.spark, _written(items, "datasets")).select("id", "input.query", "status")


@query("src_event_log", f"SELECT 'pipeline' AS event, {_TID} AS trace_id, source AS query, target, method, confidence, batch_id FROM {{v_records}}")
def _event_log(w):
    return files.read_event_log(w.spark, _written(tel.build_events(records(w)), "events")).select("event", "trace_id", "query", "target", "method", "confidence", "batch_id")


@query("src_eval_results", "SELECT concat('q', l_orderkey) AS query, l_discount > 0.05 AS correct, l_extendedprice AS score FROM {lineitem} WHERE l_linenumber <> 4")
def _eval(w):
    rows = w.lineitem.select(F.when(F.col("l_linenumber") == 4, F.lit(0)).otherwise(F.lit(1)).alias("n"), F.struct(
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query"), (F.col("l_discount") > 0.05).alias("correct"), F.col("l_extendedprice").alias("score")).alias("row"))
    return files.read_eval_results(w.spark, _written(_with_broken(rows, 4), "evaluation", "text")).select("query", "correct", "score")


def run_files(w):
    """Files of the runs' folders as (path, content): meta, one param, a metric series and an artifact per run."""
    root = F.concat(F.lit("/exp/"), F.col("experiment_id").cast("string"), F.lit("/"), F.col("run_id").cast("string"))
    meta = F.concat_ws("\n", F.concat(F.lit('run_id: "'), F.col("run_id").cast("string"), F.lit('"')), F.concat(F.lit("name: run: "), F.col("run_id").cast("string")),
                       F.concat(F.lit("status: "), F.col("status")), F.lit("end_time: None"))
    runs = w.v_runs
    one = lambda name, content: runs.select(F.concat(root, F.lit(name)).alias("path"), content.alias("content"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))),
                                     lambda x: F.concat_ws(" ", x["line_no"].cast("string"), x["value"].cast("string"), F.lit("0"))), "\n")
    series = w.v_metrics.groupBy("run_id").agg(lines.alias("content")).join(runs, "run_id").select(F.concat(root, F.lit("/metrics/loss")).alias("path"), F.concat("content", F.lit("\n")).alias("content"))
    return one("/meta.yaml", meta).unionByName(one("/params/status", F.col("status"))).unionByName(series).unionByName(one("/artifacts/pipeline_config.json", F.lit("{}")))


_TREES = {}


def _tree(w):
    """The same written as a tree of archived runs and read from it, the paths from its root on; a session's queries share the tree of their tables."""
    key = (w.spark.sparkContext.applicationId, w.sf_dir)
    if key not in _TREES:
        _TREES[key] = sinks.write_filestore(run_files(w), new_path(w.spark, "filestore"), archives=True)
    root = _TREES[key]
    tree = files.read_filestore(w.spark, f"{root}/exp", names_only="artifacts")
    return tree.withColumn("path", F.substr("path", F.lit(len(fs.FileSystem.from_uri(root)[1]) + 1)))


@query("src_filestore_meta", """SELECT concat('/exp/', experiment_id, '/', run_id, '/meta.yaml') AS path, unnest(['run_id', 'name', 'status', 'end_time']) AS key,
    unnest([CAST(run_id AS VARCHAR), concat('run: ', run_id), status, NULL]) AS value, unnest([run_id, NULL, NULL, NULL]) AS int_value FROM {v_runs}""")
def _meta(w):
    return files.parse_meta(_tree(w).filter(F.col("path").endswith("/meta.yaml")))


_LAST = "(SELECT run_id, arg_max(value, row(line_no, value)) AS value FROM {v_metrics} GROUP BY run_id)"


@query("src_filestore_fields", f"""SELECT concat('/exp/', experiment_id, '/', run_id) AS run_path, 'params' AS field, 'status' AS key, NULL::DOUBLE AS number FROM {{v_runs}}
  UNION ALL SELECT concat('/exp/', experiment_id, '/', r.run_id), 'metrics', 'loss', m.value FROM {{v_runs}} r JOIN {_LAST} m ON m.run_id = r.run_id""")
def _fields(w):
    return files.parse_fields(_tree(w)).drop("value")


@query("run_detail", f"""SELECT concat('/exp/', experiment_id, '/', r.run_id) AS run_path, CAST(r.run_id AS VARCHAR) AS run_id, status, status AS param, m.value AS loss, 'pipeline_config.json' AS artifacts
  FROM {{v_runs}} r LEFT JOIN {_LAST} m ON m.run_id = r.run_id""")
def _detail(w):
    d = files.run_detail(_tree(w))
    return d.select("run_path", F.col("meta")["run_id"].alias("run_id"), F.col("meta")["status"].alias("status"), F.col("params")["status"].alias("param"),
                    F.col("metrics")["loss"].cast("double").alias("loss"), F.array_join("artifacts", ",").alias("artifacts"))


@query("trace_full_view", f"""WITH {SPANS} SELECT s.trace_id, t.session_id, 'alignment_pipeline' AS name, 3 AS n_tags, s.span_id, s.parent_id, s.span_type, s.inputs, s.outputs
  FROM spans s JOIN t ON t.id = s.trace_id""")
def _trace_view(w):
    traces, observations, scores = _export(w)
    info = tel.convert_trace_info(traces)
    entry = lambda field, column: info.select("trace_id", F.explode(column).alias("key", "content")).select(
        F.concat(F.lit("/exp/1/traces/"), F.col("trace_id"), F.lit(f"/{field}/"), F.col("key")).alias("path"), "content")
    listed = entry("request_metadata", "request_metadata").unionByName(entry("tags", "tags"))
    spans = tel.convert_spans(traces, observations, scores, F.col("line"), ["line", "price"])
    view = files.trace_full_view(listed, spans)
    return view.select("trace_id", F.col("request_metadata")["session_id"].alias("session_id"), F.col("tags")["traceName"].alias("name"),
                       F.size("tags").alias("n_tags"), "span_id", "parent_id", "span_type", "inputs", "outputs")


@query("src_run_traces", f"SELECT {_TID} AS id, source AS query, target FROM {{v_records}}")
def _run_traces(w):
    path = _written(tel.build_traces(records(w)), "run-traces")
    return files.read_run_traces(w.spark, path, multi_line=False, glob="*.json").select("id", "input.query", "output.target")


_ALIASES = """SELECT target, source, trace_id, method FROM {v_results} WHERE target <> 'No matches found'
  QUALIFY row_number() OVER (PARTITION BY target, source ORDER BY ts DESC, trace_id) = 1"""


@query("src_match_db", _ALIASES)
def _match_db(w):
    return files.read_match_db(w.spark, sinks.write_match_db(matchdb.rebuild_aliases(w.v_results))).select("target", "source", "trace_id", "method")


@query("sink_match_db", f"SELECT count(*) AS aliases, count(DISTINCT target) AS targets FROM ({_ALIASES})")
def _sink_db(w):
    path = sinks.write_match_db(matchdb.rebuild_aliases(w.v_results), new_path(w.spark, "snapshots"), "v1")
    return files.read_match_db(w.spark, path).agg(F.count(F.lit(1)).alias("aliases"), F.count_distinct("target").alias("targets"))


@query("sink_telemetry", f"""WITH r AS (SELECT *, CASE WHEN method = 'cached' THEN 1.0 ELSE confidence END AS conf FROM {{v_results}} WHERE method IN ('cached', 'fuzzy'))
  SELECT 'traces' AS kind, {_TID} AS id, source AS name, conf AS value FROM r
  UNION ALL SELECT 'observations', {_TID}, CASE WHEN method = 'cached' THEN 'cache_lookup' ELSE 'fuzzy_matching' END, NULL FROM r
  UNION ALL SELECT 'scores', {_TID}, 'confidence', conf FROM r
  UNION ALL SELECT 'scores', {_TID}, 'latency_ms', round(total_time * 1000, 6) FROM r WHERE total_time <> 0
  UNION ALL SELECT 'events', {_TID}, concat(method, ' ', target), conf FROM r
  UNION ALL SELECT DISTINCT 'items', {_ITEM}, source, NULL::DOUBLE FROM r""")
def _sink_telemetry(w):
    """Two attempts of a run, of which the later one counts."""
    root, short = new_path(w.spark, "telemetry"), tel.log_short_circuit(w.v_results)
    sinks.write_telemetry(tel.log_short_circuit(w.v_results.filter("method = 'cached'")), root, "r1")
    sinks.write_telemetry(short, root, "r1")
    none = F.lit(None).cast("double")
    shown = {"traces": ("id", F.col("input.query"), F.col("output.confidence")), "observations": ("trace_id", F.col("name"), none),
             "scores": ("trace_id", F.col("name"), F.round("value", 6)), "events": ("trace_id", F.concat_ws(" ", "method", "target"), F.col("confidence")),
             "items": ("id", F.col("input.query"), none)}
    parts = [files.read_committed(w.spark, root, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), name.alias("name"), value.alias("value"))
             for kind, (key, name, value) in shown.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)
