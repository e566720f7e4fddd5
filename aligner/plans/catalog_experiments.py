"""Queries: experiment analytics and evaluation."""

from pyspark.sql import functions as F

from aligner.operators import evaluate as ev
from aligner.operators import experiments as ex
from aligner.operators import matchdb
from aligner.plans.registry import query


def _experiments(w):
    return w.customer.select(F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("name"),
                             F.floor(F.col("c_acctbal") * 100).cast("long").alias("creation_time"))


@query("list_experiments", """SELECT c_custkey AS experiment_id, c_name AS name, CAST(floor(c_acctbal * 100) AS BIGINT) AS creation_time, coalesce(n, 0) AS num_runs
  FROM {customer} LEFT JOIN (SELECT experiment_id, count(*) AS n FROM {v_runs} GROUP BY experiment_id) r ON r.experiment_id = c_custkey""")
def _list_experiments(w):
    return ex.list_experiments(_experiments(w), w.v_runs)


@query("list_runs", """SELECT experiment_id, run_id, status, total FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY start_time DESC, run_id) AS n,
    count(*) OVER (PARTITION BY experiment_id) AS total FROM {v_runs}) WHERE n > 2 AND n <= 7""")
def _list_runs(w):
    return ex.list_runs(w.v_runs, limit=5, offset=2).select("experiment_id", "run_id", "status", "total")


@query("list_traces", """SELECT trace_id, target, (SELECT count(*) FROM {v_results}) AS total FROM {v_results} ORDER BY ts DESC, trace_id LIMIT 500 OFFSET 100""")
def _list_traces(w):
    return ex.list_traces(w.v_results.withColumnRenamed("ts", "request_time"), limit=500, offset=100).select("trace_id", "target", "total")


@query("latest_metric", """SELECT run_id, arg_max(value, row(line_no, value)) AS value FROM {v_metrics} GROUP BY run_id""")
def _metric(w):
    series = w.v_metrics.select("run_id", F.struct("line_no", "value").alias("line_no"), F.col("value").cast("string").alias("value"))
    return ex.latest_metric(series, ["run_id"]).select("run_id", "value")


_NOTATION = """(SELECT run_id, string_agg(CASE type WHEN 'LLMGeneration' THEN concat('LLM', llm) WHEN 'DeterministicFunction' THEN 'TokenMatching' ELSE name END, '-'
    ORDER BY pos, tiebreak, type, name) AS notation FROM (SELECT *, count(*) FILTER (WHERE type = 'LLMGeneration')
      OVER (PARTITION BY run_id ORDER BY pos, tiebreak, type, name ROWS UNBOUNDED PRECEDING) AS llm FROM {v_steps}) GROUP BY run_id)"""


@query("pipeline_notation", f"SELECT run_id, notation FROM {_NOTATION}")
def _notation(w):
    return ex.pipeline_notation(w.v_steps, ["run_id"], ["pos", "tiebreak"])


@query("experiment_mappings", f"""WITH m AS (SELECT c_custkey AS experiment_id, count(p_partkey) AS mappings, count(*) FILTER (WHERE p_partkey % 10 = 0) AS no_match_rows
    FROM {{customer}} JOIN {{part}} ON p_partkey % 1500 = c_custkey GROUP BY c_custkey),
  e AS (SELECT l_orderkey AS run_id, count(*) AS evaluated, count(*) FILTER (WHERE l_discount > 0.05) AS correct FROM {{lineitem}} GROUP BY l_orderkey)
  SELECT c_custkey AS experiment_id, r.run_id, n.notation, coalesce(m.mappings, 0) AS mappings, coalesce(m.no_match_rows, 0) AS no_match_rows,
    coalesce(e.evaluated, 0) AS evaluated, coalesce(e.correct, 0) AS correct
  FROM {{customer}} LEFT JOIN m ON m.experiment_id = c_custkey LEFT JOIN {{v_runs}} r ON r.experiment_id = c_custkey
  LEFT JOIN {_NOTATION} n ON n.run_id = r.run_id LEFT JOIN e ON e.run_id = r.run_id""")
def _mappings(w):
    mappings = w.part.select((F.col("p_partkey") % 1500).alias("experiment_id"), F.col("p_name").alias("bom_material"),
                             F.when(F.col("p_partkey") % 10 == 0, "--").otherwise(F.col("p_brand")).alias("dataset_entry"))
    evaluations = w.lineitem.select(F.col("l_orderkey").alias("run_id"), (F.col("l_discount") > 0.05).alias("correct"))
    return ex.experiment_mappings(_experiments(w), mappings, w.v_runs, w.v_steps, evaluations)


@query("resolve_dependencies", """WITH s AS (SELECT DISTINCT p_type AS family, CASE WHEN p_size % 7 = 0 THEN 'latest' WHEN p_size % 2 = 0 THEN concat('v', p_size) ELSE CAST(p_size AS VARCHAR) END AS given,
      CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS asked FROM {part} WHERE p_brand <> 'Brand#1'),
  k AS (SELECT DISTINCT p_type AS family, p_size AS version FROM {part} WHERE p_name LIKE 'red %'),
  l AS (SELECT family, max(version) AS latest FROM k GROUP BY family),
  x AS (SELECT s.family, given, coalesce(asked, latest) AS version FROM s LEFT JOIN l ON l.family = s.family)
  SELECT 'prompt' AS kind, concat(x.family, '/', given) AS key, k.version, k.version IS NOT NULL AS resolved FROM x LEFT JOIN k ON k.family = x.family AND k.version = x.version
  UNION ALL SELECT DISTINCT 'config', p_brand, NULL, true FROM {part} WHERE p_brand IN (SELECT p_brand FROM {part} WHERE p_retailprice > 1000)""")
def _dependencies(w):
    size = F.col("p_size")
    given = F.when(size % 7 == 0, "latest").when(size % 2 == 0, F.concat(F.lit("v"), size.cast("string"))).otherwise(size.cast("string"))
    steps = w.part.select(F.col("p_brand").alias("config_id"), F.when(F.col("p_brand") != "Brand#1", "LLMGeneration").otherwise("ExternalService").alias("type"),
                          F.col("p_type").alias("name"), given.alias("prompt_version"))
    prompts = w.part.filter(F.col("p_name").startswith("red ")).select(F.col("p_type").alias("family"), size.alias("version"))
    configs = w.part.filter(F.col("p_retailprice") > 1000).select(F.col("p_brand").alias("config_id"))
    return ex.resolve_dependencies(steps, prompts, configs)


@query("list_datasets", "SELECT source AS dataset_name, count(*) AS items FROM {documents} GROUP BY source")
def _datasets(w):
    return ex.list_datasets(w.documents.select(F.col("source").alias("dataset_name"), F.col("doc_id").alias("id")))


@query("dataset_items_page", "SELECT doc_id AS id, source AS dataset_name, (SELECT count(*) FROM {documents}) AS total FROM {documents} ORDER BY doc_id DESC LIMIT 50 OFFSET 50")
def _items_page(w):
    return ex.dataset_items_page(w.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("dataset_name")), 50, 50)


@query("dataset_items_by_dataset", """SELECT doc_id AS id, source AS dataset_name, total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n,
    count(*) OVER (PARTITION BY source) AS total FROM {documents}) WHERE n > 3 AND n <= 8""")
def _items_by_dataset(w):
    return ex.dataset_items_page(w.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("dataset_name")), 5, 3, by_dataset=True)


@query("list_traces_by_experiment", """SELECT experiment_id, trace_id, total FROM (SELECT session_id AS experiment_id, trace_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, trace_id) AS n,
    count(*) OVER (PARTITION BY session_id) AS total FROM {v_results}) WHERE n <= 4""")
def _traces_by_experiment(w):
    traces = w.v_results.withColumnsRenamed({"ts": "request_time", "session_id": "experiment_id"})
    return ex.list_traces(traces, limit=4, by_experiment=True).select("experiment_id", "trace_id", "total")


@query("status_snapshot", """WITH a AS (SELECT DISTINCT target, source FROM {v_results} WHERE target <> 'No matches found')
  SELECT count(DISTINCT target) AS identifiers, count(*) AS aliases, (SELECT count(*) FROM {customer}) AS experiments, (SELECT count(*) FROM {v_mapping}) AS mappings FROM a""")
def _status(w):
    return ex.status_snapshot(matchdb.rebuild_aliases(w.v_results), _experiments(w), w.v_mapping)


@query("variant_grid", """WITH a AS (SELECT DISTINCT p_type AS scorer FROM {part}), b AS (SELECT DISTINCT p_size AS threshold FROM {part}), c AS (SELECT DISTINCT p_brand AS persona FROM {part})
  SELECT scorer, CAST(threshold AS VARCHAR) AS threshold, persona, NULL::VARCHAR AS temperature FROM a, b, c""")
def _grid(w):
    axis = lambda name, step, col: w.part.select(F.lit(name).alias("axis"), F.lit(step).alias("step"), F.col(col).cast("string").alias("value")).distinct()
    axes = axis("scorer", "fuzzy_matching", "p_type").unionByName(axis("threshold", "fuzzy_matching", "p_size")).unionByName(
        axis("persona", "entity_profiling", "p_brand")).unionByName(axis("temperature", "llm_ranking", "p_name"))
    return ex.variant_grid(axes, ["scorer", "threshold", "persona", "temperature"], ["fuzzy_matching", "entity_profiling"])


@query("config_dedup", """SELECT DISTINCT p_type, p_size, sha256(concat('{"p_type":"', p_type, '","p_size":', p_size, '}')) AS config_hash FROM {part}""")
def _dedup(w):
    return ex.dedup_configs(w.part, ["p_type", "p_size"])


@query("reuse_intermediates", """SELECT CASE WHEN o.l_orderkey IS NULL THEN 'compute' ELSE 'reuse' END AS action, l.l_returnflag AS step, count(*) AS steps
  FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM {lineitem}) l
  LEFT JOIN (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM {lineitem} WHERE l_quantity > 25) o
    ON o.l_orderkey = l.l_orderkey AND o.l_returnflag = l.l_returnflag AND o.l_linestatus = l.l_linestatus GROUP BY ALL""")
def _reuse(w):
    keys = ["query_id", "step", "config_hash"]
    named = w.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("step"), F.col("l_linestatus").alias("config_hash"), "l_quantity")
    outputs = named.filter(F.col("l_quantity") > 25).groupBy(*keys).agg(F.max("l_quantity").alias("output"))
    reused, todo = ex.reuse_intermediates(named.select(*keys).distinct(), outputs, keys)
    both = reused.select(F.lit("reuse").alias("action"), "step").unionByName(todo.select(F.lit("compute").alias("action"), "step"))
    return both.groupBy("action", "step").agg(F.count(F.lit(1)).alias("steps"))


# ---------------------------------------------------------------- evaluation

_JUDGED = """judged AS (SELECT p.*, t.expected, CASE WHEN t.expected = '--' THEN p.target IS NULL OR p.target = 'No matches found' ELSE p.target = t.expected END AS correct
    FROM {v_predictions} p JOIN {v_truth} t ON t.query_id = p.query_id),
  grid AS (SELECT config, query_id, expected FROM (SELECT DISTINCT config FROM {v_predictions}) CROSS JOIN {v_truth}),
  every AS (SELECT g.config, g.query_id, coalesce(j.correct, g.expected = '--') AS correct
    FROM grid g LEFT JOIN judged j ON j.config = g.config AND j.query_id = g.query_id),
  single AS (SELECT correct FROM judged UNION ALL SELECT expected = '--' FROM {v_truth} WHERE query_id NOT IN (SELECT query_id FROM judged))"""
_HITS = """ans AS (SELECT * FROM {v_truth} WHERE expected <> '--'),
  hits AS (SELECT r.query_id, r.step, min(r.rank) AS rank FROM {v_ranked} r JOIN ans a ON a.query_id = r.query_id AND a.expected = r.term GROUP BY r.query_id, r.step)"""


def _judged(w):
    return ev.judged(w.v_predictions, w.v_truth)


@query("eval_accuracy", f"WITH {_JUDGED} SELECT config, count(*) AS queries, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM every GROUP BY config")
def _accuracy(w):
    return ev.accuracy(w.v_predictions, w.v_truth, ["config"]).withColumn("accuracy", F.round("accuracy", 6))


@query("eval_source_recall", f"""WITH {_HITS} SELECT count(*) AS queries, round(avg(CASE WHEN query_id IN (SELECT query_id FROM hits WHERE step = 'token_matching') THEN 1.0 ELSE 0.0 END), 6) AS source_recall FROM ans""")
def _source_recall(w):
    return ev.source_recall(w.v_ranked.filter(F.col("step") == "token_matching"), w.v_truth).withColumn("source_recall", F.round("source_recall", 6))


@query("eval_candidate_recall", f"""WITH {_HITS}, rk AS (SELECT * FROM ans WHERE query_id IN (SELECT query_id FROM {{v_ranked}} WHERE step = 'llm_ranking'))
  SELECT count(*) AS queries, round(avg(CASE WHEN query_id IN (SELECT query_id FROM hits WHERE step = 'llm_ranking') THEN 1.0 ELSE 0.0 END), 6) AS candidate_recall FROM rk""")
def _candidate_recall(w):
    return ev.candidate_recall(w.v_ranked.filter(F.col("step") == "llm_ranking"), w.v_truth).withColumn("candidate_recall", F.round("candidate_recall", 6))


@query("eval_cache_hit_rate", "SELECT count(*) AS queries, round(avg(CASE WHEN method = 'cached' THEN 1.0 ELSE 0.0 END), 6) AS cache_hit_rate FROM {v_results}")
def _cache_rate(w):
    return ev.cache_hit_rate(w.v_results).withColumn("cache_hit_rate", F.round("cache_hit_rate", 6))


@query("eval_composite", f"""WITH {_JUDGED}, {_HITS} SELECT round(0.6 * (SELECT avg(CAST(correct AS DOUBLE)) FROM single)
    + 0.3 * (SELECT avg(CASE WHEN query_id IN (SELECT query_id FROM hits) THEN 1.0 ELSE 0.0 END) FROM ans)
    + 0.1 * (SELECT avg(CASE WHEN method = 'cached' THEN 1.0 ELSE 0.0 END) FROM {{v_results}}), 6) AS composite""")
def _composite(w):
    metrics = {"accuracy": ev.accuracy(w.v_predictions, w.v_truth), "source_recall": ev.source_recall(w.v_ranked, w.v_truth),
               "cache_hit_rate": ev.cache_hit_rate(w.v_results)}
    out = ev.composite(metrics, {"accuracy": 0.6, "source_recall": 0.3, "cache_hit_rate": 0.1})
    return out.select(F.round("composite", 6).alias("composite"))


@query("eval_mrr", f"WITH {_HITS} SELECT step, round(sum(1 / (rank + 1)) / (SELECT count(*) FROM ans), 6) AS mrr FROM hits GROUP BY step")
def _mrr(w):
    return ev.mrr(w.v_ranked, w.v_truth, ["step"]).withColumn("mrr", F.round("mrr", 6))


@query("eval_hit_at_k", f"WITH {_HITS} SELECT step, round(count(*) FILTER (WHERE rank < 2) / (SELECT count(*) FROM ans), 6) AS hit_at_k FROM hits GROUP BY step")
def _hit(w):
    return ev.hit_at_k(w.v_ranked, w.v_truth, 2).withColumn("hit_at_k", F.round("hit_at_k", 6))


@query("eval_mcnemar", f"""WITH {_JUDGED}, x AS (SELECT a.correct AS a, b.correct AS b FROM judged a JOIN judged b ON a.query_id = b.query_id AND a.config = 'AF' AND b.config = 'NO'),
  n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE NOT a AND b) AS c FROM x)
  SELECT b, c, round((b - c) * (b - c) / (b + c), 6) AS statistic FROM n""")
def _mcnemar(w):
    j = _judged(w)
    return ev.mcnemar(j.filter(F.col("config") == "AF"), j.filter(F.col("config") == "NO")).withColumn("statistic", F.round("statistic", 6))


@query("compare_runs_per_query", f"""WITH {_JUDGED} SELECT query_id, arg_min(config, row(NOT correct, -confidence, config)) AS best_config, bool_or(correct) AS best_correct,
    count(*) FILTER (WHERE correct) AS correct_configs, count(*) AS configs FROM judged GROUP BY query_id""")
def _compare(w):
    return ev.compare_runs_per_query(_judged(w))


@query("strategy_comparison", f"""WITH {_JUDGED} SELECT strategy, count(*) AS queries, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(evidence_chars), 4) AS avg_evidence_chars,
    CAST(sum(scrape_attempts) AS BIGINT) AS scrape_attempts FROM judged GROUP BY strategy""")
def _strategy(w):
    return ev.strategy_comparison(_judged(w)).withColumns({"accuracy": F.round("accuracy", 6), "avg_evidence_chars": F.round("avg_evidence_chars", 4)})
