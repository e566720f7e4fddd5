"""Queries: mapping preparation, projection and filters."""

from pyspark.sql import functions as F

from aligner.operators import mapping
from aligner.operators.profiles import flatten_profile
from aligner.plans.registry import query

_CLEAN = """clean AS (SELECT source_id, row_num, trim(source) AS source, trim(target) AS target FROM {v_mapping}),
  usable AS (SELECT * FROM clean WHERE source <> '' AND target <> ''),
  fwd AS (SELECT source_id, source, arg_min(target, row_num) AS target, min(row_num) AS row_num
          FROM usable GROUP BY source_id, source),
  tgt AS (SELECT DISTINCT source_id, target FROM usable)"""


@query("mapping_forward", f"WITH {_CLEAN} SELECT source_id, source, target, row_num FROM fwd")
def _forward(w):
    return mapping.forward_map(w.v_mapping)


@query("mapping_reverse", f"""WITH {_CLEAN}
  SELECT t.source_id, t.target, f.source AS alias, f.row_num
  FROM tgt t LEFT JOIN fwd f ON f.source_id = t.source_id AND f.target = t.target""")
def _reverse(w):
    return mapping.reverse_map(w.v_mapping)


@query("mapping_issues", f"""WITH {_CLEAN}
  SELECT u.source_id, u.row_num, concat('Row ', u.row_num, ': Duplicate source "', u.source, '"') AS issue
  FROM usable u JOIN fwd f ON f.source_id = u.source_id AND f.source = u.source WHERE u.row_num > f.row_num""")
def _issues(w):
    return mapping.mapping_issues(w.v_mapping)


@query("mapping_empty_rows", f"""WITH {_CLEAN}
  SELECT source_id, row_num, CASE WHEN source = '' AND target = '' THEN 'both_empty'
    WHEN target = '' THEN 'reference_empty' ELSE 'alias_empty' END AS kind
  FROM clean WHERE source = '' OR target = ''""")
def _empty(w):
    return mapping.empty_rows(w.v_mapping)


@query("mapping_metadata", f"""WITH {_CLEAN}
  SELECT c.source_id, count(*) AS total_rows, max(u.valid) AS valid_mappings, max(u.tgts) AS targets,
    max(u.n - u.valid) AS issues
  FROM clean c JOIN (SELECT source_id, count(DISTINCT source) AS valid, count(DISTINCT target) AS tgts, count(*) AS n
    FROM usable GROUP BY source_id) u ON u.source_id = c.source_id GROUP BY c.source_id""")
def _metadata(w):
    return mapping.mapping_metadata(w.v_mapping)


@query("mapping_combine", f"""WITH {_CLEAN}
  SELECT 'forward' AS direction, source AS key, arg_max(target, source_id) AS value FROM fwd GROUP BY source
  UNION ALL
  SELECT 'reverse', t.target, f.source
  FROM tgt t JOIN (SELECT target, max(source_id) AS source_id FROM tgt GROUP BY target) l
    ON l.target = t.target AND l.source_id = t.source_id
  LEFT JOIN fwd f ON f.source_id = t.source_id AND f.target = t.target""")
def _combine(w):
    forward = mapping.combine_forward(mapping.forward_map(w.v_mapping))
    reverse = mapping.combine_reverse(mapping.reverse_map(w.v_mapping))
    return forward.select(F.lit("forward").alias("direction"), F.col("source").alias("key"), F.col("target").alias("value")).unionByName(
        reverse.select(F.lit("reverse").alias("direction"), F.col("target").alias("key"), F.col("alias").alias("value")))


@query("term_list", f"WITH {_CLEAN} SELECT DISTINCT target AS term FROM tgt")
def _terms(w):
    return mapping.term_list(mapping.reverse_map(w.v_mapping))


@query("terms_per_source", f"WITH {_CLEAN} SELECT source_id, count(DISTINCT target) AS terms FROM tgt GROUP BY source_id")
def _terms_per_source(w):
    return mapping.terms_per_source(mapping.reverse_map(w.v_mapping))


@query("ingest_existing_pairs", f"""WITH {_CLEAN},
  fw AS (SELECT DISTINCT source FROM fwd),
  pairs AS (SELECT 0 AS pair, p_partkey + 1 AS row, concat('alias ', CAST(p_partkey % 1700 AS STRING)) AS source, trim(p_name) AS target FROM {{part}}
    UNION ALL SELECT 1, p_partkey + 1, trim(p_type), trim(p_brand) FROM {{part}}),
  filled AS (SELECT * FROM pairs WHERE source <> '' AND target <> ''),
  fresh AS (SELECT source, arg_min(target, pair * 1000000000 + row) AS target FROM filled
    WHERE source NOT IN (SELECT source FROM fw) GROUP BY source)
  SELECT 'new_key' AS kind, source, target, count(*) AS cells FROM fresh GROUP BY source, target
  UNION ALL SELECT 'PreExisting', source, target, count(*) FROM filled GROUP BY source, target""")
def _ingest(w):
    sheet = w.part.select(
        (F.col("p_partkey") + 1).alias("row"), F.concat(F.lit("alias "), (F.col("p_partkey") % 1700).cast("string")).alias("alias"),
        "p_name", "p_type", "p_brand")
    pairs = mapping.existing_pairs(sheet, {"alias": "p_name", "p_type": "p_brand"})
    fresh = mapping.ingest_existing_pairs(pairs, mapping.combine_forward(mapping.forward_map(w.v_mapping)))
    shown = fresh.withColumn("kind", F.lit("new_key")).unionByName(
        pairs.select("source", "target", F.col("method").alias("kind")))
    return shown.groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("cells"))


@query("flatten_profile", """
  SELECT conv_id, turn, unnest([role, text, CAST(conv_id AS STRING)]) AS leaf FROM {conversations}""")
def _flatten(w):
    docs = w.conversations.select(
        "conv_id", "turn",
        F.struct("role", F.array("text").alias("notes"),
                 F.struct(F.col("conv_id").alias("n")).alias("nested"),
                 F.struct(F.lit("hidden").alias("query")).alias("_metadata")).alias("profile"))
    return docs.select("conv_id", "turn", F.explode(flatten_profile(docs, "profile")).alias("leaf"))


@query("confidence_band", """
  SELECT trace_id, CASE WHEN confidence >= 0.9 THEN 'excellent' WHEN confidence >= 0.8 THEN 'good'
    WHEN confidence >= 0.6 THEN 'moderate' WHEN confidence >= 0.2 THEN 'low' ELSE 'none' END AS band,
    CAST(floor(confidence * 100 + 0.5) AS INT) AS percent FROM {v_results}""")
def _band(w):
    return w.v_results.select("trace_id", mapping.confidence_band(F.col("confidence")).alias("band"),
                              mapping.confidence_percent(F.col("confidence")).alias("percent"))
