"""Fixed schemas of the persisted records; jobs never infer them."""

from __future__ import annotations

TRACE = """id STRING, name STRING, timestamp STRING, input STRUCT<query: STRING>,
  output STRUCT<target: STRING, method: STRING, confidence: DOUBLE>, user_id STRING, session_id STRING,
  metadata MAP<STRING, STRING>, tags ARRAY<STRING>"""
OBSERVATION = """id STRING, trace_id STRING, type STRING, name STRING, start_time STRING, end_time STRING,
  input STRING, output STRING, model STRING, metadata MAP<STRING, STRING>"""
SCORE = "id STRING, trace_id STRING, name STRING, value DOUBLE, data_type STRING, timestamp STRING"
DATASET_ITEM = """id STRING, dataset_name STRING, input STRUCT<query: STRING>, expected_output STRUCT<target: STRING>,
  source_trace_id STRING, metadata MAP<STRING, STRING>, status STRING"""
EVENT = """event STRING, timestamp STRING, trace_id STRING, item_id STRING, query STRING, target STRING, method STRING,
  confidence DOUBLE, latency_ms DOUBLE, session_id STRING, batch_id STRING, user_prompt STRING, item_count LONG,
  success_count LONG, error_count LONG, total_time_ms DOUBLE"""
EVALUATION = "query STRING, expected STRING, predicted STRING, correct BOOLEAN, score DOUBLE"
ALIAS = """target STRING, source STRING, ts TIMESTAMP_NTZ, trace_id LONG, method STRING, confidence DOUBLE, verified BOOLEAN"""
