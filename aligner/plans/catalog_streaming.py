"""Queries: streaming jobs over the event files, run until everything available is processed."""

from pyspark.sql import functions as F

from aligner.operators import mapping
from aligner.plans.catalog_matching import TIERED
from aligner.plans.catalog_telemetry import batch_events
from aligner.plans.registry import query
from aligner.plans.workload import VIEWS, referenced
from aligner.session import new_path
from aligner.streaming import core, jobs


def _stream(w, table):
    """A table of the workload as a stream of its files."""
    return core.read_stream(w.spark, w.sf_dir, w.table(table).schema, glob=f"{table}.parquet")


def _view_stream(w, view, table):
    """A view of one table (possibly over another view) as a stream."""
    inner = {table: _stream(w, table)}
    for name in referenced(VIEWS[view]):
        if name not in inner:
            inner[name] = _view_stream(w, name, table)
    return w.spark.sql(VIEWS[view], **inner)


def _parts_stream(w, df, name, n):
    """``df`` as a stream of ``n`` files arriving one per batch."""
    path = new_path(w.spark, name)
    df.repartition(n).write.parquet(path)
    return core.read_stream(w.spark, path, df.schema, files_per_batch=1)


@query("stream_events", "SELECT event_id, ts, user_id, event_type, value, props FROM {events}")
def _events(w):
    return jobs.collect_stream(_stream(w, "events"))


@query("stream_changed_cells", """SELECT seq, workbook, row, col, value FROM (SELECT *, lag(value) OVER (PARTITION BY workbook, row, col ORDER BY ts, seq) AS before
    FROM {v_cells} WHERE row > 0) WHERE before IS NULL OR before <> value""")
def _changed(w):
    changed = jobs.stream_changed_cells(_view_stream(w, "v_cells", "events"), ["ts", "seq"], F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return changed.select("seq", "workbook", "row", "col", "value")


@query("stream_direct_edits", """WITH e AS (SELECT seq, ts, workbook, row, 0 AS input_col, CASE WHEN col = 0 THEN value END AS entered, CASE WHEN col = 2 THEN value END AS edited FROM {v_cells} WHERE row > 0 AND col IN (0, 2)),
  f AS (SELECT *, last_value(entered IGNORE NULLS) OVER (PARTITION BY workbook, row ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM e)
  SELECT seq, workbook, row, source, edited AS target, 'DirectEdit' AS method FROM (SELECT seq, workbook, row, edited,
    coalesce(source, CASE WHEN row % 2 = 0 THEN concat('stored ', workbook) END) AS source FROM f) WHERE edited IS NOT NULL AND source IS NOT NULL""")
def _edits(w):
    cells = _view_stream(w, "v_cells", "events")
    columns = w.spark.createDataFrame([(0, 2)], "input_col int, output_col int")
    stored = w.v_cells.filter("row % 2 = 0").select("workbook", "row").distinct().select(
        "workbook", "row", F.lit(0).alias("input_col"), F.concat(F.lit("stored "), F.col("workbook").cast("string")).alias("source"))
    edits = jobs.stream_direct_edits(cells, columns, stored, ["ts", "seq"], F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return edits.select("seq", "workbook", "row", "source", "target", "method")


@query("stream_resolve", f"WITH {TIERED} SELECT query_id, source, target, method, confidence FROM resolved")
def _resolve(w):
    forward = mapping.combine_forward(mapping.forward_map(w.v_aliases))
    targets = w.v_terms.select(F.col("term").alias("target"), F.col("term").alias("key_ord"))
    arriving = _view_stream(w, "v_queries", "part").select("query_id", "query")
    out = jobs.stream_resolve(arriving, forward, targets, w.v_terms)
    return out.select("query_id", "source", "target", "method", F.round("confidence", 6).alias("confidence"))


@query("stream_match_db", """SELECT target, source, trace_id, method FROM {v_results} WHERE target <> 'No matches found'
  QUALIFY row_number() OVER (PARTITION BY target, source ORDER BY ts DESC, trace_id) = 1""")
def _match_db(w):
    return jobs.stream_match_db(_parts_stream(w, w.v_results, "results", 3)).select("target", "source", "trace_id", "method")


@query("stream_history_late", """SELECT lower(trim(source)) AS key, arg_min(trace_id, row(-epoch_us(ts), trace_id)) AS trace_id,
    arg_min(target, row(-epoch_us(ts), trace_id)) AS target, count(*) AS entries FROM {v_results} GROUP BY lower(trim(source))""")
def _history(w):
    return jobs.stream_history(_parts_stream(w, w.v_results, "results", 3)).select("key", "trace_id", "target", "entries")


@query("stream_bounded_history", "SELECT trace_id, source, target FROM {v_results} ORDER BY ts DESC, trace_id LIMIT 999")
def _bounded(w):
    return jobs.stream_bounded_history(_parts_stream(w, w.v_results, "results", 3)).select("trace_id", "source", "target")


@query("stream_batches", """SELECT batch_id, count(*) AS item_count, CASE WHEN count(*) <= 6 THEN count(*) FILTER (WHERE role = 'user') END AS success_count,
    CASE WHEN count(*) <= 6 THEN count(*) FILTER (WHERE role <> 'user') END AS error_count
  FROM {v_batches} GROUP BY batch_id""")
def _batches(w):
    events = batch_events(w)
    starts = _parts_stream(w, events.filter(F.col("event") == "batch_start"), "starts", 2)
    completes = _parts_stream(w, events.filter(F.col("event") == "batch_complete"), "completes", 2)
    paired = jobs.stream_batches(starts, completes)
    return paired.select("batch_id", "item_count", "success_count", "error_count")
