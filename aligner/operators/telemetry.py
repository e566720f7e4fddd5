"""Telemetry: traces, observations, scores, ground-truth items and events built from result records; corrections; diagnostics.

A record is a row with ``trace_id`` (the caller's key), ``ts``, ``session_id``, ``source``, ``target``, ``method``,
``confidence``, ``total_time`` and, where known, ``provider``, ``batch_id``, ``user_prompt``, ``web_sources``, ``entity_profile``
(JSON text), ``token_matches``, ``candidates``, ``confidence_corrected``, ``original_confidence``, ``reasoning``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.functions.ids import dated_id, prefixed_id
from aligner.operators.ranking import position_in_group, previous_in_group

TRACE_NAME = "alignment_pipeline"
DATASET_NAME = "ground_truth"
CORRECTION_CONFIDENCE = 1.0
_OPTIONAL = {
    "provider": "string", "batch_id": "string", "user_prompt": "string", "reasoning": "string", "entity_profile": "string",
    "confidence_corrected": "boolean", "original_confidence": "double", "matched_key": "string", "direction": "string",
    "web_sources": "array<struct<title:string,url:string>>", "token_matches": "array<struct<term:string,score:double>>",
    "candidates": "array<struct<name:string,score:double>>",
}


def complete(records: DataFrame) -> DataFrame:
    """Records with every optional column present."""
    return records.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in records.columns})


def _given(col: str) -> Column:
    return F.col(col).isNotNull() & (F.col(col) != "")


def _some(col: str) -> Column:
    return F.coalesce(F.size(col), F.lit(0)) > 0


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def trace_key() -> Column:
    return dated_id(F.col("ts"), F.col("trace_id"))


def item_key(query: Column) -> Column:
    """Item id of a query string; a function of the string alone, so no lookup is needed to refer to it."""
    return prefixed_id("item", query, 24)


def _output() -> Column:
    return F.struct("target", "method", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def build_traces(records: DataFrame, name: str = TRACE_NAME, tag: Column | None = None) -> DataFrame:
    """One trace per record; metadata holds what is set."""
    r = complete(records)
    corrected = F.coalesce("confidence_corrected", F.lit(False))
    pairs = [("method", F.col("method")), ("provider", F.col("provider")), ("batch_id", F.nullif("batch_id", F.lit(""))),
             ("user_prompt", F.nullif("user_prompt", F.lit(""))), ("direction", F.col("direction")),
             ("confidence_corrected", F.when(corrected, "true")),
             ("original_confidence", F.when(corrected, F.col("original_confidence").cast("string")))]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return r.select(
        trace_key().alias("id"), F.lit(name).alias("name"), F.col("ts").alias("timestamp"), F.struct(F.col("source").alias("query")).alias("input"),
        _output().alias("output"), F.coalesce(F.nullif(F.col("session_id").cast("string"), F.lit("")), F.lit("anonymous")).alias("user_id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metadata"),
        F.array(F.lit("production") if tag is None else tag).alias("tags"))


def build_observations(records: DataFrame) -> DataFrame:
    """Up to five observations per record, one for every part it has."""
    r = complete(records)
    model = F.coalesce("provider", F.lit("unknown"))
    none = F.lit(None).cast("string")
    query = _json(query=F.col("source"))

    def part(when: Column, kind: str, name: str, by: Column, given: Column, result: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), by.alias("model"), given.alias("input"), result.alias("output")))

    parts = F.array(
        part(_some("web_sources"), "span", "web_search", none, query,
             _json(sources=F.col("web_sources"), count=F.size("web_sources"))),
        part(_given("entity_profile"), "generation", "entity_profiling", model, query, F.col("entity_profile")),
        part(_some("token_matches"), "span", "token_matching", none, _json(profile=F.col("entity_profile")),
             _json(candidates=F.col("token_matches"), count=F.size("token_matches"))),
        part(_some("candidates"), "generation", "llm_ranking", model,
             _json(candidate_count=F.coalesce(F.size("token_matches"), F.lit(0))), _json(ranked=F.col("candidates"), top=F.col("target"))),
        part(F.col("method") == "DirectPrompt", "generation", "direct_mapping", model,
             _json(query=F.col("source"), user_prompt=F.col("user_prompt")),
             _json(target=F.col("target"), confidence=F.coalesce("confidence", F.lit(0.0)), reasoning=F.col("reasoning"))),
    )
    return _observations(r.select(trace_key().alias("trace_id"), "ts", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("o")))


def _observations(exploded: DataFrame) -> DataFrame:
    return exploded.select(
        prefixed_id("obs", F.concat_ws("|", "trace_id", "o.name"), 12).alias("id"), "trace_id", "o.type", "o.name",
        F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), "o.model", "o.input", "o.output")


def build_scores(records: DataFrame) -> DataFrame:
    """Confidence for every record, latency in ms where a time was measured."""
    parts = F.array(
        F.struct(F.lit("confidence").alias("name"), F.coalesce("confidence", F.lit(0.0)).alias("value")),
        F.when(F.coalesce("total_time", F.lit(0.0)) != 0,
               F.struct(F.lit("latency_ms").alias("name"), (F.col("total_time") * 1000).alias("value"))))
    return records.select(trace_key().alias("trace_id"), "ts", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("s")).select(
        prefixed_id("score", F.concat_ws("|", "trace_id", "s.name"), 8).alias("id"), "trace_id", "s.name", "s.value",
        F.lit("NUMERIC").alias("data_type"), F.col("ts").alias("timestamp"))


def build_dataset_items(records: DataFrame, dataset: str = DATASET_NAME) -> DataFrame:
    """One ground-truth item per distinct query, linked to its latest trace; no expected output yet."""
    latest = F.max_by(F.struct("ts", "trace_id"), F.struct("ts", "trace_id"))
    return (
        records.filter(_given("source")).groupBy("source").agg(F.min("ts").alias("created_at"), latest.alias("l"))
        .select(item_key(F.col("source")).alias("id"), F.lit(dataset).alias("dataset_name"), F.struct(F.col("source").alias("query")).alias("input"),
                F.lit(None).cast("struct<target:string>").alias("expected_output"),
                dated_id(F.col("l.ts"), F.col("l.trace_id")).alias("source_trace_id"), "created_at", F.lit("ACTIVE").alias("status"))
    )


def build_events(records: DataFrame) -> DataFrame:
    """Flat event row per record; optional fields only where set."""
    r = complete(records)
    corrected = F.coalesce("confidence_corrected", F.lit(False))
    return r.select(
        F.lit("pipeline").alias("event"), F.col("ts").alias("timestamp"), trace_key().alias("trace_id"), item_key(F.col("source")).alias("item_id"),
        F.col("source").alias("query"), "target", "method", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        (F.coalesce("total_time", F.lit(0.0)) * 1000).alias("latency_ms"), F.col("session_id").cast("string").alias("session_id"), "batch_id",
        F.nullif("user_prompt", F.lit("")).alias("user_prompt"), F.nullif("reasoning", F.lit("")).alias("reasoning"),
        F.when(corrected, F.col("original_confidence")).alias("original_confidence"))


@dataclass(frozen=True)
class Telemetry:
    traces: DataFrame
    observations: DataFrame
    scores: DataFrame
    events: DataFrame
    items: DataFrame | None = None


def log_short_circuit(records: DataFrame) -> Telemetry:
    """Telemetry of cached and fuzzy results; records of other methods are rejected. Cached confidence is 1.0."""
    cached = F.col("method") == "cached"
    r = complete(records.filter(F.col("method").isin("cached", "fuzzy"))).withColumn(
        "confidence", F.when(cached, F.lit(1.0)).otherwise(F.col("confidence")))
    step = F.when(cached, "cache_lookup").otherwise("fuzzy_matching")
    result = F.when(cached, _json(target=F.col("target"))).otherwise(_json(
        target=F.col("target"), similarity_score=F.col("confidence"), matched_key=F.col("matched_key"), direction=F.col("direction")))
    observed = r.select(trace_key().alias("trace_id"), "ts", F.struct(
        F.lit("span").alias("type"), step.alias("name"), F.lit(None).cast("string").alias("model"),
        _json(query=F.col("source")).alias("input"), result.alias("output")).alias("o"))
    return Telemetry(build_traces(r, tag=F.col("method")), _observations(observed), build_scores(r), build_events(r), build_dataset_items(r))


def report_steps(reports: DataFrame) -> Telemetry:
    """Reported steps ``(report_id, trace_id, ts, step, source, target, method, confidence, latency_ms)``.

    Every report becomes an observation; one with a target and a method other than ``miss`` also finalises its trace,
    adds scores and an event. The newest finalising report of a trace gives its output.
    """
    final = reports.filter(_given("target") & _given("method") & (F.col("method") != "miss"))
    observations = reports.select(
        prefixed_id("obs", F.col("report_id"), 12).alias("id"), "trace_id", F.lit("span").alias("type"), F.col("step").alias("name"),
        F.col("ts").alias("start_time"), _json(query=F.coalesce("source", F.lit(""))).alias("input"),
        _json(target=F.col("target"), method=F.col("method"), confidence=F.col("confidence")).alias("output"))
    traces = final.groupBy("trace_id").agg(F.max_by(_output(), F.struct("ts", "report_id")).alias("output"))
    parts = F.array(
        F.struct(F.lit("confidence").alias("name"), F.coalesce("confidence", F.lit(0.0)).alias("value")),
        F.when(F.coalesce("latency_ms", F.lit(0.0)) != 0, F.struct(F.lit("latency_ms").alias("name"), F.col("latency_ms").alias("value"))))
    scores = final.select("report_id", "trace_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("s")).select(
        "report_id", "trace_id", "s.name", "s.value")
    events = final.select(
        F.lit("pipeline").alias("event"), "report_id", "trace_id", F.when(_given("source"), item_key(F.col("source"))).alias("item_id"),
        F.col("source").alias("query"), "target", "method", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "latency_ms")
    return Telemetry(traces, observations, scores, events)


# ---------------------------------------------------------------- corrections

@dataclass(frozen=True)
class Corrected:
    items: DataFrame
    traces: DataFrame
    observations: DataFrame


def apply_corrections(items: DataFrame, traces: DataFrame, corrections: DataFrame, method: str = "UserChoice", bucket: str = "hour") -> Corrected:
    """Ground truth from corrections ``(correction_id, ts, source, target)``.

    The latest correction of a query sets the expected output of its item and the output of the item's trace; a query
    without an item gets a new one. Every correction is an observation on the trace with the target it replaced.
    """
    latest = corrections.groupBy("source").agg(
        F.max_by("target", F.struct("ts", "correction_id")).alias("expected"), F.min("ts").alias("first_ts"))
    known = items.withColumn("source", F.col("input.query"))
    merged = known.join(latest, "source", "full_outer")
    new_items = merged.select(
        F.coalesce("id", item_key(F.col("source"))).alias("id"), F.coalesce("dataset_name", F.lit(DATASET_NAME)).alias("dataset_name"),
        F.struct(F.col("source").alias("query")).alias("input"),
        F.when(F.col("expected").isNotNull(), F.struct(F.col("expected").alias("target"))).otherwise(F.col("expected_output")).alias("expected_output"),
        "source_trace_id", F.coalesce("created_at", "first_ts").alias("created_at"), F.coalesce("status", F.lit("ACTIVE")).alias("status"))

    per_trace = merged.filter(F.col("expected").isNotNull() & F.col("source_trace_id").isNotNull()).select(
        F.col("source_trace_id").alias("id"), "expected")
    corrected_output = F.struct(F.col("expected").alias("target"), F.lit(method).alias("method"), F.lit(CORRECTION_CONFIDENCE).alias("confidence"))
    new_traces = traces.join(per_trace, "id", "left").withColumn(
        "output", F.when(F.col("expected").isNotNull(), corrected_output).otherwise(F.col("output"))).drop("expected")

    ordered = previous_in_group(corrections, ["source"], F.date_trunc(bucket, F.col("ts").cast("timestamp")),
                                ["ts", "correction_id"], "target", "earlier")
    originals = known.select("source", "source_trace_id").join(
        traces.select(F.col("id").alias("source_trace_id"), F.col("output.target").alias("original")), "source_trace_id")
    observations = ordered.join(originals, "source").select(
        prefixed_id("obs", F.col("correction_id"), 12).alias("id"), F.col("source_trace_id").alias("trace_id"), F.lit("event").alias("type"),
        F.lit("user_correction").alias("name"), F.col("ts").alias("start_time"),
        F.coalesce("earlier", "original").alias("previous_target"), F.col("target").alias("selected_target"), F.lit(method).alias("method"))
    return Corrected(new_items, new_traces, observations)


# ---------------------------------------------------------------- views

def item_full_view(items: DataFrame, traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Items with the output and metadata of their trace, one row per part of that trace.

    ``part`` is observation, score or none (an item whose trace has neither, or without a trace); corrections pile up as
    observations on a trace, so parts stay rows and are never gathered into one value.
    """
    none = lambda name: F.lit(None).cast("string").alias(name)
    parts = observations.select(
        F.col("trace_id").alias("part_trace"), F.lit("observation").alias("part"), "id", F.col("name").alias("part_name"), F.col("type").alias("part_type"),
        F.col("model").alias("part_model"), F.col("input").alias("part_input"), F.col("output").alias("part_output"),
        F.lit(None).cast("double").alias("value")).unionByName(
        scores.select(F.col("trace_id").alias("part_trace"), F.lit("score").alias("part"), "id", F.col("name").alias("part_name"), none("part_type"),
                      none("part_model"), none("part_input"), none("part_output"), "value"))
    t = traces.select(F.col("id").alias("source_trace_id"), F.col("output").alias("trace_output"), F.col("metadata").alias("trace_metadata"))
    return (
        items.withColumnRenamed("id", "item_id").join(t, "source_trace_id", "left")
        .join(parts.withColumnRenamed("id", "part_id"), F.col("source_trace_id") == F.col("part_trace"), "left").drop("part_trace")
        .withColumn("part", F.coalesce("part", F.lit("none")))
    )


def batch_summary(events: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Start and completion of every batch paired: counts, duration, success rate; ``linked`` results by batch id.

    ``events`` is the flat log with ``event`` in (batch_start, batch_complete); a batch not yet complete keeps nulls.
    """
    start = events.filter(F.col("event") == "batch_start").select("batch_id", "user_prompt", "item_count", F.col("timestamp").alias("started_at"))
    done = events.filter(F.col("event") == "batch_complete").select("batch_id", "success_count", "error_count", "total_time_ms")
    out = start.join(done, "batch_id", "left").withColumn(
        "success_rate", F.col("success_count") / F.nullif(F.col("success_count") + F.col("error_count"), F.lit(0)))
    if results is not None:
        linked = results.groupBy("batch_id").agg(F.count(F.lit(1)).alias("linked"))
        out = out.join(linked, "batch_id", "left").withColumn("linked", F.coalesce("linked", F.lit(0).cast("long")))
    return out


# ---------------------------------------------------------------- diagnostics

def step_status(steps: DataFrame) -> DataFrame:
    """Last status and elapsed time per (trace, step), with the place of its first record."""
    return steps.groupBy("trace_id", "step").agg(
        F.max_by(F.struct("status", "elapsed"), "seq").alias("l"), F.min("seq").alias("first_seq")
    ).select("trace_id", "step", "l.status", "l.elapsed", "first_seq")


def step_diagnostics(steps: DataFrame, warnings: DataFrame) -> DataFrame:
    """Status per step with all its warnings counted by code; a warning on a step never recorded makes it ``degraded``.

    Codes form a closed set, so the map stays small however many warnings a step has.
    """
    counts = warnings.groupBy("trace_id", "step", "code").agg(F.count(F.lit(1)).alias("n"))
    per_step = counts.groupBy("trace_id", "step").agg(
        F.sum("n").alias("warnings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))
    return step_status(steps).join(per_step, ["trace_id", "step"], "full_outer").select(
        "trace_id", "step", F.coalesce("status", F.lit("degraded")).alias("status"), F.coalesce("warnings", F.lit(0).cast("long")).alias("warnings"), "codes")


def step_timings(steps: DataFrame) -> DataFrame:
    """Per trace: elapsed per step, executed steps and the step it ended at (last one not skipped).

    A trace has one entry per step name, a closed set.
    """
    executed = F.col("status") != "skipped"
    return step_status(steps).groupBy("trace_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "elapsed")))).alias("timings"),
        F.count(F.when(executed, 1)).alias("executed_steps"),
        F.max_by(F.when(executed, F.col("step")), F.when(executed, F.col("first_seq"))).alias("terminated_at"))


def run_outcome(diagnostics: DataFrame) -> DataFrame:
    """ok / warn / fail per trace from its step diagnostics."""
    return diagnostics.groupBy("trace_id").agg(
        F.bool_or(F.col("status") == "failed").alias("failed"),
        F.bool_or((F.col("warnings") > 0) | ~F.col("status").isin("success", "skipped")).alias("warned"),
    ).select("trace_id", F.when(F.col("failed"), "fail").when(F.col("warned"), "warn").otherwise("ok").alias("outcome"))


def http_warning(status: Column, model_call: bool = False) -> Column:
    """(code, kind) of an upstream HTTP status; for model calls the remaining client errors are schema faults."""
    code = (
        F.when(status == 429, "rate_limited").when(status >= 500, "server_error").when(status.isin(401, 403, 404), "client_error")
        .otherwise("schema_invalid" if model_call else "upstream_error")
    )
    kind = F.when((status == 429) | (status >= 500), "transient").otherwise("structural")
    return F.struct(code.alias("code"), kind.alias("kind"))


def web_status(source_status: Column, error: Column) -> Column:
    """skipped / precomputed as given, failed with an error, else success."""
    return F.when(source_status.isin("skipped", "precomputed"), source_status).when(error.isNotNull(), "failed").otherwise("success")


# ---------------------------------------------------------------- conversion to span tables

# Status and span-type maps of the target format.
SPAN_STATUS = {"SUCCESS": "OK", "ERROR": "ERROR", "TIMEOUT": "ERROR", "RUNNING": "UNSET"}
INFO_STATUS = {"SUCCESS": "OK", "ERROR": "ERROR", "TIMEOUT": "ERROR", "RUNNING": "IN_PROGRESS"}
SPAN_TYPES = {"span": "CHAIN", "generation": "LLM", "event": "UNKNOWN"}


def _mapped(col: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def _text(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")


def convert_spans(traces: DataFrame, observations: DataFrame, scores: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Root and child spans: ``(span_id, trace_id, parent_id, name, start_ns, end_ns, status, span_type, inputs, outputs, attributes)``.

    Inputs, outputs and a child's ``model`` attribute are taken where traces and observations have such columns.

    ``traces`` is ``(id, name, start_time, end_time, status)`` in epoch seconds. Child numbers follow ``order`` within the
    trace; ``bucket`` is a column monotone in it. The newest score of a name counts (by ``timestamp`` and ``id`` where they are given); names
    are a closed set, so a trace's attributes stay small.
    """
    root_id = F.rpad(F.substring("id", 1, 16), 16, "0")
    ns = lambda c: (F.col(c) * 1_000_000_000).cast("long")
    newest = F.struct(*[F.col(c) for c in ("timestamp", "id") if c in scores.columns], "value")
    named = scores.groupBy("trace_id", "name").agg(F.max_by("value", newest).alias("value"))
    attrs = named.groupBy(F.col("trace_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.concat(F.lit("score."), F.col("name")).alias("k"), F.col("value").cast("string").alias("v"))))).alias("attributes"))
    roots = traces.join(attrs, "id", "left").select(
        root_id.alias("span_id"), F.col("id").alias("trace_id"), F.lit(None).cast("string").alias("parent_id"),
        F.coalesce("name", F.lit(TRACE_NAME)).alias("name"), ns("start_time").alias("start_ns"),
        F.coalesce(ns("end_time"), ns("start_time")).alias("end_ns"), _mapped(F.col("status"), SPAN_STATUS, "UNSET").alias("status"),
        F.lit("CHAIN").alias("span_type"), _text(traces, "input").alias("inputs"), _text(traces, "output").alias("outputs"), "attributes")
    numbered = position_in_group(observations, ["trace_id"], bucket, [F.col(c) for c in order], name="i")
    parents = traces.select(F.col("id").alias("trace_id"), root_id.alias("parent_id"), ns("start_time").alias("t_start"),
                            F.coalesce(ns("end_time"), ns("start_time")).alias("t_end"))
    children = numbered.join(parents, "trace_id").select(
        F.concat(F.substring("trace_id", 1, 8), F.lpad(F.lower(F.hex("i")), 8, "0")).alias("span_id"), "trace_id", "parent_id",
        F.coalesce("name", F.concat(F.lit("step_"), F.col("i").cast("string"))).alias("name"),
        F.coalesce(ns("start_time"), F.col("t_start")).alias("start_ns"), F.coalesce(ns("end_time"), F.col("t_end")).alias("end_ns"),
        F.lit("OK").alias("status"), _mapped(F.col("type"), SPAN_TYPES, "UNKNOWN").alias("span_type"),
        _text(observations, "input").alias("inputs"), _text(observations, "output").alias("outputs"),
        F.when(_text(observations, "model").isNotNull(), F.create_map(F.lit("model"), _text(observations, "model"))).alias("attributes"))
    return roots.unionByName(children)


def convert_trace_info(traces: DataFrame) -> DataFrame:
    """Info row of every trace: state, ISO request time, duration, previews, metadata and tags.

    ``traces`` is ``(id, name, start_time, latency_ms, status, input, output, metadata)``, previews being JSON text.
    """
    clock = F.timestamp_seconds("start_time")
    iso = F.concat(F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    tags = F.create_map(F.lit("traceName"), F.coalesce("name", F.lit(TRACE_NAME)), F.lit("traceInputs"), F.col("input"),
                        F.lit("traceOutputs"), F.col("output"))
    return traces.select(
        F.col("id").alias("trace_id"), iso.alias("request_time"),
        F.when(F.coalesce("latency_ms", F.lit(0.0)) != 0, F.col("latency_ms").cast("long")).alias("execution_duration_ms"),
        _mapped(F.col("status"), INFO_STATUS, "OK").alias("state"), F.col("input").alias("request_preview"), F.col("output").alias("response_preview"),
        F.map_filter("metadata", lambda k, v: v.isNotNull()).alias("request_metadata"), tags.alias("tags"))


def migrate_pending(traces: DataFrame, converted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces not converted yet, and one row with migrated and skipped counts."""
    pending = traces.join(converted.select(F.col("trace_id").alias("id")), "id", "left_anti")
    total = traces.agg(F.count(F.lit(1))).scalar()
    counts = pending.agg(F.count(F.lit(1)).alias("migrated")).withColumn("skipped", total - F.col("migrated"))
    return pending, counts
