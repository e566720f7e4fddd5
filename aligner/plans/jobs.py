"""End-to-end jobs: research resolution and direct-prompt batches, with the model as the caller's function.

Every step is a transform of the operators; answers of the model are staged by them, so no prompt is sent twice. The jobs return
DataFrames: what to write where is the caller's choice (``sources.sinks``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.functions.text import trimmed
from aligner.operators import allterms, evidence, inference, matchdb, profiles, scoring, telemetry, tokens
from aligner.session import stage

PROFILE_TYPE = "struct<core_concept:string,synonyms:array<string>>"
PROFILE_SCHEMA = {
    "type": "object", "required": ["core_concept"],
    "properties": {"core_concept": {"type": "string"}, "synonyms": {"type": "array", "items": {"type": "string"}}},
}
RANKING_TYPE = "struct<ranking:array<struct<candidate:string,core:double,spec:double>>>"
RANKING_SCHEMA = {
    "type": "object", "required": ["ranking"],
    "properties": {"ranking": {"type": "array", "items": {
        "type": "object", "required": ["candidate"],
        "properties": {"candidate": {"type": "string"}, "core": {"type": "number"}, "spec": {"type": "number"}}}}},
}
PROFILE_PROMPT = "Describe the entity as JSON with core_concept and synonyms.\nQuery: {{query}}\n\n{{context}}"
RANKING_PROMPT = "Rank the candidates for the query as JSON with ranking.\nQuery: {{query}}\nProfile: {{profile}}\nCandidates:\n{{candidates}}"


@dataclass(frozen=True)
class Run:
    """``results`` per query, the records behind them, their telemetry and the alias rows they add."""

    results: DataFrame
    records: DataFrame
    telemetry: telemetry.Telemetry
    aliases: DataFrame


def _run(results: DataFrame, records: DataFrame) -> Run:
    logged = telemetry.Telemetry(telemetry.build_traces(records), telemetry.build_observations(records), telemetry.build_scores(records),
                                 telemetry.build_events(records), telemetry.build_dataset_items(records))
    return Run(results, records, logged, matchdb.rebuild_aliases(records))


def research_resolve(queries: DataFrame, pages: DataFrame, terms: DataFrame, infer: inference.Infer, ts: Column, max_sites: int = evidence.MAX_SITES,
                     k: int = 20, provider: str = "model", session_id: str | None = None, profile_prompt: str = PROFILE_PROMPT,
                     ranking_prompt: str = RANKING_PROMPT) -> Run:
    """Evidence, profile, token retrieval, ranking and pick for ``(query_id, query)`` rows, as telemetry and aliases as well.

    ``pages`` are search records with their pages, ``terms`` the catalogue. A query whose ranking fails falls back to its token scores;
    one without candidates has no match. The lists put into a prompt or a record are bounded by ``max_sites`` and ``k``.
    """
    asked = stage(queries.select("query_id", trimmed(F.coalesce("query", F.lit(""))).alias("query")), "research-queries")
    kept = stage(evidence.evidence_pages(evidence.page_filter(pages), max_sites), "research-evidence")
    context = evidence.combined_text(asked, kept)
    prompts = asked.filter(F.col("query") != "").join(context, "query_id").withColumn("prompt", inference.render_prompt(
        F.lit(profile_prompt), {"query": F.col("query"), "context": F.col("combined_text")})).drop("combined_text")
    profiled = inference.infer_with_repair(prompts, infer, PROFILE_SCHEMA, task="profile").select(
        "query_id", "query", F.when(F.col("status") == "ok", F.from_json("response", PROFILE_TYPE)).alias("profile"))
    profiled = stage(profiled, "research-profiles")

    words = profiles.expanded_words(F.col("query"), profiles.flatten_profile(profiled, "profile"))
    expanded = profiled.select("query_id", F.array_join(words, " ").alias("query"))
    topk = stage(tokens.token_topk(expanded, terms, k), "research-topk")
    listed = topk.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("listed"))

    given = profiled.join(listed, "query_id").withColumn("prompt", inference.render_prompt(F.lit(ranking_prompt), {
        "query": F.col("query"), "profile": F.to_json("profile"), "candidates": F.array_join("listed.term", "\n")}))
    answered = stage(inference.infer_with_repair(given.select("query_id", "prompt"), infer, RANKING_SCHEMA, task="ranking").select(
        "query_id", F.when(F.col("status") == "ok", F.from_json("response", RANKING_TYPE)["ranking"]).alias("ranking")), "research-ranking")
    returned = answered.select("query_id", F.posexplode("ranking").alias("rank", "r")).select("query_id", "rank", "r.candidate", "r.core", "r.spec")
    offered = topk.select("query_id", F.col("term").alias("candidate"), F.col("rank").alias("list_ord"))
    ranked = scoring.correct_candidates(returned, offered).select(
        "query_id", "rank", "candidate", tokens.relevance_score(F.col("core"), F.col("spec")).alias("relevance_score"))
    fallback = tokens.token_fallback_ranking(topk.join(ranked.select("query_id"), "query_id", "left_anti")).select(*ranked.columns)
    ranking = stage(ranked.unionByName(fallback), "research-ranked")
    results = tokens.rank_and_pick(asked, ranking).withColumnRenamed("query", "source").withColumn("method", F.lit("ProfileRank"))

    sources = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url"))).alias("s"))
    best = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "relevance_score"))).alias("c"))
    records = (
        results.join(profiled.select("query_id", F.to_json("profile").alias("entity_profile")), "query_id", "left")
        .join(sources, "query_id", "left").join(listed, "query_id", "left").join(best, "query_id", "left")
        .select(F.col("query_id").alias("trace_id"), ts.alias("ts"), F.lit(session_id).cast("string").alias("session_id"), "source", "target",
                "method", "confidence", F.lit(None).cast("double").alias("total_time"), F.lit(provider).alias("provider"), "entity_profile",
                F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("web_sources"),
                F.transform("listed", lambda x: F.struct(x["term"].alias("term"), x["score"].alias("score"))).alias("token_matches"),
                F.transform("c", lambda x: F.struct(x["candidate"].alias("name"), x["relevance_score"].alias("score"))).alias("candidates"))
    )
    return _run(results, records)


DIRECT_ANSWER = "struct<output:string,confidence:double,reasoning:string>"


@dataclass(frozen=True)
class Batch(Run):
    summary: DataFrame


def direct_prompt_batch(rows: DataFrame, terms: DataFrame, infer: inference.Infer, batch_id: str, ts: Column, user_prompt: str,
                        project_context: str = "", accept: float = scoring.ACCEPT_THRESHOLD, top_n: int = scoring.CORRECTION_TOP_N, k: int | None = None,
                        provider: str = "model") -> Batch:
    """Answers of a user's prompt to ``(query_id, query, current_output)`` rows, snapped to the catalogue where near enough.

    An answer is compared with all terms, or with the ``k`` that share most of its tokens. A row without a valid answer has no match and counts as an
    error of the batch.
    """
    message = inference.direct_prompt_messages(F.col("query"), F.lit(user_prompt), F.lit(project_context), F.col("current_output"))
    prompts = rows.select("query_id", trimmed(F.coalesce("query", F.lit(""))).alias("query"), "current_output").withColumn(
        "m", message).select("query_id", "query", F.concat_ws("\n\n", "m.system", "m.user").alias("prompt"))
    raw = stage(inference.batch_infer(prompts, infer, task="direct"), "direct-answers")
    answer = F.from_json("response", DIRECT_ANSWER)
    answered = raw.select("query_id", F.col("query").alias("source"), F.when(F.try_parse_json("response").isNotNull(), answer).alias("a")).select(
        "query_id", "source", trimmed(F.col("a.output")).alias("query"), "a.confidence", "a.reasoning")
    valid = stage(answered.filter(F.col("query").isNotNull()), "direct-valid")
    if k is None:
        pairs = allterms.best_of_all(valid.select("query_id", "query"), terms, max(1, top_n))
    else:
        topk = tokens.token_topk(valid.select("query_id", "query"), terms, k)
        pairs = valid.join(topk, "query_id").select("query_id", "query", F.col("term").alias("candidate"), F.col("rank").alias("list_ord"))
    checked = scoring.validate_free_text(valid.select("query_id", "query", "confidence"), pairs, accept, top_n)
    results = answered.select("query_id", "source", "reasoning", F.col("query").isNull().alias("failed")).join(checked, "query_id", "left").select(
        "query_id", "source", F.coalesce("target", F.lit(tokens.NO_MATCH)).alias("target"), F.lit("DirectPrompt").alias("method"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "fuzzy_score", F.coalesce("fuzzy_corrected", F.lit(False)).alias("fuzzy_corrected"),
        F.coalesce("needs_user_selection", F.lit(True)).alias("needs_user_selection"), "candidates", "reasoning", "failed")
    results = stage(results, "direct-results")
    records = results.select(
        F.col("query_id").alias("trace_id"), ts.alias("ts"), F.lit(None).cast("string").alias("session_id"), "source", "target", "method", "confidence",
        F.lit(None).cast("double").alias("total_time"), F.lit(provider).alias("provider"), F.lit(batch_id).alias("batch_id"),
        F.lit(user_prompt).alias("user_prompt"), "reasoning")
    counts = results.agg(F.count(F.lit(1)).alias("item_count"), F.count(F.when(~F.col("failed"), 1)).alias("success_count"),
                         F.count(F.when(F.col("failed"), 1)).alias("error_count")).withColumns(
        {"batch_id": F.lit(batch_id), "user_prompt": F.lit(user_prompt), "timestamp": ts, "total_time_ms": F.lit(None).cast("double")})
    events = counts.withColumn("event", F.lit("batch_start")).unionByName(counts.withColumn("event", F.lit("batch_complete")))
    run = _run(results, records)
    return Batch(run.results, run.records, run.telemetry, run.aliases, telemetry.batch_summary(events, records))
