"""Hand-computed cases for preparation, evidence, inference, match database, telemetry and evaluation."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from aligner import session
from aligner.operators import evaluate, evidence, experiments, inference, mapping, matchdb, profiles, telemetry
from aligner.plans.resolve import tiered_resolve
from aligner.operators.ranking import last_known_in_group, position_in_group, previous_in_group


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame([
        (0, 2, " a ", "T1"), (0, 3, "a", "T2"), (0, 4, "", "T3"), (0, 5, "b", None), (0, 6, None, " "), (0, 7, "c", "T1"),
        (1, 2, "a", "T4"), (1, 3, "d", "T1")], "source_id int, row_num long, source string, target string")


def test_first_duplicate_wins_within_a_sheet_and_last_sheet_across(sheet, rows_of):
    forward = mapping.forward_map(sheet)
    assert rows_of(forward) == [(0, "a", "T1", 2), (0, "c", "T1", 7), (1, "a", "T4", 2), (1, "d", "T1", 3)]
    assert {(r["source"], r["target"]) for r in mapping.combine_forward(forward).collect()} == {("a", "T4"), ("c", "T1"), ("d", "T1")}
    reverse = mapping.combine_reverse(mapping.reverse_map(sheet)).select("target", "alias")
    # the last sheet replaces the aliases of T1; T2's alias belongs to an earlier row; T3's row is dropped with its target
    assert rows_of(reverse) == sorted([("T1", "d"), ("T2", None), ("T4", "a")], key=repr)


def test_mapping_issues_and_empty_rows(sheet, rows_of):
    assert rows_of(mapping.mapping_issues(sheet)) == [(0, 3, 'Row 3: Duplicate source "a"')]
    assert rows_of(mapping.empty_rows(sheet)) == [(0, 4, "alias_empty"), (0, 5, "reference_empty"), (0, 6, "both_empty")]
    assert rows_of(mapping.mapping_metadata(sheet)) == [(0, 6, 2, 2, 1), (1, 2, 2, 2, 0)]


def test_zero_and_false_are_empty_unless_told_otherwise(spark):
    df = spark.createDataFrame([(0, False), (5, True)], "source int, target boolean")
    assert [tuple(r) for r in mapping.clean_sheet(df).collect()] == [("", ""), ("5", "true")]
    assert [tuple(r) for r in mapping.clean_sheet(df, falsy_as_empty=False).collect()] == [("0", "false"), ("5", "true")]


def test_existing_pairs_never_overwrite(spark, rows_of):
    rows = spark.createDataFrame([(1, "a", "X"), (2, "n", "Y"), (3, "n", "Z"), (4, " ", "Q")], "row int, inp string, outp string")
    pairs = mapping.existing_pairs(rows, {"inp": "outp"})
    forward = spark.createDataFrame([("a", "T1")], "source string, target string")
    assert rows_of(mapping.ingest_existing_pairs(pairs, forward)) == [("n", "Y")]
    assert pairs.count() == 3


def test_profile_leaves_skip_metadata(spark):
    df = spark.sql("""SELECT named_struct('core', 'steel', 'alt', array('a', 'b'), 'n', 3, '_metadata', named_struct('q', 'hidden'),
        'm', map('x', array('y z'), '_metadata', array('no'))) AS p""")
    leaves = profiles.flatten_profile(df, "p")
    assert df.select(leaves).head()[0] == ["steel", "a", "b", "3", "y z"]
    assert df.select(profiles.expanded_words(F.lit("y  new"), leaves)).head()[0] == ["y", "new", "steel", "a", "b", "3", "z"]


def test_bands_and_percent(spark):
    df = spark.createDataFrame([(0.9,), (0.85,), (60.0,), (0.2,), (0.1,)], "c double")
    assert [r[0] for r in df.select(mapping.confidence_band(F.col("c"))).collect()] == ["excellent", "good", "moderate", "low", "none"]


PAGE = ('<html><head><title> A &amp; B </title><script>x="</p>"</script></head><body><nav>menu</nav><!-- c --><h1>Head</h1><p>First  line</p>'
        "<p>second</p><footer>foot</footer></body></html>")


def test_page_text_and_typed_rejections(spark):
    long_ = "<p>" + "word " * 30 + "</p>"
    pages = spark.createDataFrame([
        (1, 1, "http://a.org/x", "t", "s", PAGE, 200, "text/html"), (1, 2, "http://netflix.com/y", "t", "s", long_, 200, "text/html"),
        (1, 3, "http://a.org/z.docx", "t", "s", long_, 200, "text/html"), (1, 4, "http://a.org/z", "t", "s", long_, 503, "text/html"),
        (1, 5, "http://a.org/z", "t", "s", long_, 200, "image/png"), (1, 6, "http://a.org/path/last", "t", "", long_, 200, "text/html")],
        "query_id int, rank int, url string, title string, snippet string, html string, status int, content_type string")
    # title text stays, blocks join without a separator
    assert pages.select(evidence.page_text(F.col("html"))).head()[0] == "A & B HeadFirst linesecond"
    assert pages.select(evidence.page_text(F.col("html"), max_bytes=30)).head()[0] == "A & B"
    out = {r["rank"]: r for r in evidence.page_filter(pages, char_limit=20).collect()}
    assert [out[i]["rejection"] for i in range(1, 7)] == ["too_short", "skip_domain", "skip_extension", "http_503", "non_html", None]
    assert out[6]["page_title"] == "last" and out[6]["content"] == ("word " * 30)[:20]
    exact = {r["rank"]: r["rejection"] for r in evidence.page_filter(pages, host_exact=True).collect()}
    assert exact[2] is None
    kept = evidence.evidence_pages(evidence.page_filter(pages), max_sites=2)
    assert sorted((r["rank"], r["content"][:1]) for r in kept.collect()) == [(1, "s"), (2, "s")]
    stats = evidence.scrape_stats(evidence.page_filter(pages), kept, 2)
    assert tuple(stats.head()) == (1, 2, 0, 2)  # stopped at the second source


def test_snippets_are_cut_before_the_empty_ones_go(spark, rows_of):
    records = spark.createDataFrame([(1, 1, "t", "u", ""), (1, 2, "t", "u", "abc"), (1, 3, "t", "u", "d")], "query_id int, rank int, title string, url string, snippet string")
    assert rows_of(evidence.evidence_snippets(records, max_sites=2, char_limit=2)) == [(1, 2, "t", "u", "ab")]


def test_combined_text_and_fallback(spark):
    queries = spark.createDataFrame([(1, "cold-rolled steel/ab"), (2, "q")], "query_id int, query string")
    kept = spark.createDataFrame([(2, 1, "T1", "u", "x" * 9), (2, 4, "T2", "u", "yy")], "query_id int, rank int, title string, url string, content string")
    out = {r[0]: r[1] for r in evidence.combined_text(queries, kept, per_site=3, limit=15).collect()}
    assert out[1] == "Research about: cold-rolled steel/ab\n\nQuery contains terms: cold, rolled, steel"
    assert out[2] == "Research about: q\n\n" + "1. T1\nxxx\n\n2. T2\nyy"[:15]


def test_warnings_contract(spark, rows_of):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    kept = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "query_id int, rank int")
    assert rows_of(evidence.evidence_warnings(queries, kept, 2)) == [
        (1, "web_search", "low_document_count", "transient", 1, 2), (3, "web_search", "no_results", "transient", 0, 2)]
    assert rows_of(evidence.evidence_warnings(queries, kept, 2, skipped=True)) == [(1, "web_search", "low_document_count", "transient", 1, 2)]
    upstream = spark.createDataFrame([(1, "rate_limited", "transient"), (3, "client_error", "structural")], "query_id int, code string, kind string")
    assert rows_of(evidence.evidence_warnings(queries, kept, 2, upstream=upstream).select("query_id", "code", "kind")) == [
        (1, "low_document_count", "transient"), (3, "client_error", "structural")]


def test_page_text_keeps_lone_signs_and_decodes_references(spark):
    pages = ["x < 5 and y > 3", "caf&eacute; &#233;&#xE9; 1&ndash;2 &amp;lt; &unknown; & &#0;&#x110000;", "<p>a</p><!-- <b> --><br/>b<i>c</i>", "&copy", ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r[0]: r[1] for r in df.select("i", evidence.page_text(F.col("html"))).collect()}
    assert got == {0: "x < 5 and y > 3", 1: "café éé 1–2 &lt; &unknown; & \ufffd\ufffd", 2: "abc", 3: "&copy", 4: ""}


def test_evidence_limits_are_the_callers(spark):
    html = "<p>" + "word " * 4000 + "</p>"
    df = spark.createDataFrame([("http://a/b", html, 200, "text/html"), ("http://a/c", "<p>tiny</p>", 200, "text/html")], "url string, html string, status int, content_type string")
    got = {r["url"]: r for r in evidence.page_filter(df, char_limit=15_000).collect()}
    assert len(got["http://a/b"]["content"]) == 15_000 and got["http://a/c"]["rejection"] == "too_short"
    short = evidence.page_filter(df, min_text=3).filter("url = 'http://a/c'").head()
    assert short["rejection"] is None and short["content"] == "tiny"

def test_template_values_may_bring_placeholders(spark):
    got = spark.range(1).select(inference.render_prompt(F.lit("{{a}} {{b}}"), {"a": F.lit("{{b}}"), "b": F.lit("x")})).head()[0]
    assert got == "x x"


def test_schema_subset(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["string", "null"]}, "b": {"type": "array", "maxItems": 1, "items": {"enum": [1, 2]}},
                                                                       "c": {"type": "number"}}}
    def check(value):
        df = spark.createDataFrame([(json.dumps(value),)], "response string")
        return [(e["path"], e["message"]) for e in df.select(inference.schema_errors("response", schema)).head()[0]]

    assert check({"a": None, "b": [1, 2, 1]}) == []  # maxItems is not checked
    assert check({"a": 1, "b": [3], "c": True}) == [
        ("a", "expected type string | null, got int"), ("b/0", "value 3 is not one of [1, 2]"), ("c", "expected type number, got bool")]
    assert check([]) == [("(root)", "expected type object, got list")]
    assert check({}) == [("a", "required property is missing"), ("b", "required property is missing")]


def test_repair_asks_only_the_invalid_again(spark):
    asked = spark.sparkContext.accumulator(0)

    def infer(prompts, **options):
        asked.add(len(prompts))
        return [json.dumps({"x": 1}) if inference.REPAIR_HEAD in p or p == "good" else "bad" if p != "never" else "{}" for p in prompts]

    def stubborn(prompts, **options):
        return ["{}" for _ in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "broken")], "id int, prompt string")
    schema = {"type": "object", "required": ["x"]}
    out = {r["id"]: (r["attempts"], r["status"]) for r in inference.infer_with_repair(df, infer, schema).collect()}
    assert out == {1: (1, "ok"), 2: (2, "ok")} and asked.value == 3
    failed = inference.infer_with_repair(df, stubborn, schema).collect()
    assert {(r["attempts"], r["status"]) for r in failed} == {(3, "schema_validation_failed")}


def test_parse_and_unwrap(spark):
    schema = StructType([StructField("k", LongType())])
    df = spark.createDataFrame([('{"k": 1}',), ('[3, {"k": 2}]',), ("[]",), ("{",)], "response string")
    status = [r["parse_status"] for r in inference.parse_response(df, schema).collect()]
    assert status == ["ok", "ok", "ok", "json_parse_failed"]
    assert [r[0] for r in df.select(inference.unwrap_single(F.col("response"), schema)["k"]).collect()] == [1, 2, None, None]


@pytest.fixture(scope="module")
def results(spark):
    return spark.sql("""SELECT trace_id, CAST(ts AS TIMESTAMP_NTZ) AS ts, source, target, method, confidence, session_id, total_time FROM VALUES
        (1, '2024-01-01 10:00:00', 'Src', 'A', 'cached', 0.1D, 7, 0.5D), (2, '2024-01-01 10:00:00', 'Src', 'A', 'ProfileRank', 0.7D, 7, 0.0D),
        (3, '2024-01-02 09:00:00', 'Src', 'B', 'ProfileRank', 0.8D, 8, 1.0D), (4, '2024-01-01 00:00:00', ' src ', 'A', 'UserChoice', CAST(NULL AS DOUBLE), 8, 2.0D),
        (5, '2024-01-03 00:00:00', 'x', 'No matches found', 'ProfileRank', 0.9D, 8, 2.0D)
        AS t(trace_id, ts, source, target, method, confidence, session_id, total_time)""")


def test_match_database_rules(results, rows_of):
    aliases = matchdb.rebuild_aliases(results)
    got = rows_of(aliases.select("target", "source", "trace_id", "verified"))
    # equal timestamps keep the lowest trace id; no-match records leave nothing
    assert got == sorted([("A", "Src", 1, True), ("B", "Src", 3, True), ("A", " src ", 4, True)], key=repr)
    superseded = {(r["target"], r["source"]): r["current_target"] for r in matchdb.supersede(aliases).collect()}
    assert superseded == {("A", "Src"): "B", ("B", "Src"): None, ("A", " src "): None}
    half = matchdb.upsert_aliases(matchdb.rebuild_aliases(results.filter("trace_id <= 2")), results.filter("trace_id > 2"))
    assert rows_of(half) == rows_of(aliases)
    history = {(r["key"], r["trace_id"]): (r["position"], r["entries"]) for r in matchdb.history_by_source(results).collect()}
    assert history[("src", 3)] == (0, 4) and history[("src", 1)] == (1, 4) and history[("src", 2)] == (2, 4) and history[("src", 4)] == (3, 4)
    assert [r["key"] for r in matchdb.history_recent(results, 1).collect()] == ["x"]


def test_snapshot_never_taken_is_stale(spark):
    runs = spark.sql("SELECT 1 AS experiment_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS start_time")
    assert tuple(matchdb.snapshot_freshness(runs, None, "2024-01-02 00:00:00").head())[2:] == (True, None, True)
    assert tuple(matchdb.snapshot_freshness(runs, "2024-01-02 00:00:00", "2024-01-02 00:10:00").head())[2:] == (False, 600, False)


def test_telemetry_parts(spark, results, rows_of):
    records = results.withColumns({"entity_profile": F.when(F.col("trace_id") == 3, F.lit('{"core": "x"}')),
                                   "web_sources": F.when(F.col("trace_id") == 3, F.array(F.struct(F.lit("t").alias("title"), F.lit("u").alias("url"))))})
    traces = telemetry.build_traces(records)
    first = traces.filter("output.target = 'B'").head()
    assert first["id"].startswith("240102090000") and len(first["id"]) == 32 and first["metadata"] == {"method": "ProfileRank"}
    assert sorted(r["name"] for r in telemetry.build_observations(records).collect()) == ["entity_profiling", "web_search"]
    assert telemetry.build_scores(records).filter("name = 'latency_ms'").count() == 4  # no latency where no time was measured
    short = telemetry.log_short_circuit(records)
    assert [(r["output"]["confidence"], r["tags"]) for r in short.traces.collect()] == [(1.0, ["cached"])]
    corrections = spark.sql("SELECT 1L AS correction_id, TIMESTAMP_NTZ'2024-02-01 00:00:00' AS ts, 'Src' AS source, 'C' AS target "
                            "UNION ALL SELECT 2L, TIMESTAMP_NTZ'2024-02-02 00:00:00', 'Src', 'D' UNION ALL SELECT 3L, TIMESTAMP_NTZ'2024-02-02 00:00:00', 'new', 'E'")
    fixed = telemetry.apply_corrections(telemetry.build_dataset_items(records), traces, corrections)
    items = {r["input"]["query"]: r["expected_output"] and r["expected_output"]["target"] for r in fixed.items.collect()}
    assert items == {"Src": "D", "new": "E", " src ": None, "x": None}
    assert rows_of(fixed.observations.select("previous_target", "selected_target")) == [("B", "C"), ("C", "D")]
    changed = fixed.traces.filter("output.method = 'UserChoice' and output.confidence = 1.0").collect()
    assert [r["output"]["target"] for r in changed] == ["D"]


def test_step_rules(spark):
    steps = spark.sql("SELECT * FROM VALUES (1, 'a', 1, 'failed', 1.0D), (1, 'a', 2, 'success', 2.0D), (1, 'b', 3, 'skipped', NULL) AS t(trace_id, step, seq, status, elapsed)")
    warnings = spark.sql("SELECT 1 AS trace_id, 'c' AS step, 'x' AS code UNION ALL SELECT 1, 'a', 'x'")
    diagnostics = telemetry.step_diagnostics(steps, warnings)
    assert {(r["step"], r["status"], r["warnings"]) for r in diagnostics.collect()} == {("a", "success", 1), ("b", "skipped", 0), ("c", "degraded", 1)}
    assert telemetry.run_outcome(diagnostics).head()["outcome"] == "warn"
    timing = telemetry.step_timings(steps).head()
    assert (timing["timings"], timing["executed_steps"], timing["terminated_at"]) == ({"a": 2.0, "b": None}, 1, "a")


def test_groups_of_any_size_equal_plain_windows(spark, rows_of):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 = 0 THEN NULL ELSE concat('k', id % 7) END AS k",
                                     "id * 37 % 101 AS t", "CASE WHEN id % 4 = 0 THEN concat('v', id) END AS v")
    got = position_in_group(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], total="n")
    want = df.selectExpr("*", "count(*) over (partition by k) AS n", "row_number() over (partition by k order by t, id) - 1 AS position")
    assert rows_of(got.select("id", "position", "n")) == rows_of(want.select("id", "position", "n"))
    got = previous_in_group(df, ["k"], F.floor(F.col("t") / 10), ["t", "id"], "id", "before")
    want = df.selectExpr("*", "lag(id) over (partition by k order by t, id) AS before")
    assert rows_of(got.select("id", "before")) == rows_of(want.select("id", "before"))
    got = last_known_in_group(df, ["k"], F.floor(F.col("t") / 10), ["t", "id"], "v", "known")
    want = df.selectExpr("*", "last_value(v) ignore nulls over (partition by k order by t, id rows between unbounded preceding and 1 preceding) AS known")
    assert rows_of(got.select("id", "known")) == rows_of(want.select("id", "known"))


def test_no_match_truth_is_a_true_negative(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "--"), (3, "--"), (4, "B")], "query_id int, expected string")
    predictions = spark.createDataFrame([(1, "A"), (2, "No matches found"), (3, "X"), (4, None)], "query_id int, target string")
    assert tuple(evaluate.accuracy(predictions, truth).head()) == (4, 0.5)
    ranked = spark.createDataFrame([(1, "s", 1, "A"), (3, "s", 0, "--"), (4, "s", 0, "A")], "query_id int, step string, rank int, term string")
    assert evaluate.mrr(ranked, truth).head()[0] == 0.25
    assert tuple(evaluate.source_recall(ranked, truth).head()) == (2, 0.5)
    assert [tuple(r) for r in evaluate.hit_at_k(ranked, truth, 1).collect()] == [("s", 0.0)]


def test_notation_and_grid(spark):
    steps = spark.sql("SELECT 1 AS run, * FROM VALUES (0, 'ExternalService', 'web_search'), (1, 'LLMGeneration', 'entity'), (2, 'DeterministicFunction', 'token_matching'), "
                      "(3, 'LLMGeneration', 'rank') AS t(pos, type, name)")
    assert experiments.pipeline_notation(steps, ["run"], ["pos"]).head()["notation"] == "web_search-LLM1-TokenMatching-LLM2"
    axes = spark.createDataFrame([("t", "fuzzy", "70"), ("t", "fuzzy", "80"), ("s", "fuzzy", "ratio"), ("x", "rank", "1")], "axis string, step string, value string")
    grid = experiments.variant_grid(axes, ["t", "s", "x"], ["fuzzy"])
    assert sorted(tuple(r) for r in grid.collect()) == [("70", "ratio", None), ("80", "ratio", None)]


def test_paging(spark):
    runs = spark.sql("SELECT id % 2 AS experiment_id, id AS run_id, id AS start_time FROM range(10)")
    got = sorted(tuple(r) for r in experiments.list_runs(runs, limit=2, offset=1).select("experiment_id", "run_id", "total").collect())
    assert got == [(0, 4, 5), (0, 6, 5), (1, 5, 5), (1, 7, 5)]


def test_null_queries_are_empty_values(spark):
    queries = spark.createDataFrame([(1, None), (2, " "), (3, "steel")], "query_id int, query string")
    forward = spark.createDataFrame([("steel", "Steel", 1)], "source string, target string, key_ord int")
    targets = spark.createDataFrame([("Steel", "Steel")], "target string, key_ord string")
    out = {r["query_id"]: (r["target"], r["method"]) for r in tiered_resolve(queries, forward, targets, targets.select(F.col("target").alias("term"))).collect()}
    assert out == {1: ("Empty value", "no_match"), 2: ("Empty value", "no_match"), 3: ("Steel", "cached")}


def test_the_newest_of_repeated_scores_is_converted(spark):
    traces = spark.createDataFrame([("t1", None, 1.0, 2.0, "SUCCESS")], "id string, name string, start_time double, end_time double, status string")
    observations = spark.createDataFrame([], "trace_id string, type string, name string, start_time double, end_time double, line int")
    scores = spark.createDataFrame([("t1", "confidence", 0.2, "2024-01-01", "a"), ("t1", "confidence", 0.9, "2024-01-02", "b")],
                                   "trace_id string, name string, value double, timestamp string, id string")
    spans = telemetry.convert_spans(traces, observations, scores, F.col("line"), ["line"])
    assert spans.head()["attributes"] == {"score.confidence": "0.9"}


def test_unanswered_queries_count_against_accuracy(spark, rows_of):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "--"), (4, "--")], "query_id int, expected string")
    given = spark.createDataFrame([("x", 1, "a"), ("x", 3, "c"), ("y", 2, "b")], "config string, query_id int, target string")
    assert rows_of(evaluate.accuracy(given, truth, ["config"])) == [("x", 4, 0.5), ("y", 4, 0.75)]
    assert evaluate.accuracy(given.filter("config = 'x'"), truth).collect() == [(4, 0.5)]


def test_pages_are_refused_not_cut(spark):
    df = spark.range(1000).selectExpr("id AS trace_id", "id AS request_time")
    assert experiments.list_traces(df, limit=500).count() == 500
    with pytest.raises(ValueError):
        experiments.list_traces(df, limit=501)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_staged_tables_are_released(spark):
    df = session.stage(spark.range(5), "released")
    folder = os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    session.release(df)
    assert not os.path.exists(folder)
