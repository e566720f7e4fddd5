"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aligner.plans import registry  # noqa: E402
from aligner.session import local_session  # noqa: E402

HEADLINE = [
    "tiered_resolve", "fuzzy_best", "token_topk", "token_candidates", "exact_forward", "word_similarity", "scorer_ratio",
    "mapping_forward", "mapping_combine", "match_db_rebuild", "alias_supersession", "history_by_source", "build_traces",
    "apply_corrections", "convert_spans", "step_diagnostics", "evidence_hybrid", "combined_text", "schema_errors",
    "pipeline_notation", "latest_metric", "eval_mrr", "eval_hit_at_k", "compare_runs_per_query", "stream_match_db",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="aligner-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = registry.all_queries()
    registered["exact_forward"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
