"""Registry of checked queries: a Spark function over the workload and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aligner.plans.workload import Workload, oracle_text

QueryFn = Callable[[Workload], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Workload(spark, sf_dir))) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {name: oracle_text(sql) for name, sql in _ORACLES.items()}


def _load() -> None:
    from aligner.plans import (  # noqa: F401  (importing registers)
        catalog_evidence,
        catalog_experiments,
        catalog_inference,
        catalog_jobs,
        catalog_mapping,
        catalog_matchdb,
        catalog_matching,
        catalog_sources,
        catalog_streaming,
        catalog_telemetry,
    )
