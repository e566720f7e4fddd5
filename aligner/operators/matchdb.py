"""Match database: which sources have been resolved to which target, folded from result records.

Kept in normal form: alias rows ``(target, source, ts, trace_id, method, confidence, verified)`` and target rows
``(target, entry_ts, last_updated, web_sources)``. A target may own any number of aliases, so they are never gathered into
one map. Records are ``(trace_id, ts, source, target, method, confidence[, web_sources])``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.functions.text import trimmed
from aligner.operators.ranking import position_in_group
from aligner.operators.tokens import NO_MATCH

# Methods whose aliases count as verified, and the confidence that does.
VERIFIED_METHODS = ["UserChoice", "DirectEdit", "cached", "fuzzy"]
HIGH_CONFIDENCE = 0.8
HISTORY_LIMIT = 999
STALE_SECONDS = 3600


def alias_verified(method: Column, confidence: Column) -> Column:
    return F.coalesce(method.isin(VERIFIED_METHODS), F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) >= HIGH_CONFIDENCE)


def usable_records(records: DataFrame) -> DataFrame:
    """Records with a source and a real target."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return records.filter(given("source") & given("target") & (F.col("target") != NO_MATCH))


def _newest(*fields: str) -> Column:
    """Newest timestamp first, then the lowest trace id."""
    return F.min_by(F.struct(*fields), F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.col("trace_id")))


def rebuild_aliases(records: DataFrame) -> DataFrame:
    """Latest alias per (target, source); aggregated map-side, so hot pairs shrink before the shuffle."""
    return merge_aliases(usable_records(records).select(
        "target", "source", "ts", "trace_id", "method", "confidence",
        alias_verified(F.col("method"), F.col("confidence")).alias("verified")))


def merge_aliases(alias_rows: DataFrame) -> DataFrame:
    """Alias rows of several folds as one: the newest per (target, source)."""
    return (
        alias_rows.groupBy("target", "source")
        .agg(_newest("ts", "trace_id", "method", "confidence", "verified").alias("a")).select("target", "source", "a.*")
    )


def rebuild_targets(records: DataFrame) -> DataFrame:
    """Target rows: when first seen, and the web sources of the latest record that has any."""
    rows = usable_records(records)
    if "web_sources" not in rows.columns:
        rows = rows.withColumn("web_sources", F.array().cast("array<struct<title:string,url:string>>"))
    has_sources = F.size(F.coalesce("web_sources", F.array())) > 0
    return rows.groupBy("target").agg(
        F.min("ts").alias("entry_ts"), F.min_by("trace_id", F.struct("ts", "trace_id")).alias("entry_trace"),
        F.coalesce(F.max(F.when(has_sources, F.col("ts"))), F.min("ts")).alias("last_updated"),
        F.max_by(F.when(has_sources, F.col("web_sources")), F.when(has_sources, F.struct("ts", "trace_id"))).alias("web_sources"))


def attach_profile(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Targets with the latest entity profile; ``profiles`` is ``(target, ts, trace_id, profile)``."""
    latest = profiles.groupBy("target").agg(F.max_by("profile", F.struct("ts", "trace_id")).alias("entity_profile"))
    return targets.join(latest, "target", "left")


def upsert_aliases(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Alias rows after a batch of new records: the newest of old and new per (target, source)."""
    return merge_aliases(existing.select("target", "source", "ts", "trace_id", "method", "confidence", "verified").unionByName(rebuild_aliases(batch)))


def supersede(aliases: DataFrame) -> DataFrame:
    """Alias rows with ``current_target`` where the source has since been resolved to another target."""
    latest = aliases.groupBy("source").agg(F.max_by("target", F.struct("ts", "target")).alias("latest_target"))
    return aliases.join(latest, "source").withColumn(
        "current_target", F.when(F.col("latest_target") != F.col("target"), F.col("latest_target"))).drop("latest_target")


def match_db_counts(aliases: DataFrame, records: DataFrame) -> DataFrame:
    """One row: identifiers, aliases and records with a query and a target."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    n_records = records.filter(given("source") & given("target")).agg(F.count(F.lit(1))).scalar()
    return aliases.agg(F.count_distinct("target").alias("identifiers"), F.count(F.lit(1)).alias("aliases")).withColumn("records", n_records)


def target_by_source(aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """For every source the first target, in order of entry, that has it as an alias."""
    entries = targets.select("target", "entry_ts", "entry_trace")
    return aliases.select("target", "source").join(entries, "target").groupBy("source").agg(
        F.min_by("target", F.struct("entry_ts", "entry_trace", "target")).alias("target"))


def aliases_of(identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias rows of a table of identifiers; unknown identifiers stay with nulls."""
    return identifiers.select("target").distinct().join(aliases, "target", "left")


# ---------------------------------------------------------------- history

def history_key(source: Column | str) -> Column:
    return F.lower(trimmed(source))


def history_by_source(records: DataFrame, bucket: str = "hour") -> DataFrame:
    """Entries per source key, newest first: position 0 is the current one; ``entries`` is their number."""
    keyed = records.withColumn("key", history_key("source"))
    return position_in_group(keyed, ["key"], F.date_trunc(bucket, F.col("ts").cast("timestamp")),
                             [F.desc("ts"), F.asc("trace_id")], bucket_desc=True, total="entries")


def history_latest(records: DataFrame) -> DataFrame:
    """Current entry and number of entries per source key, without ranking the others."""
    keyed = records.withColumn("key", history_key("source"))
    return keyed.groupBy("key").agg(
        _newest("ts", "trace_id", "target", "method", "confidence").alias("e"), F.count(F.lit(1)).alias("entries")
    ).select("key", "e.*", "entries")


def merge_history(latest: DataFrame) -> DataFrame:
    """Latest entries of several batches as one: the newest entry, the counts added up."""
    return latest.groupBy("key").agg(
        _newest("ts", "trace_id", "target", "method", "confidence").alias("e"), F.sum("entries").alias("entries")
    ).select("key", "e.*", "entries")


def history_recent(records: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The ``limit`` most recently updated sources, one current entry each."""
    return history_latest(records).orderBy(F.desc("ts"), "trace_id").limit(limit)


def event_list_recent(records: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The ``limit`` newest entries of the flat list."""
    return records.orderBy(F.desc("ts"), "trace_id").limit(limit)


def snapshot_freshness(runs: DataFrame, snapshot_ts: str | None, as_of: str) -> DataFrame:
    """Per experiment its newest run, whether that is newer than the snapshot, the snapshot's age and staleness."""
    snapshot = F.lit(snapshot_ts).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", snapshot, F.lit(as_of).cast("timestamp_ntz"))
    return runs.groupBy("experiment_id").agg(F.max("start_time").alias("newest_run")).select(
        "experiment_id", "newest_run", F.coalesce(F.col("newest_run") > snapshot, F.lit(True)).alias("needs_rebuild"),
        age.alias("age_seconds"), F.coalesce(age > STALE_SECONDS, F.lit(True)).alias("is_stale"))


def session_usage(records: DataFrame) -> DataFrame:
    """Per session and target the number of results, with the session's number of queries."""
    counts = records.groupBy("session_id", "target").agg(F.count(F.lit(1)).alias("times"))
    queries = counts.groupBy("session_id").agg(F.sum("times").alias("queries"))
    return counts.filter(F.col("target").isNotNull()).join(queries, "session_id")
