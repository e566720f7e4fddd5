"""Streaming counterparts of the batch operators.

State that must outlive a batch is a table per batch in the shared folder rather than Python objects: a cell, source or
target that receives a third of all events is then handled by the same skew-proof transforms as in batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aligner.functions.text import trimmed
from aligner.operators import matchdb
from aligner.operators.ranking import last_known_in_group, previous_in_group
from aligner.plans.maps import maps_of
from aligner.plans.resolve import resolve_with
from aligner.session import new_path, stage
from aligner.streaming.core import LastValues, Levels, SNAPSHOT_EVERY, batch_path, read_batches, run_available, write_batch

CELL = ["workbook", "row", "col"]


def collect_stream(stream: DataFrame, root: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append every batch of a stream to a table and return that table."""
    spark = stream.sparkSession
    root = root or new_path(spark, "stream")
    run_available(stream, lambda batch, i: write_batch(batch, root, i), checkpoint)
    return read_batches(spark, root, stream.schema).drop("batch")


# ---------------------------------------------------------------- cells

def changed_cells(cells: DataFrame, known: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Cell events whose trimmed value differs from the last one seen for the cell.

    ``known`` is the last value per cell from before; the header row and empty values are ignored.
    """
    usable = cells.withColumn("value", trimmed(F.col("value").cast("string"))).filter((F.col("row") > 0) & (F.col("value") != ""))
    with_previous = previous_in_group(usable, CELL, bucket, order, "value", "_previous")
    joined = with_previous.join(known.select(*CELL, F.col("value").alias("_known")), CELL, "left")
    before = F.coalesce("_previous", "_known")
    return joined.filter(before.isNull() | (before != F.col("value"))).drop("_previous", "_known")


def last_values(cells: DataFrame, order: list[str]) -> DataFrame:
    """Last non-empty trimmed value per cell."""
    usable = cells.withColumn("value", trimmed(F.col("value").cast("string"))).filter((F.col("row") > 0) & (F.col("value") != ""))
    return usable.groupBy(*CELL).agg(F.max_by("value", F.struct(*order)).alias("value"))


def stream_changed_cells(stream: DataFrame, order: list[str], bucket: Column, root: str | None = None,
                         checkpoint: str | None = None, snapshot_every: int = SNAPSHOT_EVERY) -> DataFrame:
    """Follow cell events and keep the ones that change their cell.

    Every batch writes its changes and the last value of the cells it touched; the next batch finds the last value seen
    before it in the newest snapshot and the batches since.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, "cells")
    schema = stream.select(*CELL, F.col("value").cast("string").alias("value")).schema
    state = LastValues(spark, f"{root}/state", CELL, "value", schema, snapshot_every)

    def per_batch(batch: DataFrame, i: int) -> None:
        write_batch(changed_cells(batch, state.before(i), order, bucket), f"{root}/changes", i)
        state.write(last_values(batch, order), i)

    run_available(stream, per_batch, checkpoint)
    out_schema = stream.withColumn("value", F.col("value").cast("string")).schema
    return read_batches(spark, f"{root}/changes", out_schema).drop("batch")


def direct_edits(cells: DataFrame, column_map: DataFrame, stored: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Edits of output columns as ``DirectEdit`` results of the row's source.

    ``column_map`` is ``(input_col, output_col)``, ``stored`` the source per (workbook, row, input column) from before.
    The source is the latest value entered in the input column before the edit; edits without one are dropped.
    """
    usable = cells.withColumn("value", trimmed(F.col("value").cast("string"))).filter((F.col("row") > 0) & (F.col("value") != ""))
    inputs = usable.join(column_map.select(F.col("input_col").alias("col")).distinct(), "col", "left_semi").select(
        "workbook", "row", F.col("col").alias("input_col"), *order, F.col("value").alias("entered"), F.lit(None).cast("string").alias("edited"))
    edits = usable.join(column_map.withColumnRenamed("output_col", "col"), "col").select(
        "workbook", "row", "input_col", *order, F.lit(None).cast("string").alias("entered"), F.col("value").alias("edited"))
    keys = ["workbook", "row", "input_col"]
    timeline = last_known_in_group(inputs.unionByName(edits), keys, bucket, order, "entered", "_source")
    return (
        timeline.filter(F.col("edited").isNotNull()).join(stored.select(*keys, F.col("source").alias("_stored")), keys, "left")
        .withColumn("source", F.coalesce("_source", "_stored")).filter(F.col("source").isNotNull())
        .select(*keys, *order, "source", F.col("edited").alias("target"), F.lit("DirectEdit").alias("method"), F.lit(1.0).alias("confidence"))
    )


def stream_direct_edits(stream: DataFrame, column_map: DataFrame, stored: DataFrame, order: list[str], bucket: Column,
                        root: str | None = None, checkpoint: str | None = None, snapshot_every: int = SNAPSHOT_EVERY) -> DataFrame:
    """Follow cell events and turn output edits into results; sources entered in earlier batches are remembered."""
    spark = stream.sparkSession
    root = root or new_path(spark, "edits")
    keys = ["workbook", "row", "input_col"]
    state = LastValues(spark, f"{root}/state", keys, "source", stored.select(*keys, "source").schema, snapshot_every)
    inputs = column_map.select(F.col("input_col").alias("col")).distinct()

    def per_batch(batch: DataFrame, i: int) -> None:
        seen = state.before(i)
        known = seen.unionByName(stored.select(*keys, "source").join(seen, keys, "left_anti"))
        write_batch(direct_edits(batch, column_map, known, order, bucket), f"{root}/edits", i)
        entered = last_values(batch.join(inputs, "col", "left_semi"), order)
        state.write(entered.select("workbook", "row", F.col("col").alias("input_col"), F.col("value").alias("source")), i)

    run_available(stream, per_batch, checkpoint)
    schema = direct_edits(spark.createDataFrame([], stream.schema), column_map, stored, order, bucket).schema
    return read_batches(spark, f"{root}/edits", schema).drop("batch")


# ---------------------------------------------------------------- resolution

def stream_resolve(stream: DataFrame, forward: DataFrame, targets: DataFrame, terms: DataFrame, use_fuzzy: bool = True,
                   root: str | None = None, checkpoint: str | None = None, maps_root: str | None = None) -> DataFrame:
    """Resolve arriving ``(query_id, query)`` rows against the current maps, batch by batch.

    The maps are prepared once per version below ``maps_root`` (a folder shared by all jobs that use them); batches and later runs read
    them as they are. A version lasts for a run: changed maps take effect with the next one.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, "resolved")
    known = maps_of(forward, targets, terms, maps_root or new_path(spark, "maps"), use_fuzzy)
    run_available(stream, lambda batch, i: write_batch(resolve_with(batch, known), root, i), checkpoint)
    id_type = stream.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, source string, target string, method string, confidence double, matched_key string"
    return read_batches(spark, root, schema).drop("batch")


# ---------------------------------------------------------------- match database and history

def stream_match_db(stream: DataFrame, root: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Follow result records into the match database.

    A batch appends its folded alias rows instead of rewriting the database. Batches are folded into levels as they accumulate, so reading
    opens few folders after any number of batches; ``write_match_db`` writes what is read as a new snapshot.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, "alias-log")
    log = alias_log(spark, root, _alias_schema(stream))
    run_available(stream, lambda batch, i: log.write(matchdb.rebuild_aliases(batch), i), checkpoint)
    return log.read()


def _alias_schema(records: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    return (f"target string, source string, ts {kind['ts']}, trace_id {kind['trace_id']}, method string, "
            "confidence double, verified boolean")


def alias_log(spark: SparkSession, root: str, schema: str) -> Levels:
    """Reader and writer of the alias log below ``root``; ``read`` gives the current aliases."""
    return Levels(spark, root, schema, matchdb.merge_aliases)


def stream_history(stream: DataFrame, root: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Current entry and number of entries per source while results arrive in any order.

    The newest timestamp stays current, so a late result is counted but never shown as newest.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, "history")
    run_available(stream, lambda batch, i: write_batch(matchdb.history_latest(batch), root, i), checkpoint)
    empty = spark.createDataFrame([], stream.schema)
    per_batch = read_batches(spark, root, matchdb.history_latest(empty).schema).drop("batch")
    return matchdb.merge_history(per_batch)


def stream_bounded_history(stream: DataFrame, limit: int = matchdb.HISTORY_LIMIT, root: str | None = None,
                           checkpoint: str | None = None) -> DataFrame:
    """The ``limit`` newest entries: every batch keeps its own newest ones, the newest of these are the result."""
    spark = stream.sparkSession
    root = root or new_path(spark, "bounded")
    run_available(stream, lambda batch, i: write_batch(matchdb.event_list_recent(batch, limit), root, i), checkpoint)
    return matchdb.event_list_recent(read_batches(spark, root, stream.schema).drop("batch"), limit)


# ---------------------------------------------------------------- batches of work

def stream_batches(starts: DataFrame, completes: DataFrame, root: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Pair batch_start with batch_complete events of two streams ``(batch_id, timestamp, ...)``, however far apart they arrive.

    The state is what isn't paired yet: every micro-batch reads it from the folder of the one before, pairs it with what is new and writes
    the rest, so its cost follows the open batches. A start is closed by the earliest completion at or after it that is known by then;
    later ones wait for a start of their own. A start without one stays with nulls, as in the batch operator.
    """
    spark = starts.sparkSession
    root = root or new_path(spark, "batches")
    begun = starts.select("batch_id", F.struct(F.col("timestamp").alias("started_at"), "user_prompt", "item_count").alias("begun"))
    done = completes.select("batch_id", F.struct(F.col("timestamp").alias("completed_at"), "success_count", "error_count", "total_time_ms").alias("done"))
    events = begun.unionByName(done, allowMissingColumns=True).select("batch_id", "begun", "done")

    def pair(batch: DataFrame, i: int) -> None:
        known = batch if i == 0 else batch.unionByName(spark.read.schema(events.schema).parquet(batch_path(f"{root}/open", i - 1)))
        known = stage(known, "batch-events")
        opened, closing = (known.where(F.col(c).isNotNull()).select("batch_id", c) for c in ("begun", "done"))
        pairs = opened.join(closing, "batch_id").where("done.completed_at >= begun.started_at")
        write_batch(pairs.groupBy("batch_id", "begun").agg(F.min("done").alias("done")), f"{root}/paired", i)
        paired = spark.read.schema(events.schema).parquet(batch_path(f"{root}/paired", i))
        rest = [known.where(F.col(c).isNotNull()).join(paired.select(F.col("batch_id").alias("_id"), F.col(c).alias("_c")),
                                                       F.col("batch_id").eqNullSafe(F.col("_id")) & (F.col(c) == F.col("_c")), "left_anti")
                for c in ("begun", "done")]
        write_batch(rest[0].unionByName(rest[1]), f"{root}/open", i)
        write_batch(spark.range(1), f"{root}/marks", i)

    run_available(events, pair, checkpoint)
    last = read_batches(spark, f"{root}/marks", "id long").agg(F.max("batch")).first()[0]
    rows = read_batches(spark, f"{root}/paired", events.schema).drop("batch")
    if last is not None:
        rows = rows.unionByName(spark.read.schema(events.schema).parquet(batch_path(f"{root}/open", last)).where("begun IS NOT NULL"))
    return rows.select("batch_id", "begun.user_prompt", "begun.item_count", "begun.started_at", "done.success_count", "done.error_count",
                       "done.total_time_ms", "done.completed_at")
