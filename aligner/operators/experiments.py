"""Experiments: listings, metrics, notations, dependencies, datasets, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _checked_limit(limit: int, most: int | None) -> int:
    if limit < 0 or (most is not None and limit > most):
        raise ValueError(f"a page of {limit} rows; at most {most} are allowed")
    return limit


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """One page of the whole table with its total; Spark takes the first offset + limit rows per task.

    A page larger than ``most`` is refused, never cut.
    """
    limit = _checked_limit(limit, most)
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def page_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """The same page for every group at once, with the group's total; Spark limits each group before the shuffle."""
    limit = _checked_limit(limit, most)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_n", place).filter(F.col("_n") <= offset + limit).filter(F.col("_n") > offset)
        .drop("_n").join(totals, keys)
    )


def list_experiments(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Experiments with their number of runs, oldest first."""
    counts = runs.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("num_runs"))
    return (
        experiments.join(counts, "experiment_id", "left").withColumn("num_runs", F.coalesce("num_runs", F.lit(0).cast("long")))
        .orderBy(F.coalesce("creation_time", F.lit(0)), "experiment_id")
    )


# The largest pages of the listings.
RUNS_PAGE, TRACES_PAGE, ITEMS_PAGE = 200, 500, 500


def list_runs(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest runs of every experiment, paged."""
    return page_per_group(runs, ["experiment_id"], [F.desc("start_time"), F.asc("run_id")], limit, offset, RUNS_PAGE)


def list_traces(traces: DataFrame, limit: int = 50, offset: int = 0, by_experiment: bool = False) -> DataFrame:
    """Newest traces, paged: over all experiments, or of every experiment (``experiment_id``)."""
    order = [F.desc("request_time"), F.asc("trace_id")]
    if by_experiment:
        return page_per_group(traces, ["experiment_id"], order, limit, offset, TRACES_PAGE)
    return page(traces, order, limit, offset, TRACES_PAGE)


def latest_metric(series: DataFrame, keys: list[str]) -> DataFrame:
    """Last line of every metric series ``(keys, line_no, value)``, numeric where it can be read as a number.

    ``line_no`` may be a struct to break ties.
    """
    return series.groupBy(*keys).agg(F.max_by("value", "line_no").alias("raw")).withColumn(
        "value", F.col("raw").cast("string").try_cast("double"))


def pipeline_notation(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Short notation per pipeline from steps ``(keys, order, type, name)``.

    Model steps are numbered, function names written as CapWords, other steps keep their name. A pipeline is a short
    configuration list, so its steps are gathered.
    """
    listed = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "type", "name"))).alias("steps"))
    number = lambda i: F.size(F.filter(F.slice("steps", 1, i + 1), lambda s: s["type"] == "LLMGeneration"))
    camel = lambda name: F.replace(F.initcap(F.replace(F.coalesce(name, F.lit("Function")), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    parts = F.transform("steps", lambda s, i: F.when(s["type"] == "LLMGeneration", F.concat(F.lit("LLM"), number(i).cast("string")))
                        .when(s["type"] == "DeterministicFunction", camel(s["name"])).otherwise(F.coalesce(s["name"], s["type"])))
    return listed.select(*keys, F.array_join(parts, "-").alias("notation"))


def resolve_dependencies(steps: DataFrame, prompts: DataFrame, configs: DataFrame) -> DataFrame:
    """Prompts and node configurations the runs use: ``(kind, key, version, resolved)``.

    ``steps`` is ``(config_id, type, name, prompt_version)``, ``prompts`` ``(family, version)``, ``configs`` ``(config_id)``.
    A version that is not a number means the latest one of the family.
    """
    digits = F.replace("prompt_version", F.lit("v"), F.lit(""))
    used = (
        steps.filter(F.col("type") == "LLMGeneration").select(
            F.col("name").alias("family"), F.coalesce("prompt_version", F.lit("")).alias("given"),
            F.when(digits.rlike("^[0-9]+$"), digits.cast("int")).alias("asked")).distinct()
    )
    known = prompts.select("family", "version").distinct()
    latest = known.groupBy("family").agg(F.max("version").alias("latest"))
    wanted = used.join(latest, "family", "left").withColumn("version", F.coalesce("asked", "latest"))
    found = wanted.join(known.withColumn("ok", F.lit(True)), ["family", "version"], "left")
    as_prompt = found.select(F.lit("prompt").alias("kind"), F.concat_ws("/", "family", "given").alias("key"),
                             F.when(F.col("ok"), F.col("version")).alias("version"), F.coalesce("ok", F.lit(False)).alias("resolved"))
    used_configs = steps.select("config_id").filter(F.col("config_id").isNotNull()).distinct()
    as_config = used_configs.join(configs.select("config_id").distinct(), "config_id", "left_semi").select(
        F.lit("config").alias("kind"), F.col("config_id").alias("key"), F.lit(None).cast("int").alias("version"), F.lit(True).alias("resolved"))
    return as_prompt.unionByName(as_config)


def experiment_mappings(experiments: DataFrame, mappings: DataFrame, runs: DataFrame, steps: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Runs of every experiment with notation, evaluation rows and the experiment's number of mappings and ground-truth gaps.

    ``mappings`` is ``(experiment_id, bom_material, dataset_entry)`` with ``--`` for "no match exists"; ``steps`` is
    ``(run_id, pos, type, name, ...)``; ``evaluations`` is ``(run_id, correct)``.
    """
    mapped = mappings.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("mappings"), F.count(F.when(F.col("dataset_entry") == "--", 1)).alias("no_match_rows"))
    order = [c for c in steps.columns if c not in ("run_id", "type", "name")]
    notation = pipeline_notation(steps, ["run_id"], order)
    counts = evaluations.groupBy("run_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count(F.when(F.col("correct"), 1)).alias("correct"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (
        experiments.select("experiment_id").join(mapped, "experiment_id", "left").join(runs.select("experiment_id", "run_id"), "experiment_id", "left")
        .join(notation, "run_id", "left").join(counts, "run_id", "left")
        .select("experiment_id", "run_id", "notation", zero("mappings"), zero("no_match_rows"), zero("evaluated"), zero("correct"))
    )


def list_datasets(items: DataFrame) -> DataFrame:
    return items.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("items"))


def dataset_items_page(items: DataFrame, limit: int = 50, offset: int = 0, by_dataset: bool = False) -> DataFrame:
    """Items by id descending, paged: of the whole table, or of every dataset (``dataset_name``)."""
    if by_dataset:
        return page_per_group(items, ["dataset_name"], [F.desc("id")], limit, offset, ITEMS_PAGE)
    return page(items, [F.desc("id")], limit, offset, ITEMS_PAGE)


def status_snapshot(aliases: DataFrame, experiments: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row of totals; the counts of other tables are scalar subqueries."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return aliases.agg(F.count_distinct("target").alias("identifiers"), F.count(F.lit(1)).alias("aliases")).withColumns(
        {"experiments": count(experiments), "mappings": count(mappings)})


# ---------------------------------------------------------------- sweeps

def variant_grid(axes: DataFrame, names: list[str], active_steps: list[str]) -> DataFrame:
    """All combinations of the values of the axes ``(axis, step, value)`` whose step is active.

    ``names`` lists the axes of a grid, in column order; axes of inactive steps fall out as null columns. An axis is a
    short list of declared values; the grid is dealt out again after every axis, so no task builds more than its share.
    """
    kept = axes.filter(F.col("step").isin(active_steps)).select("axis", "value").distinct()
    values = lambda name: kept.filter(F.col("axis") == name).agg(F.array_sort(F.collect_list("value"))).scalar()
    grid = kept.agg(F.count(F.lit(1)).alias("_n"))
    for i, name in enumerate(names):
        if i:
            grid = grid.repartition(*names[:i])
        grid = grid.withColumn("_values", values(name)).select(*names[:i], F.explode_outer("_values").alias(name))
    return grid


def config_hash(config: Column) -> Column:
    """Content hash of a configuration struct."""
    return F.sha2(F.to_json(config), 256)


def dedup_configs(configs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct configuration with its hash."""
    return configs.select(*columns).withColumn("config_hash", config_hash(F.struct(*columns))).dropDuplicates(["config_hash"])


def reuse_intermediates(requested: DataFrame, outputs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(steps whose output is already there, steps left to compute) on the given keys."""
    reused = requested.join(outputs, keys)
    todo = requested.join(outputs.select(*keys), keys, "left_anti")
    return reused, todo
