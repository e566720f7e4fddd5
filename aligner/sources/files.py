"""Readers for the file layouts: reference tables, mapping sheets, telemetry, experiment folders, match database.

JSON readers take both layouts: one object per line (``multi_line=False``) or one object per file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligner import schemas
from aligner.functions.text import trimmed
from aligner.sources.tree import read_tree

# Fixed value: first cell of the header row of a mapping sheet.
MAPPINGS_HEADER = "Material name in BOM"


def read_reference_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Header-first table as string rows, blanks as null."""
    if fmt == "csv":
        return spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE").csv(path)
    return spark.read.format(fmt).load(path)


def read_mappings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column mapping lines; header and blank lines skipped, a missing second cell is empty."""
    return parse_mapping_lines(spark.read.text(path))


def parse_mapping_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = F.split(column, "\t", 2)
    return (
        lines.filter(trimmed(column) != "").filter(F.get(parts, 0) != MAPPINGS_HEADER)
        .select(trimmed(F.get(parts, 0)).alias("bom_material"), trimmed(F.coalesce(F.get(parts, 1), F.lit(""))).alias("dataset_entry"))
    )


def _read_json(spark: SparkSession, path: str, schema: str, multi_line: bool, file: bool = False, attempts: DataFrame | None = None, **options) -> DataFrame:
    """JSON text parsed with a fixed schema; what is not valid JSON is left out. ``file`` keeps the path as ``_path``, ``attempts`` are those
    whose files count (all if None).

    Parsing is an expression over the text source: unlike the JSON source it can be counted without naming columns.
    """
    if attempts is not None:
        options["recursiveFileLookup"] = True
    text = spark.read.options(**options).text(path, wholetext=multi_line).filter(F.trim("value") != "")
    text = text.select("value", F.col("_metadata.file_path").alias("_path"))
    if attempts is not None:
        text = text.withColumn("attempt", F.regexp_extract("_path", r"/attempt=([^/]+)/", 1)).join(attempts, "attempt", "left_semi")
    parsed = F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = text.select("_path", parsed.alias("r")).filter(F.col("r._corrupt").isNull())
    out = rows.select("_path", "r.*").drop("_corrupt")
    return out if file else out.drop("_path")


def read_traces(spark: SparkSession, path: str, multi_line: bool = False, attempts: DataFrame | None = None) -> DataFrame:
    """Traces with a query and a target; corrupt ones are skipped."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return _read_json(spark, path, schemas.TRACE, multi_line, attempts=attempts).filter(given("input.query") & given("output.target"))


def read_observations(spark: SparkSession, path: str, multi_line: bool = False, attempts: DataFrame | None = None) -> DataFrame:
    """Observations of all traces; without a trace id in the record the name of its folder is taken."""
    df = _read_json(spark, path, schemas.OBSERVATION, multi_line, True, attempts, recursiveFileLookup=True)
    folder = F.regexp_extract("_path", r"/([^/]+)/[^/]+$", 1)
    return df.withColumn("trace_id", F.coalesce("trace_id", folder)).drop("_path")


def read_scores(spark: SparkSession, path: str, attempts: DataFrame | None = None) -> DataFrame:
    return _read_json(spark, path, schemas.SCORE, False, attempts=attempts)


def read_dataset_items(spark: SparkSession, path: str, multi_line: bool = False, attempts: DataFrame | None = None) -> DataFrame:
    return _read_json(spark, path, schemas.DATASET_ITEM, multi_line, attempts=attempts, recursiveFileLookup=True)


def read_event_log(spark: SparkSession, path: str, attempts: DataFrame | None = None) -> DataFrame:
    return _read_json(spark, path, schemas.EVENT, False, attempts=attempts)


COMMITS = "commits"
COMMIT = "run string, attempt string, number int"
TELEMETRY_KINDS = ("traces", "observations", "scores", "events", "items")


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """``(run, attempt, number)`` of all attempts that were written to their end; none if the folder holds none."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def read_committed(spark: SparkSession, root: str, kind: str, run: str = "*", day: str = "*") -> DataFrame:
    """Records of a kind that ``sinks.write_telemetry`` wrote as JSON, of every run's last complete attempt; of one run or day, if given."""
    last = read_commits(spark, root).groupBy("run").agg(F.max_by("attempt", F.struct("number", "attempt")).alias("attempt")).select("attempt")
    readers = dict(zip(TELEMETRY_KINDS, (read_traces, read_observations, read_scores, read_event_log, read_dataset_items), strict=True))
    return readers[kind](spark, f"{root}/{kind}/run={run}/attempt=*/day={day}", attempts=last)


def read_eval_results(spark: SparkSession, path: str, schema: str = schemas.EVALUATION) -> DataFrame:
    """Evaluation rows, one JSON object per line; invalid lines are dropped."""
    return _read_json(spark, path, schema, False)


def read_run_traces(spark: SparkSession, path: str, multi_line: bool = True, glob: str = "trace-*.json") -> DataFrame:
    """Trace files of a run in file-name order."""
    df = _read_json(spark, path, schemas.TRACE, multi_line, file=True, pathGlobFilter=glob)
    return df.withColumn("file_name", F.element_at(F.split("_path", "/"), -1)).drop("_path").orderBy("file_name", "id")


# ---------------------------------------------------------------- experiment folders

def read_filestore(spark: SparkSession, path: str, names_only: str | None = None) -> DataFrame:
    """All files of an experiment tree as ``(path, content)``; of a metric series its last line.

    Files below a folder called ``names_only`` are listed without their content. Files that don't lie in an experiment are left out.
    """
    return read_tree(spark, path, **({"names_only": names_only} if names_only else {}))


def parse_meta(files: DataFrame) -> DataFrame:
    """``key: value`` lines of meta files as rows ``(path, key, value, int_value)``.

    A line is split at its first colon, quotes are stripped, ``None`` is null, integers are also given as numbers. The
    last of repeated keys stands.
    """
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).filter(F.contains("line", F.lit(":")))
    raw = F.regexp_replace(trimmed(F.get(F.split("line", ":", 2), 1)), '^"+|"+$', "")
    return (
        lines.withColumn("key", F.get(F.split("line", ":", 2), 0)).withColumn("raw", raw)
        .groupBy("path", "key").agg(F.max_by("raw", "line_no").alias("raw"))
        .select("path", "key", F.when(F.col("raw") != "None", F.col("raw")).alias("value"), F.col("raw").try_cast("long").alias("int_value"))
    )


def parse_fields(files: DataFrame) -> DataFrame:
    """Params, metrics and tags (one file per key) as rows ``(run_path, field, key, value, number)``.

    Of a metric series ``timestamp value step`` the second field of the last line counts, as a number where it is one.
    """
    pattern = r"^(.*)/(params|metrics|tags)/([^/]+)$"
    content = trimmed("content")
    last_line = F.element_at(F.split(content, r"\r?\n"), -1)
    fields = F.split(trimmed(last_line), r"\s+")
    is_series = (F.col("field") == "metrics") & (F.size(fields) >= 2)
    value = F.when(is_series, F.get(fields, 1)).otherwise(content)
    return (
        files.filter(F.col("path").rlike(pattern))
        .withColumns({"run_path": F.regexp_extract("path", pattern, 1), "field": F.regexp_extract("path", pattern, 2), "key": F.regexp_extract("path", pattern, 3)})
        .withColumn("value", value)
        .select("run_path", "field", "key", "value", F.when(is_series, F.col("value").try_cast("double")).alias("number"))
    )


def run_detail(files: DataFrame) -> DataFrame:
    """One row per run folder: meta, params, metrics and tags as maps, artifact names.

    A run's folder holds a handful of keys; metric series were cut to their last line before.
    """
    meta = parse_meta(files.filter(F.col("path").endswith("/meta.yaml"))).withColumn("run_path", F.regexp_replace("path", "/meta.yaml$", ""))
    metas = meta.groupBy("run_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    fields = parse_fields(files)
    maps = fields.groupBy("run_path").pivot("field", ["params", "metrics", "tags"]).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))))
    pattern = r"^(.*)/artifacts/([^/]+)$"
    artifacts = files.filter(F.col("path").rlike(pattern)).groupBy(F.regexp_extract("path", pattern, 1).alias("run_path")).agg(
        F.array_sort(F.collect_list(F.regexp_extract("path", pattern, 2))).alias("artifacts"))
    return metas.join(maps, "run_path", "left").join(artifacts, "run_path", "left")


def trace_full_view(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Trace folders ``.../traces/<id>/`` with request metadata and tags as maps, one row per span with all the span's columns.

    ``files`` are ``(path, content)`` of ``request_metadata/<key>`` and ``tags/<key>``. A trace may have any number of spans, so they stay
    rows; one without spans has a row with nulls.
    """
    pattern = r"/traces/([^/]+)/(request_metadata|tags)/([^/]+)$"
    rows = files.filter(F.col("path").rlike(pattern)).select(
        F.regexp_extract("path", pattern, 1).alias("trace_id"), F.regexp_extract("path", pattern, 2).alias("field"),
        F.regexp_extract("path", pattern, 3).alias("key"), "content")
    maps = rows.groupBy("trace_id").pivot("field", ["request_metadata", "tags"]).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "content")))))
    return maps.join(spans, "trace_id", "left")


# ---------------------------------------------------------------- match database

def read_match_db(spark: SparkSession, path: str) -> DataFrame:
    """Alias rows of a persisted snapshot."""
    return spark.read.schema(schemas.ALIAS).parquet(path)
