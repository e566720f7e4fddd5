"""Key side of the tiers, prepared once per version of the maps and read by every job and micro-batch that resolves against it.

A version is a digest of the maps' rows. Its tables lie in a folder of their own that is never written again; a record named after the
version, written last, says which folder that is. So a preparation that broke off leaves no version behind, and a restarted job finds
the tables of the last one.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligner.functions.text import TOKEN_PATTERN
from aligner.operators.exact import known_keys
from aligner.operators.fuzzy import KeyTable, forward_keys, key_table, target_keys
from aligner.operators.postings import TermIndex, term_index
from aligner.session import new_path, written

_RECORD = "folder string, blocks long, pattern string, fuzzy boolean"


@dataclass(frozen=True)
class Maps:
    """Exact keys, the two key tables of the fuzzy tier (None: without it) and the posting lists of the terms."""

    exact: DataFrame
    forward: KeyTable | None
    targets: KeyTable | None
    terms: TermIndex


def prepare(forward: DataFrame, targets: DataFrame, terms: DataFrame, use_fuzzy: bool = True, pattern: str = TOKEN_PATTERN,
            folder: str | None = None) -> Maps:
    """Write the tables of ``forward`` (source, target, key_ord), ``targets`` (target, key_ord) and ``terms`` (term) to a new folder."""
    folder = folder or new_path(forward.sparkSession, "maps")
    return Maps(
        written(known_keys(forward, targets), os.path.join(folder, "exact")),
        key_table(forward_keys(forward), os.path.join(folder, "forward")) if use_fuzzy else None,
        key_table(target_keys(targets), os.path.join(folder, "targets")) if use_fuzzy else None,
        term_index(terms, pattern, path=os.path.join(folder, "terms")))


def version_of(forward: DataFrame, targets: DataFrame, terms: DataFrame) -> str:
    """Digest of the rows of the three tables, whatever their order; one pass over each with partial sums."""
    parts = []
    for i, (df, columns) in enumerate(((forward, ["source", "target", "key_ord"]), (targets, ["target", "key_ord"]), (terms, ["term"]))):
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        quarter = lambda n, row=row: F.sum(F.conv(F.substring(row, 15 * n + 1, 15), 16, 10).cast("decimal(38,0)"))
        parts.append(df.agg(F.concat_ws(",", F.lit(i), F.count(F.lit(1)), *[quarter(n).cast("string") for n in range(4)]).alias("part")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ";"), 256)).first()[0][:32]


def maps_of(forward: DataFrame, targets: DataFrame, terms: DataFrame, root: str, use_fuzzy: bool = True, pattern: str = TOKEN_PATTERN) -> Maps:
    """The maps below ``root`` in the version of these tables, prepared if it isn't there yet."""
    spark = forward.sparkSession
    version = version_of(forward, targets, terms)
    found = load(spark, root, version, use_fuzzy, pattern)
    if found is not None:
        return found
    folder = os.path.join(root, "tables", f"{version}-{uuid.uuid4().hex}")
    made = prepare(forward, targets, terms, use_fuzzy, pattern, folder)
    record = spark.createDataFrame([(folder, made.terms.blocks, pattern, use_fuzzy)], _RECORD)
    record.coalesce(1).write.mode("append").parquet(os.path.join(root, "versions", version))
    return made


def load(spark: SparkSession, root: str, version: str, use_fuzzy: bool = True, pattern: str = TOKEN_PATTERN) -> Maps | None:
    """A version written before by ``maps_of`` with at least the tiers asked for; None if there is none."""
    try:
        records = spark.read.schema(_RECORD).parquet(os.path.join(root, "versions", version))
        record = records.where((F.col("pattern") == pattern) & (F.col("fuzzy") | F.lit(not use_fuzzy))).orderBy("folder").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if record is None:
        return None
    table = lambda name: spark.read.parquet(os.path.join(record["folder"], name))
    return Maps(table("exact"), KeyTable(table("forward")) if use_fuzzy else None, KeyTable(table("targets")) if use_fuzzy else None,
                TermIndex(table("terms"), record["blocks"], pattern))
