"""Reference-table preparation: validated forward and reverse maps from mapping sheets.

A sheet is a DataFrame ``(source_id, row_num, source, target)``; ``row_num`` is the sheet row, the header
being row 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.functions.text import trimmed


def clean_sheet(sheet: DataFrame, source: str = "source", target: str = "target",
                falsy_as_empty: bool = True) -> DataFrame:
    """Cells as trimmed strings; null is empty, and so are numeric 0 and false unless told otherwise."""
    return sheet.withColumns({
        source: _cell(sheet, source, falsy_as_empty),
        target: _cell(sheet, target, falsy_as_empty),
    })


def _cell(sheet: DataFrame, name: str, falsy_as_empty: bool) -> Column:
    text = trimmed(F.coalesce(F.col(name).cast("string"), F.lit("")))
    kind = dict(sheet.dtypes)[name]
    if not falsy_as_empty or kind == "string":
        return text
    empty = ~F.col(name) if kind == "boolean" else F.col(name) == 0
    return F.when(empty, F.lit("")).otherwise(text)


def _usable(sheet: DataFrame) -> DataFrame:
    return clean_sheet(sheet).filter((F.col("source") != "") & (F.col("target") != ""))


def forward_map(sheet: DataFrame) -> DataFrame:
    """source -> target per sheet; the first row of a duplicate source wins.

    ``min_by`` aggregates map-side, so a source repeated over much of the sheet costs one row per task.
    """
    return (
        _usable(sheet).groupBy("source_id", "source")
        .agg(F.min(F.struct("row_num", "target")).alias("first"))
        .select("source_id", "source", "first.target", "first.row_num")
    )


def reverse_map(sheet: DataFrame) -> DataFrame:
    """target -> its aliases, one row per (target, alias) with the sheet row giving their order.

    Kept as rows: one target may own a large share of the sheet, so its aliases are never gathered into one
    array. ``alias`` is null for a target whose aliases all belong to an earlier row."""
    targets = _usable(sheet).select("source_id", "target").distinct()
    aliases = forward_map(sheet).select("source_id", "target", F.col("source").alias("alias"), "row_num")
    return targets.join(aliases, ["source_id", "target"], "left")


def mapping_issues(sheet: DataFrame) -> DataFrame:
    """One line per row whose source was already mapped by an earlier row of the sheet."""
    rows = _usable(sheet).select("source_id", "source", "row_num")
    first = forward_map(sheet).select("source_id", "source", F.col("row_num").alias("first_row"))
    return (
        rows.join(first, ["source_id", "source"]).filter(F.col("row_num") > F.col("first_row"))
        .select("source_id", "row_num",
                F.format_string('Row %d: Duplicate source "%s"', F.col("row_num"), F.col("source")).alias("issue"))
    )


def empty_rows(sheet: DataFrame) -> DataFrame:
    """Rows left out because a cell is empty, with the kind: both / reference / alias."""
    kind = (
        F.when((F.col("source") == "") & (F.col("target") == ""), "both_empty")
        .when(F.col("target") == "", "reference_empty")
        .when(F.col("source") == "", "alias_empty")
    )
    return clean_sheet(sheet).withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("source_id", "row_num", "kind")


def mapping_metadata(sheet: DataFrame) -> DataFrame:
    """Per sheet: rows, valid mappings, targets, duplicate-source issues."""
    ok = (F.col("source") != "") & (F.col("target") != "")
    return (
        clean_sheet(sheet).groupBy("source_id").agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_distinct(F.when(ok, F.col("source"))).alias("valid_mappings"),
            F.count_distinct(F.when(ok, F.col("target"))).alias("targets"),
            (F.count(F.when(ok, 1)) - F.count_distinct(F.when(ok, F.col("source")))).alias("issues"),
        )
    )


def combine_forward(forward: DataFrame) -> DataFrame:
    """Across sheets the last sheet wins per source; ``key_ord`` is the insertion order of the key."""
    return (
        forward.groupBy("source").agg(
            F.max(F.struct("source_id", "target")).alias("last"),
            F.min(F.struct("source_id", "row_num")).alias("key_ord"),
        ).select("source", "last.target", "key_ord")
    )


def combine_reverse(reverse: DataFrame) -> DataFrame:
    """Across sheets the last sheet replaces all alias rows of a target."""
    last = reverse.groupBy("target").agg(F.max("source_id").alias("source_id"))
    return reverse.join(last, ["target", "source_id"])


def term_list(reverse: DataFrame) -> DataFrame:
    """Distinct targets: the search index."""
    return reverse.select(F.col("target").alias("term")).distinct()


def terms_per_source(reverse: DataFrame) -> DataFrame:
    return reverse.groupBy("source_id").agg(F.count_distinct("target").alias("terms"))


def existing_pairs(rows: DataFrame, column_map: dict[str, str], row_col: str = "row") -> DataFrame:
    """Filled (input, output) pairs of a workbook as result rows, one per cell pair."""
    stacked = None
    for pair, (input_col, output_col) in enumerate(column_map.items()):
        part = rows.select(
            F.col(row_col).alias("row"), F.lit(pair).alias("pair"),
            trimmed(F.coalesce(F.col(input_col).cast("string"), F.lit(""))).alias("source"),
            trimmed(F.coalesce(F.col(output_col).cast("string"), F.lit(""))).alias("target"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return (
        stacked.filter((F.col("source") != "") & (F.col("target") != ""))
        .withColumn("method", F.lit("PreExisting")).withColumn("confidence", F.lit(1.0))
    )


def ingest_existing_pairs(pairs: DataFrame, forward: DataFrame) -> DataFrame:
    """New forward entries from existing pairs: reference keys are never overwritten, the first pair wins."""
    return (
        pairs.join(forward.select("source"), "source", "left_anti")
        .groupBy("source").agg(F.min(F.struct("pair", "row", "target")).alias("first"))
        .select("source", "first.target")
    )


# Lower bounds of the confidence bands.
BANDS = (("excellent", 0.9), ("good", 0.8), ("moderate", 0.6), ("low", 0.2))


def confidence_band(confidence: Column) -> Column:
    """Band name of a confidence; a value above 1 is read as percent."""
    share = F.when(confidence > 1, confidence / 100).otherwise(confidence)
    band = F.lit("none")
    for name, bound in reversed(BANDS):
        band = F.when(share >= bound, name).otherwise(band)
    return band


def confidence_percent(confidence: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(confidence * 100 + 0.5).cast("int")
