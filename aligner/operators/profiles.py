"""Nested profile documents: leaf strings and query-token expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from aligner.functions.text import split_words, tokens


def flatten_profile(df: DataFrame, column: str, exclude: tuple[str, ...] = ("_metadata",)) -> Column:
    """All leaf values of a nested column as one array of strings, in field order, without excluded fields.

    The expression is derived from the schema, so it stays native and prunes excluded fields from the scan.
    """
    return _leaves(F.col(column), df.schema[column].dataType, set(exclude))


def _leaves(value: Column, kind: DataType, exclude: set[str]) -> Column:
    if isinstance(kind, StructType):
        parts = [_leaves(value[f.name], f.dataType, exclude) for f in kind.fields if f.name not in exclude]
        return F.concat(*parts) if parts else F.array().cast("array<string>")
    if isinstance(kind, MapType):
        kept = F.filter(F.map_entries(value), lambda e: ~e["key"].isin(*exclude))
        return F.flatten(F.transform(kept, lambda e: _leaves(e["value"], kind.valueType, exclude)))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda e: _leaves(e, kind.elementType, exclude))),
                          F.array().cast("array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def expanded_words(query: Column, leaves: Column) -> Column:
    """Distinct words of the query and of all profile leaves."""
    words = F.concat(split_words(query), F.flatten(F.transform(leaves, split_words)))
    return F.array_distinct(words)


def expanded_tokens(query: Column, leaves: Column) -> Column:
    """Distinct search tokens of the expanded words."""
    return tokens(F.array_join(expanded_words(query, leaves), " "))
