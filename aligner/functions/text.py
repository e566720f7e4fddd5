"""Column expressions on strings; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns must equal the reference behaviour for equal results.
TOKEN_PATTERN = "[a-zA-Z0-9]+"
NON_WORD_PATTERN = r"[^\w\s%]"
EDGE_SPACE_PATTERN = r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$"


def trimmed(col: Column | str) -> Column:
    """Strip Unicode white space on both ends (``F.trim`` strips blanks only)."""
    return F.regexp_replace(_col(col), EDGE_SPACE_PATTERN, "")


def tokens(col: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Distinct lower-case tokens in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(col)), F.lit(f"({pattern})"), F.lit(1)))


def normalized_words(col: Column | str) -> Column:
    """Lower-case words; everything but ASCII word characters and ``%`` separates words."""
    cleaned = F.regexp_replace(F.lower(_col(col)), NON_WORD_PATTERN, " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")


def split_words(col: Column | str) -> Column:
    """White-space separated words, empties dropped."""
    return F.filter(F.split(_col(col), r"\s+"), lambda w: w != "")


def round_half_even(col: Column, scale: int) -> Column:
    return F.bround(col, scale)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
