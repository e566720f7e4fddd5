"""Deterministic identifiers: a timestamp prefix and hex digits of a hash instead of random ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dated_id(ts: Column, key: Column, length: int = 32) -> Column:
    """``yyMMddHHmmss`` followed by hex digits of ``md5(key)`` up to ``length`` characters."""
    return F.concat(F.date_format(ts, "yyMMddHHmmss"), F.substring(F.md5(key.cast("string")), 1, length - 12))


def prefixed_id(prefix: str, key: Column, length: int) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.md5(key.cast("string")), 1, length))
