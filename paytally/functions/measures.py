"""Measure expressions over rollup cells, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_where(event_type: str, measure: str = "count") -> Column:
    return F.sum(F.when(F.col("event_type") == event_type, F.col(measure)).otherwise(F.lit(0)))


def success_rate(confirmed: Column, failed: Column) -> Column:
    """confirmed / (confirmed + failed) to four digits, half-even; null without either."""
    total = confirmed + failed
    return F.when(total > 0, F.bround(confirmed / total, 4))


def as_uuid(text: Column) -> Column:
    """A UUID-shaped digest: the same input gives the same id in every task attempt."""
    digest = F.substring(F.sha2(text, 256), 1, 32)
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
