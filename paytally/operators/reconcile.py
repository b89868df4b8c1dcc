"""Reconciliation of day cells against the hours they were built from."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions.time import ts_lit, within_days
from paytally.operators.rollup import coarsen


def cells_of_date(cells: DataFrame, day: date) -> DataFrame:
    start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
    bucket = F.col("bucket")
    return within_days(cells, day, day).where((bucket >= ts_lit(start)) & (bucket < ts_lit(start + timedelta(days=1))))


def day_from_hours(hour_cells: DataFrame, day: date) -> DataFrame:
    """The canonical day cells of a date, recomputed from its hours."""
    return coarsen(cells_of_date(hour_cells, day), "day")


def discrepancies(
    day_cells: DataFrame, hour_cells: DataFrame, day: date, limit: int = 10
) -> DataFrame:
    """Day cells whose count differs from their hours, largest difference first.

    Run it before the day cells are replaced; afterwards it can only report day rows
    without hours. Both sides are aggregates holding a (merchant, type) once.
    """
    keys = ["merchant_id", "event_type"]
    hours = (
        cells_of_date(hour_cells, day)
        .groupBy(*keys)
        .agg(F.sum("count").cast("bigint").alias("hour_count"))
    )
    hour_count = F.coalesce(F.col("hour_count"), F.lit(0))
    return (
        cells_of_date(day_cells, day)
        .select(*keys, F.col("count").alias("day_count"))
        .join(hours, keys, "left")
        .select(
            *keys,
            "day_count",
            hour_count.alias("hour_count"),
            F.abs(F.col("day_count") - hour_count).alias("delta"),
        )
        .where(F.col("delta") > 0)
        .orderBy(F.desc("delta"), *keys)
        .limit(limit)
    )
