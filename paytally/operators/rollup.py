"""Rollup cells per (merchant, bucket, event type): build, merge, coarsen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions.time import bucket, event_time, period_key

CELL = ["merchant_id", "bucket", "event_type"]
MEASURES = ["count", "amount_sum_cents", "amount_min_cents", "amount_max_cents"]


def amount() -> Column:
    return F.coalesce(F.col("amount_cents"), F.lit(0))


def cells_from_events(events: DataFrame, grain: str) -> DataFrame:
    """Hash-aggregated on both sides of one shuffle: a hot merchant sends at most one
    row per cell and map task."""
    return events.groupBy(
        "merchant_id", bucket(grain, event_time()).alias("bucket"), "event_type"
    ).agg(
        F.count("*").alias("count"),
        F.sum(amount()).cast("bigint").alias("amount_sum_cents"),
        F.min(amount()).alias("amount_min_cents"),
        F.max(amount()).alias("amount_max_cents"),
    )


def _merged(cells: DataFrame) -> list[Column]:
    columns = [
        F.sum("count").cast("bigint").alias("count"),
        F.sum("amount_sum_cents").cast("bigint").alias("amount_sum_cents"),
        F.min("amount_min_cents").alias("amount_min_cents"),
        F.max("amount_max_cents").alias("amount_max_cents"),
    ]
    if "updated_at" in cells.columns:
        columns.append(F.max("updated_at").alias("updated_at"))
    return columns


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Additive merge of stored cells and deltas."""
    cells = reduce(DataFrame.unionByName, parts)
    keys = [*CELL, *(c for c in ("bucket_date", "bucket_month") if c in cells.columns)]
    return cells.groupBy(*keys).agg(*_merged(cells))


def coarsen(cells: DataFrame, grain: str) -> DataFrame:
    """Coarser cells from finer ones; far fewer rows to shuffle than the events."""
    return cells.groupBy(
        "merchant_id", bucket(grain, F.col("bucket")).alias("bucket"), "event_type"
    ).agg(*_merged(cells))


def rollup_chain(events: DataFrame) -> dict[str, DataFrame]:
    minute = cells_from_events(events, "minute")
    hour = coarsen(minute, "hour")
    return {"minute": minute, "hour": hour, "day": coarsen(hour, "day")}


def backfill_cells(rows: DataFrame, grain: str) -> DataFrame:
    """Backfill deltas ``(merchant_id, bucket, event_type, count_delta, amount_cents)``:
    a delta adds its count and its amount once, and the amount bounds min and max."""
    return rows.groupBy(
        "merchant_id", bucket(grain, F.col("bucket")).alias("bucket"), "event_type"
    ).agg(
        F.sum("count_delta").cast("bigint").alias("count"),
        F.sum("amount_cents").cast("bigint").alias("amount_sum_cents"),
        F.min("amount_cents").alias("amount_min_cents"),
        F.max("amount_cents").alias("amount_max_cents"),
    )


def per_bucket(cells: DataFrame, *keys: str) -> DataFrame:
    """Sums across event types, per bucket."""
    return cells.groupBy(*keys, "bucket").agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.sum("amount_sum_cents"), F.lit(0)).cast("bigint").alias("volume_cents"),
    )


def totals(buckets: DataFrame, *keys: str) -> DataFrame:
    return buckets.groupBy(*keys).agg(
        F.coalesce(F.sum("volume_cents"), F.lit(0)).cast("bigint").alias("total_volume_cents"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_count"),
    )


def raw_totals(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """What a rollup read replaces: count and volume per merchant from the log."""
    when = event_time()
    return (
        events.where((when >= start) & (when < end))
        .groupBy("merchant_id")
        .agg(
            F.count("*").alias("count"),
            F.sum(amount()).cast("bigint").alias("volume_cents"),
        )
    )


def board_increments(events: DataFrame) -> DataFrame:
    """Confirmed volume per monthly period and merchant."""
    return (
        events.where(F.col("event_type") == schemas.CONFIRMED)
        .groupBy(period_key(event_time()).alias("period"), "merchant_id")
        .agg(
            F.sum(amount()).cast("bigint").alias("volume_cents"),
            F.count("*").alias("transaction_count"),
        )
    )


def merge_board(*parts: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("period", "merchant_id").agg(
        F.sum("volume_cents").cast("bigint").alias("volume_cents"),
        F.sum("transaction_count").cast("bigint").alias("transaction_count"),
    )


def events_per_day(log: DataFrame, days: int = 7) -> DataFrame:
    """Newest days first.."""
    return (
        log.groupBy(F.date_trunc("day", "occurred_at").alias("day"))
        .agg(F.count("*").alias("events"))
        .orderBy(F.desc("day"))
        .limit(days)
    )
