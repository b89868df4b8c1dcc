"""Leaderboards: period boards, point-in-time snapshots, snapshot history."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions.measures import as_uuid
from paytally.functions.time import month_bounds, snapshot_end, snapshot_start, ts_lit, within_days
from paytally.operators.joins import lookup_join


def check_top_n(n: int) -> int:
    if not 1 <= n <= schemas.MAX_TOP_N:
        raise ValueError(f"top_n must be in 1..{schemas.MAX_TOP_N}")
    return n


def confirmed_volumes(day_cells: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Volume and transactions per merchant over the half-open range."""
    bucket = F.col("bucket")
    return (
        within_days(day_cells, start.date(), end.date()).where(
            (bucket >= ts_lit(start))
            & (bucket < ts_lit(end))
            & (F.col("event_type") == schemas.CONFIRMED)
        )
        .groupBy("merchant_id")
        .agg(
            F.sum("amount_sum_cents").cast("bigint").alias("volume_cents"),
            F.sum("count").cast("bigint").alias("transaction_count"),
        )
    )


def top_n(volumes: DataFrame, n: int = schemas.DEFAULT_TOP_N) -> DataFrame:
    """The ``n`` largest volumes with their position; equal volumes go by merchant id.

    The limit is planned as a per-task top-n, so the window sees at most ``n`` rows.
    """
    order = [F.desc("volume_cents"), F.asc("merchant_id")]
    leaders = volumes.orderBy(*order).limit(check_top_n(n))
    return leaders.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def leaderboard(day_cells: DataFrame, period: str, n: int = schemas.DEFAULT_TOP_N) -> DataFrame:
    """A month's board computed from the day rollup."""
    start, end = month_bounds(period)
    return _as_board(top_n(confirmed_volumes(day_cells, start, end), n), period, "rollup_day")


def leaderboard_from_board(
    board: DataFrame, period: str, n: int = schemas.DEFAULT_TOP_N
) -> DataFrame:
    """A month's board from the materialised period table."""
    rows = board.where(F.col("period") == period).drop("period")
    return _as_board(top_n(rows, n), period, "board")


def _as_board(ranked: DataFrame, period: str, source: str) -> DataFrame:
    start, end = month_bounds(period)
    return ranked.select(
        F.lit(period).alias("period"),
        ts_lit(start).alias("period_start"),
        ts_lit(end).alias("period_end"),
        "rank",
        "merchant_id",
        "volume_cents",
        "transaction_count",
        F.lit(source).alias("source"),
    ).orderBy("rank")


def snapshots(
    day_cells: DataFrame, period: str, created_at: Column | None = None
) -> DataFrame:
    """Top-100 ranking of every ``period`` that ``day_cells`` cover; ties share a rank.

    ``row_number() <= 100`` lets each task drop all but its own 100 leaders of a period
    before the shuffle. Ranks over those 100 equal ranks over all merchants, since a
    rank counts only strictly larger volumes.
    """
    volumes = (
        day_cells.where(F.col("event_type") == schemas.CONFIRMED)
        .groupBy(snapshot_start(period, F.col("bucket")).alias("period_start"), "merchant_id")
        .agg(F.sum("amount_sum_cents").cast("bigint").alias("amount_sum_cents"))
    )
    largest = Window.partitionBy("period_start").orderBy(F.desc("amount_sum_cents"))
    position = Window.partitionBy("period_start").orderBy(
        F.desc("amount_sum_cents"), F.asc("merchant_id")
    )
    leaders = (
        volumes.withColumn("_position", F.row_number().over(position))
        .where(F.col("_position") <= schemas.SNAPSHOT_TOP_N)
        .withColumn("rank", F.rank().over(largest))
    )
    name = F.concat_ws("|", F.lit(period), F.col("period_start"), F.col("merchant_id"))
    return leaders.select(
        as_uuid(name).alias("id"),
        "merchant_id",
        "rank",
        "amount_sum_cents",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(period).alias("period"),
        "period_start",
    )


def period_range(period: str, day: date) -> tuple[date, date]:
    """Half-open dates of the period that holds ``day``, for pruning before planning."""
    if period == "daily":
        return day, date.fromordinal(day.toordinal() + 1)
    if period == "weekly":
        monday = day.toordinal() - day.weekday()
        return date.fromordinal(monday), date.fromordinal(monday + 7)
    if period == "monthly":
        start, end = month_bounds(day.strftime("%Y-%m"))
        return start.date(), end.date()
    raise ValueError(f"period must be one of {schemas.PERIODS}")


def snapshot_history(
    stored: DataFrame, merchants: DataFrame, period: str = "monthly", limit: int = 12
) -> DataFrame:
    """The newest ``limit`` snapshots, one row each with its ranked entries.

    The newest period starts are a top-``limit`` of distinct dates (at most 52 rows);
    a snapshot holds at most 100 entries, which bounds the array.
    """
    if period not in schemas.PERIODS:
        raise ValueError(f"period must be one of {schemas.PERIODS}")
    if not 1 <= limit <= 52:
        raise ValueError("limit must be in 1..52")
    rows = stored.where(F.col("period") == period)
    newest = rows.select("period_start").distinct().orderBy(F.desc("period_start")).limit(limit)
    kept = rows.join(F.broadcast(newest), "period_start", "left_semi")
    names = merchants.select("merchant_id", F.col("name").alias("merchant_name"))
    named = lookup_join(kept, names, ["merchant_id"], "left")
    entry = F.struct(
        "rank", "merchant_id", "merchant_name", F.col("amount_sum_cents").alias("volume_cents")
    )
    return (
        named.groupBy("period", "period_start")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("entries"),
            F.max("created_at").alias("generated_at"),
        )
        .select(
            "period",
            "period_start",
            snapshot_end(F.col("period"), F.col("period_start")).alias("period_end"),
            "entries",
            F.lit("snapshot").alias("source"),
            "generated_at",
        )
        .orderBy(F.desc("period_start"))
    )
