"""Late events, lag and rate reports, and log paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions.time import event_time, lag_seconds, seconds_between, ts_lit


def late_events(
    events: DataFrame, as_of: Column, threshold_s: float = schemas.LATE_THRESHOLD_S
) -> DataFrame:
    """Events whose event time is more than ``threshold_s`` before ``as_of`` (the time of
    processing), with the producer's own delay beside that lag."""
    lag = seconds_between(as_of, event_time())
    return events.where(lag > threshold_s).select(
        F.col("id").alias("event_id"),
        "merchant_id",
        event_time().alias("event_ts"),
        F.bround(lag, 1).alias("lag_seconds"),
        seconds_between(F.col("occurred_at"), F.col("client_timestamp")).alias("client_delay_s"),
    )


def lag_histogram(lags: DataFrame) -> DataFrame:
    """Cumulative counts ``lag <= bound`` per worker from ``(worker_id, lag_seconds)``.

    All bounds are counted in one aggregation; only its result, one row per worker, is
    unfolded into a row per bound.
    """
    bounds = schemas.LAG_BOUNDS_S
    counts = lags.groupBy("worker_id").agg(
        *[F.count_if(F.col("lag_seconds") <= b).alias(f"_{i}") for i, b in enumerate(bounds)],
        F.sum("lag_seconds").alias("lag_sum"),
    )
    rows = [
        F.struct(F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"_{i}").alias("count"))
        for i, b in enumerate(bounds)
    ]
    return counts.select("worker_id", "lag_sum", F.inline(F.array(*rows)))


def batch_lag(events: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """Lag of the last event of each batch, floored at zero, as the worker reports it."""
    last = F.max_by(event_time(), F.struct("occurred_at", "id"))
    return events.groupBy(*keys).agg(
        F.count("*").alias("fetched"),
        lag_seconds(as_of, last).alias("lag_seconds"),
    )


def consumer_positions(commits: DataFrame) -> DataFrame:
    """Where each consumer stands: its newest commit row."""
    newest = F.max_by(
        F.struct("last_event_id", "last_event_at", "updated_at"),
        F.struct("updated_at", "src_batch"),
    )
    return commits.where(F.col("last_event_at").isNotNull()).groupBy("consumer_id").agg(
        newest.alias("_newest")
    ).select("consumer_id", "_newest.*")


def pipeline_lag(
    positions: DataFrame,
    consumers: DataFrame,
    as_of: datetime | str,
    threshold_s: float = schemas.LAG_THRESHOLD_S,
) -> DataFrame:
    """Status per consumer: ok, degraded past the threshold, unknown without a position."""
    lag = F.bround(seconds_between(ts_lit(as_of), F.col("last_event_at")), 1)
    status = (
        F.when(F.col("lag_seconds").isNull(), "unknown")
        .when(F.col("lag_seconds") > threshold_s, "degraded")
        .otherwise("ok")
    )
    return (
        consumers.select("consumer_id")
        .distinct()
        .join(positions, "consumer_id", "left")
        .withColumn("lag_seconds", lag)
        .withColumn("status", status)
        .select("consumer_id", "last_event_id", "last_event_at", "lag_seconds", "status")
    )


def ingestion_rate(log: DataFrame) -> DataFrame:
    """Accepted events per second of arrival. Works on a stream as well."""
    return (
        log.groupBy(F.window("occurred_at", "1 second").alias("_second"))
        .agg(F.count("*").alias("events_per_second"))
        .select(F.col("_second.start").alias("second"), "events_per_second")
    )


def recent_events(log: DataFrame, limit: int = 20, since: datetime | None = None) -> DataFrame:
    """Newest events first; ``since`` prunes the log's day partitions."""
    if since is not None:
        log = log.where(F.col("occurred_date") >= F.lit(since.date()))
    return log.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)


def events_after(
    log: DataFrame,
    cursor: tuple[datetime | str, object] | None = None,
    limit: int = schemas.DEFAULT_PAGE,
) -> DataFrame:
    """One page of the log in ``(created_at, id)`` order, past the cursor.

    Comparing both parts keeps rows that share the cursor's timestamp. The page size
    is the operator's own argument; the plan is a per-task top-n.
    """
    if cursor is not None:
        at, last_id = ts_lit(cursor[0]), F.lit(cursor[1])
        created = F.col("created_at")
        log = log.where(
            (created >= at) & ((created > at) | ((created == at) & (F.col("id") > last_id)))
        )
    return log.orderBy("created_at", "id").limit(limit)
