"""Replay-safe incremental rollup over the committed event log.

The stream reads the ingest commit rows, not the log directory, which also holds files
of batches that never committed. There is no watermark: an event of any age updates the
bucket it belongs to.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paytally import schemas
from paytally.functions.time import GRAINS, cell_parts, event_time, ts_lit
from paytally.operators.lag import late_events
from paytally.operators.rollup import backfill_cells, board_increments, cells_from_events, coarsen
from paytally.sources.state import Batches
from paytally.sources.store import IngestStore, RollupStore
from paytally.streaming.ingest import run_of


def unmarked(log: DataFrame, markers: DataFrame) -> DataFrame:
    """Events this consumer has not aggregated yet."""
    return log.join(markers.select(F.col("event_id").alias("id")), "id", "left_anti")


def write_cells(
    store: RollupStore, minute: DataFrame, run_id: str, batch_id: int, now: datetime
) -> int:
    """Minute deltas from the events, hours from the minutes, days from the hours: each
    level aggregates the previous one's kept rows instead of the events again. Returns
    the number of events counted."""
    levels = [minute.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        for grain in GRAINS:
            if grain != "minute":
                cells = coarsen(levels[-1], grain)
                levels.append(cells.persist(StorageLevel.MEMORY_AND_DISK))
            dated = cell_parts(levels[-1]).withColumn("updated_at", ts_lit(now))
            store.write(grain, dated, run_id, batch_id)
        return levels[-1].agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    finally:
        for cells in levels:
            cells.unpersist()


def rollup_batch(
    rollups: RollupStore,
    ingest: IngestStore,
    commits: DataFrame,
    run_id: str,
    batch_id: int,
    now: datetime | None = None,
) -> None:
    """Aggregate the log batches that ``commits`` names under ``(run_id, batch_id)``."""
    if rollups.is_committed(run_id, batch_id):
        return
    position = F.struct("last_event_at", "last_event_id")
    stats = commits.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("fetched"),
        F.max_by("last_event_id", position).alias("last_event_id"),
        F.max("last_event_at").alias("last_event_at"),
        F.max_by("last_event_ts", position).alias("last_event_ts"),
        F.min("min_occurred_date").alias("first_date"),
        F.max("max_occurred_date").alias("last_date"),
    ).first()
    # Commit rows only: their number per batch is bounded by maxFilesPerTrigger.
    named = commits.select("src_run", "src_batch", "accepted").collect()
    full = [(r["src_run"], r["src_batch"]) for r in named if r["accepted"] and r["accepted"] > 0]
    log = ingest.read_batches("log", full)
    taken = Batches.of((r["src_run"], r["src_batch"]) for r in named).rows()
    _aggregate(rollups, log, stats.asDict(), run_id, batch_id, now, taken=taken)


def _aggregate(
    rollups: RollupStore, log: DataFrame, stats: dict, run_id: str, batch_id: int, now: datetime | None, **row
) -> None:
    """Markers, cells, board and late events of the log rows no marker names yet, then the commit."""
    now = now or datetime.now(timezone.utc)
    # An event keeps its stored occurred_at, so only markers of these days can match.
    markers = rollups.read("markers", stats["first_date"], stats["last_date"])
    needed = [
        "id", "merchant_id", "event_type", "amount_cents", "occurred_at", "client_timestamp",
        "occurred_date",
    ]
    fresh = unmarked(log.select(*needed), markers).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        processed = fresh.select(
            F.col("id").alias("event_id"), ts_lit(now).alias("processed_at"), "occurred_date"
        )
        rollups.write("markers", processed, run_id, batch_id)
        new = write_cells(rollups, cells_from_events(fresh, "minute"), run_id, batch_id, now)
        rollups.write("board", board_increments(fresh), run_id, batch_id)
        late = late_events(fresh, ts_lit(now)).withColumn("event_date", F.to_date("event_ts"))
        rollups.write("late", late, run_id, batch_id)
        lag = None
        if stats["last_event_ts"] is not None:
            last = stats["last_event_ts"].astimezone(timezone.utc)
            lag = max((now - last).total_seconds(), 0.0)
        rollups.commit(
            run_id,
            batch_id,
            consumer_id=rollups.consumer_id,
            last_event_id=stats["last_event_id"],
            last_event_at=stats["last_event_at"],
            fetched=stats["fetched"],
            new=new,
            skipped=stats["fetched"] - new,
            lag_seconds=lag,
            updated_at=now,
            **row,
        )
    finally:
        fresh.unpersist()


def commit_stream(ingest: IngestStore, batches_per_trigger: int = 100) -> DataFrame:
    return (
        ingest.spark.readStream.schema(schemas.INGEST_COMMIT)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", batches_per_trigger)
        .parquet(f"{ingest.root}/commit")
        .where(F.col("src_run").isNotNull())
    )


def start_rollup(
    rollups: RollupStore,
    ingest: IngestStore,
    checkpoint: str,
    trigger: dict | None = None,
    batches_per_trigger: int = 100,
) -> StreamingQuery:
    """Roll up the log as it is committed. Batches whose commit rows were rolled away before this
    consumer took them are caught up first, by day ranges of the log."""
    version, rolled, _ = ingest._rolled()
    if rolled and rolled - rollups.taken():
        _by_days(rollups, ingest, f"catch-up-{version}", DAYS_AT_ONCE)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rollup_batch(rollups, ingest, batch, run_of(batch), batch_id)

    return (
        commit_stream(ingest, batches_per_trigger)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: Days of the log that a rebuild aggregates in one batch.
DAYS_AT_ONCE = 7
_PLAN, _DONE = 0, 1 << 40


def rebuild(
    rollups: RollupStore, ingest: IngestStore, run_id: str = "rebuild", days: int = DAYS_AT_ONCE
) -> None:
    """Recompute everything from the log into a consumer that has no state yet.

    One batch a range of ``days`` days, each published by its own commit row, so memory follows a
    range and a rebuild that was cut short goes on after the last committed range. The
    batches of the log it covers are fixed by its first commit row.
    """
    others = rollups.committed() - Batches({run_id: [[_PLAN, _DONE - 1]]})
    if others:
        raise ValueError("rebuild needs an empty consumer")
    _by_days(rollups, ingest, run_id, days)


def _by_days(rollups: RollupStore, ingest: IngestStore, run_id: str, days: int) -> None:
    if not rollups.is_committed(run_id, _PLAN):
        plan = ingest.committed().rows()
        rollups.commit(run_id, _PLAN, consumer_id=rollups.consumer_id, planned=plan, updated_at=datetime.now(timezone.utc))
    own = rollups.commits().where(F.col("src_run") == run_id)
    planned = Batches.of_rows(own.where(F.col("src_batch") == _PLAN).select(F.inline("planned")).collect())
    dates = ingest.commits().where(F.col("min_occurred_date").isNotNull()).select("min_occurred_date", "max_occurred_date")
    first, last = dates.agg(F.min("min_occurred_date"), F.max("max_occurred_date")).first()
    if first is not None:
        spans = {d.toordinal() // days for d in ingest.days(planned) if first <= d <= last}
        for span in sorted(spans):
            start = date.fromordinal(span * days)
            _rebuild_days(rollups, ingest, run_id, span, start, start + timedelta(days=days - 1), planned)
    if not rollups.is_committed(run_id, _DONE):
        rollups.commit(
            run_id, _DONE, consumer_id=rollups.consumer_id, taken=planned.rows(), updated_at=datetime.now(timezone.utc)
        )


def _rebuild_days(
    rollups: RollupStore, ingest: IngestStore, run_id: str, span: int, start: date, end: date, planned: Batches
) -> None:
    if rollups.is_committed(run_id, span):
        return
    log = ingest.log(start, end, planned)
    position = F.struct("occurred_at", "id")
    stats = log.agg(
        F.count("*").alias("fetched"),
        F.max_by("id", position).alias("last_event_id"),
        F.max("occurred_at").alias("last_event_at"),
        F.max_by(event_time(), position).alias("last_event_ts"),
    ).first()
    dates = {"first_date": start, "last_date": end}
    _aggregate(rollups, log, stats.asDict() | dates, run_id, span, None)


def backfill(
    rollups: RollupStore, deltas: DataFrame, run_id: str, batch_id: int, now: datetime | None = None
) -> None:
    """Add ``(merchant_id, bucket, event_type, count_delta, amount_cents)`` rows to all
    three granularities as one committed batch."""
    if rollups.is_committed(run_id, batch_id):
        return
    now = now or datetime.now(timezone.utc)
    write_cells(rollups, backfill_cells(deltas, "minute"), run_id, batch_id, now)
    confirmed = backfill_cells(deltas, "day").where(F.col("event_type") == schemas.CONFIRMED)
    volumes = confirmed.groupBy(F.date_format("bucket", "yyyy-MM").alias("period"), "merchant_id").agg(
        F.sum("amount_sum_cents").cast("bigint").alias("volume_cents"),
        F.sum("count").cast("bigint").alias("transaction_count"),
    )
    rollups.write("board", volumes, run_id, batch_id)
    rollups.commit(run_id, batch_id, consumer_id=rollups.consumer_id, updated_at=now)
