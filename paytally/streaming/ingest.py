"""Streaming ingest: validate, check merchants, claim keys, append, commit."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paytally import schemas
from paytally.functions.time import event_time, ts_lit
from paytally.operators.dedup import claim, claim_rows, responses
from paytally.operators.validate import accepted, flag_unknown_merchants, rejected, validate
from paytally.sources.store import IngestStore

TIE = "_tie"


def run_of(batch: DataFrame) -> str:
    """The streaming query's id as run id: it survives restarts of one checkpoint, and a
    new checkpoint gets a new one, so two runs never share batch numbers."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def ingest_batch(
    store: IngestStore,
    batch: DataFrame,
    merchants: DataFrame,
    run_id: str,
    batch_id: int,
    order: list[str] | None = None,
    on_missing: str = "quarantine",
    horizon_start: date | None = None,
    keep_responses: bool = False,
    now: datetime | None = None,
) -> None:
    """Ingest one batch under ``(run_id, batch_id)``; a committed batch is left alone.

    ``order`` names the columns that decide the first row of a key within the batch;
    by default the producer's time, then the row's own content, so that a retry picks
    the same row.
    """
    if store.is_committed(run_id, batch_id):
        return
    now = now or datetime.now(timezone.utc)
    if "occurred_at" not in batch.columns:
        batch = batch.withColumn("occurred_at", ts_lit(now))
    # A null arrival time would reach the day folders of the log and of the cells.
    batch = batch.withColumn("occurred_at", F.coalesce("occurred_at", ts_lit(now)))
    if order is None:
        batch = batch.withColumn(TIE, F.xxhash64(*batch.columns))
        order = ["client_timestamp", TIE]
    checked = flag_unknown_merchants(
        validate(batch, store.merchant_kind), merchants, on_missing
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        today = F.lit(now.date())
        bad = rejected(checked).withColumn("quarantined_date", today)
        if schemas.CORRUPT not in bad.columns:
            bad = bad.withColumn(schemas.CORRUPT, F.lit(None).cast("string"))
        store.write("quarantine", bad, run_id, batch_id)
        good = accepted(checked)
        ledger = store.claims(good.select("idempotency_key"), horizon_start)
        fresh = claim(good, ledger, order).withColumns(
            {
                "id": F.col("event_id"),
                "created_at": ts_lit(now),
                "occurred_date": F.to_date("occurred_at"),
            }
        )
        store.write("log", fresh, run_id, batch_id)
        # The ledger comes from the log just written: both hold the same winners.
        logged = store.read_batch("log", run_id, batch_id)
        claims = claim_rows(logged.withColumn("event_id", F.col("id")), today)
        store.write("ledger", claims, run_id, batch_id)
        if keep_responses:
            answered = responses(good, ledger, order)
            store.write("responses", answered.withColumn("received_date", today), run_id, batch_id)
        position = F.struct("occurred_at", "id")
        stats = logged.agg(
            F.count("*").alias("accepted"),
            F.max_by("id", position).alias("last_event_id"),
            F.max("occurred_at").alias("last_event_at"),
            F.max_by(event_time(), position).alias("last_event_ts"),
            F.min("occurred_date").alias("min_occurred_date"),
            F.max("occurred_date").alias("max_occurred_date"),
        ).first()
        sent = checked.agg(
            F.count("*").alias("submitted"),
            F.count_if(F.size("reject_reasons") > 0).alias("rejected"),
        ).first()
        store.commit(
            run_id,
            batch_id,
            **stats.asDict(),
            **sent.asDict(),
            duplicates=sent["submitted"] - sent["rejected"] - stats["accepted"],
            committed_at=now,
        )
    finally:
        checked.unpersist()


def start_ingest(
    store: IngestStore,
    events: DataFrame,
    merchants: DataFrame,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Ingest a stream of events. ``trigger`` defaults to one pass over what is there."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(store, batch, merchants, run_of(batch), batch_id, **options)

    return (
        events.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
