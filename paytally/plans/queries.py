"""Registered queries: each takes ``(spark, sf_dir)`` and works on whole tables.

``as_of`` values, ranges and merchants are the arguments a caller would give; they are
literals so that the results repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally.functions.measures import as_uuid
from paytally.functions.time import (
    GRAINS,
    bucket,
    event_time,
    lag_seconds,
    period_end,
    period_key,
    period_start,
    snapshot_end,
    ts_lit,
)
from paytally.operators import dedup, lag, leaderboard, metrics, reconcile, rollup, validate
from paytally.plans import nightly
from paytally.session import shared_dir
from paytally.sources import adapters, readers
from paytally.sources.store import IngestStore, RollupStore, SnapshotStore
from paytally.streaming.ingest import start_ingest
from paytally.streaming.rollup import backfill, rebuild, start_rollup

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

AS_OF = "2024-01-31 00:00:00"
ORDER = ["occurred_at", "id"]
RECONCILE_DAY = date(2024, 1, 15)


def query(fn: Query) -> Query:
    """Register ``fn``; results leave as ``timestamp_ntz``, the zone-free type SQL engines
    compare."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        columns = [
            F.col(f.name).cast("timestamp_ntz") if f.dataType == T.TimestampType() else F.col(f.name)
            for f in df.schema.fields
        ]
        return df.select(*columns)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


# Inputs


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.payments_from_events(adapters.table(spark, sf_dir, "events"))


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.payments_from_orders(adapters.table(spark, sf_dir, "orders"))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.valid_events(payments(spark, sf_dir), "long")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.registered_merchants(adapters.table(spark, sf_dir, "customer"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything ingest would log: valid, of a registered merchant, first of its key."""
    known = validate.known_merchants(valid(spark, sf_dir), registered(spark, sf_dir))
    return dedup.first_per_key(known.drop("metadata", "currency"), ORDER)


def earlier_claims(events: DataFrame) -> DataFrame:
    """The ledger after the first half of January was ingested."""
    before = events.where(F.col("occurred_at") < ts_lit("2024-01-16"))
    firsts = dedup.first_per_key(before, ORDER)
    return dedup.claim_rows(dedup.with_event_id(firsts), F.to_date("occurred_at"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cells_from_events(order_payments(spark, sf_dir), "day")


def all_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.merchants_from_customers(adapters.table(spark, sf_dir, "customer"))


# Scalars and projections


@query
def event_time_buckets(spark, sf_dir):
    """Event time, its three buckets, its period key and bounds, and its lag."""
    when = event_time()
    key = period_key(when)
    return payments(spark, sf_dir).select(
        "id",
        when.alias("event_ts"),
        bucket("minute", when).alias("minute"),
        bucket("hour", when).alias("hour"),
        bucket("day", when).alias("day"),
        key.alias("period"),
        period_start(key).alias("period_start"),
        period_end(key).alias("period_end"),
        lag_seconds(ts_lit(AS_OF), when).alias("lag_seconds"),
    )


@query
def event_ids(spark, sf_dir):
    return payments(spark, sf_dir).select(
        "id", "idempotency_key", as_uuid(F.col("idempotency_key")).alias("event_id")
    )


# Validation and merchants


@query
def validate_accept(spark, sf_dir):
    accepted = validate.accepted(validate.validate(payments(spark, sf_dir), "long"))
    return accepted.select(
        "id", "merchant_id", "event_type", "amount_cents", "currency", "idempotency_key",
        "client_timestamp", "metadata",
    )


@query
def validate_reject_reasons(spark, sf_dir):
    """Customers' opening balances as producer input: every reason occurs."""
    feed = adapters.producer_feed_from_customers(adapters.table(spark, sf_dir, "customer"))
    checked = validate.validate(feed.withColumn("sent_merchant", F.col("merchant_id")), "uuid")
    return checked.select(
        "sent_merchant",
        "event_type",
        "amount_cents",
        "idempotency_key",
        "currency",
        "merchant_id",
        F.array_join("reject_reasons", ",").alias("reject_reasons"),
    )


@query
def validate_merchant_check(spark, sf_dir):
    """Rejected rows of the event feed, unknown merchants included."""
    checked = validate.validate(payments(spark, sf_dir), "long")
    flagged = validate.flag_unknown_merchants(checked, registered(spark, sf_dir))
    return validate.rejected(flagged).select(
        "id", "merchant_id", F.array_join("reject_reasons", ",").alias("reject_reasons")
    )


@query
def missing_merchants(spark, sf_dir):
    return validate.missing_merchants(valid(spark, sf_dir), registered(spark, sf_dir))


@query
def known_merchant_events(spark, sf_dir):
    known = validate.known_merchants(valid(spark, sf_dir), registered(spark, sf_dir))
    return known.select("id", "merchant_id", "event_type", "amount_cents")


@query
def json_source(spark, sf_dir):
    """The event feed written as JSON lines, those of views cut off, and read back."""
    rows = payments(spark, sf_dir)
    line = F.to_json(
        F.struct(
            "event_type",
            F.col("merchant_id").cast("string").alias("merchant_id"),
            "amount_cents",
            "currency",
            "idempotency_key",
            "client_timestamp",
        ),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )
    cut = F.when(F.col("event_type") == "VIEW", F.expr("left(line, length(line) - 1)"))
    path = shared_dir(spark, "producer-json")
    lines = rows.select("event_type", line.alias("line"))
    lines.select(F.coalesce(cut, F.col("line")).alias("value")).write.text(path)
    back = readers.read_producer_json(spark, path)
    return (
        back.withColumn("corrupt", F.col(readers.CORRUPT).isNotNull())
        .groupBy("corrupt", "event_type", "currency")
        .agg(
            F.count("*").alias("lines"),
            F.sum("amount_cents").alias("amount_cents"),
            F.min("client_timestamp").alias("first_at"),
            F.max("client_timestamp").alias("last_at"),
        )
    )


# Deduplication. The whole feed is sent while its first half is already in the ledger.


@query
def dedup_first_per_key(spark, sf_dir):
    return dedup.first_per_key(valid(spark, sf_dir), ORDER).select(
        "id", "idempotency_key", "merchant_id", "event_type", "amount_cents", "occurred_at"
    )


@query
def dedup_accepted(spark, sf_dir):
    events = valid(spark, sf_dir)
    return dedup.claim(events, earlier_claims(events), ORDER).select(
        "id", "event_id", "idempotency_key", "merchant_id", "event_type", "amount_cents",
        "occurred_at",
    )


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = valid(spark, sf_dir)
    slim = events.select("id", "idempotency_key", "event_type", "occurred_at")
    return dedup.responses(slim, earlier_claims(events), ORDER)


@query
def dedup_response(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "id", "idempotency_key", "event_id", "occurred_at", "duplicate"
    )


@query
def ingest_summary(spark, sf_dir):
    return dedup.batch_summary(_answers(spark, sf_dir))


@query
def ingest_by_type(spark, sf_dir):
    return dedup.counts_by_type(_answers(spark, sf_dir))


@query
def existing_events(spark, sf_dir):
    """Logged originals of the keys that failed payments were sent with."""
    events = valid(spark, sf_dir)
    log = dedup.first_per_key(events, ORDER)
    keys = events.where(F.col("event_type") == "PAYMENT_FAILED")
    return dedup.existing_events(keys, log).select("idempotency_key", "id", "occurred_at")


# Rollups


@query
def rollup_minute(spark, sf_dir):
    return rollup.cells_from_events(accepted(spark, sf_dir), "minute")


@query
def rollup_hour(spark, sf_dir):
    return rollup.cells_from_events(accepted(spark, sf_dir), "hour")


@query
def rollup_day(spark, sf_dir):
    return rollup.cells_from_events(accepted(spark, sf_dir), "day")


@query
def rollup_merge(spark, sf_dir):
    """Stored cells of events that arrived by mid-January plus the deltas since."""
    events = valid(spark, sf_dir)
    middle = ts_lit("2024-01-16 12:30")
    stored = rollup.cells_from_events(events.where(F.col("occurred_at") < middle), "day")
    deltas = rollup.cells_from_events(events.where(F.col("occurred_at") >= middle), "day")
    return rollup.merge_cells(stored, deltas)


@query
def rollup_chain_day(spark, sf_dir):
    return rollup.rollup_chain(valid(spark, sf_dir))["day"]


@query
def rollup_backfill(spark, sf_dir):
    """Orders added to the event rollup as single-event backfill deltas."""
    deltas = order_payments(spark, sf_dir).select(
        "merchant_id",
        F.col("occurred_at").alias("bucket"),
        "event_type",
        F.lit(1).cast("bigint").alias("count_delta"),
        "amount_cents",
    )
    stored = rollup.cells_from_events(valid(spark, sf_dir), "hour")
    return rollup.merge_cells(stored, rollup.backfill_cells(deltas, "hour"))


@query
def raw_metrics_24h(spark, sf_dir):
    return rollup.raw_totals(valid(spark, sf_dir), ts_lit("2024-01-15"), ts_lit("2024-01-16"))


@query
def events_per_day(spark, sf_dir):
    return rollup.events_per_day(payments(spark, sf_dir))


@query
def leaderboard_increments(spark, sf_dir):
    return rollup.board_increments(accepted(spark, sf_dir))


# Metric reads


def _cells(events: DataFrame) -> dict[str, DataFrame]:
    return {g: rollup.cells_from_events(events, g) for g in GRAINS}


def _range(start: str, end: str) -> tuple[datetime, datetime]:
    return metrics.check_range(start, end)


@query
def metrics_minute(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "minute")
    return metrics.range_buckets(cells, *_range("2024-01-10 12:00", "2024-01-10 15:00"))


@query
def metrics_hour(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "hour")
    return metrics.range_buckets(cells, *_range("2024-01-08", "2024-01-15"))


@query
def metrics_day(spark, sf_dir):
    return metrics.range_buckets(
        order_days(spark, sf_dir), *_range("1997-01-01", "1997-12-31")
    )


@query
def metrics_hour_one_merchant(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "hour")
    return metrics.range_buckets(cells, *_range("2024-01-08", "2024-01-15"), merchant_id=42)


@query
def metrics_totals(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "hour")
    chosen = metrics.in_range(cells, *_range("2024-01-08", "2024-01-15"))
    return rollup.totals(rollup.per_bucket(chosen, "merchant_id"), "merchant_id")


@query
def success_rate(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "hour")
    return metrics.success_rates(cells, *_range("2024-01-01", "2024-01-31"))


def _flat(record: DataFrame) -> DataFrame:
    """The nested points as text, for engines that compare scalar columns."""
    points = F.transform(
        "data",
        lambda p: F.concat_ws(
            "|", F.date_format(p["bucket"], "yyyy-MM-dd HH:mm"), p["volume_cents"], p["count"]
        ),
    )
    return record.withColumn("data", F.array_join(points, ";"))


@query
def merchant_metrics(spark, sf_dir):
    """The combined record of every merchant for a week: hour granularity."""
    cells = _cells(valid(spark, sf_dir))
    return _flat(metrics.merchant_metrics(cells, "2024-01-08", "2024-01-15"))


@query
def merchant_metrics_one(spark, sf_dir):
    cells = _cells(valid(spark, sf_dir))
    return _flat(metrics.merchant_metrics(cells, "2024-01-08", "2024-01-15", merchant_id=42))


@query
def merchant_metrics_year(spark, sf_dir):
    """Over 30 days the day table answers."""
    cells = _cells(order_payments(spark, sf_dir))
    return _flat(metrics.merchant_metrics(cells, "1997-01-01", "1997-12-31"))


@query
def metrics_requests_join(spark, sf_dir):
    """One request per failed payment: how the merchant did before it. The span depends
    on the amount, so that all three granularities and both errors occur."""
    events = valid(spark, sf_dir)
    value = F.col("amount_cents")
    start = (
        F.when(value < 1000, F.expr("occurred_at - INTERVAL 2 HOURS"))
        .when(value < 5000, F.expr("occurred_at - INTERVAL 5 DAYS"))
        .when(value < 15000, F.expr("occurred_at - INTERVAL 40 DAYS"))
        .when(value < 20000, F.col("occurred_at"))
        .otherwise(F.expr("occurred_at - INTERVAL 400 DAYS"))
    )
    requests = events.where(F.col("event_type") == "PAYMENT_FAILED").select(
        F.col("id").alias("request_id"),
        "merchant_id",
        start.alias("start"),
        F.col("occurred_at").alias("end"),
    )
    return metrics.answer_requests(requests, rollup.rollup_chain(events))


@query
def sparkline(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "minute")
    return metrics.sparkline(cells, "2024-01-20 12:00", 1440)


@query
def sparkline_one_merchant(spark, sf_dir):
    cells = rollup.cells_from_events(valid(spark, sf_dir), "minute")
    return metrics.sparkline(cells, "2024-01-20 12:00", 1440, merchant_id=42)


# Leaderboards


def _board(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query
def leaderboard_month(spark, sf_dir):
    return _board(leaderboard.leaderboard(order_days(spark, sf_dir), "1997-03", 10))


@query
def leaderboard_december(spark, sf_dir):
    return _board(leaderboard.leaderboard(order_days(spark, sf_dir), "1998-12", 100))


@query
def leaderboard_materialised(spark, sf_dir):
    board = rollup.board_increments(order_payments(spark, sf_dir))
    return _board(leaderboard.leaderboard_from_board(board, "1997-03", 10))


@query
def leaderboard_snapshot(spark, sf_dir):
    """Every daily snapshot of January."""
    days = rollup.cells_from_events(accepted(spark, sf_dir), "day")
    return _board(leaderboard.snapshots(days, "daily", ts_lit(AS_OF)))


@query
def leaderboard_snapshot_weekly(spark, sf_dir):
    days = rollup.cells_from_events(accepted(spark, sf_dir), "day")
    return _board(leaderboard.snapshots(days, "weekly", ts_lit(AS_OF)))


@query
def leaderboard_snapshot_monthly(spark, sf_dir):
    return _board(leaderboard.snapshots(order_days(spark, sf_dir), "monthly", ts_lit(AS_OF)))


@query
def leaderboard_history(spark, sf_dir):
    """The newest twelve monthly snapshots with merchant names; households have none."""
    stored = leaderboard.snapshots(order_days(spark, sf_dir), "monthly", ts_lit(AS_OF))
    return _history(stored, registered(spark, sf_dir))


def _history(stored: DataFrame, merchants: DataFrame) -> DataFrame:
    history = leaderboard.snapshot_history(stored, merchants, "monthly", 12)
    entries = F.transform(
        "entries",
        lambda e: F.concat_ws(
            "|", e["rank"], e["merchant_id"], F.coalesce(e["merchant_name"], F.lit("-")), e["volume_cents"]
        ),
    )
    return history.withColumn("entries", F.array_join(entries, ";"))


@query
def snapshot_bounds(spark, sf_dir):
    """Start and end of the three kinds of snapshot period, per day of the orders."""
    day = F.to_date("occurred_at")
    kinds = F.explode(F.array(*[F.lit(p) for p in leaderboard.schemas.PERIODS])).alias("period")
    days = order_payments(spark, sf_dir).select(day.alias("day")).distinct().select("day", kinds)
    return days.select("day", "period", snapshot_end(F.col("period"), F.col("day")).alias("period_end"))


# Reports


@query
def recent_events(spark, sf_dir):
    return lag.recent_events(payments(spark, sf_dir)).select(
        "id", "merchant_id", "event_type", "amount_cents", "occurred_at"
    )


@query
def events_page(spark, sf_dir):
    """One page of the log after a cursor, in arrival order."""
    log = payments(spark, sf_dir).withColumn("created_at", F.col("occurred_at"))
    return lag.events_after(log, ("2024-01-12 08:00", 0), 1000).select("id", "created_at", "merchant_id")


@query
def late_events(spark, sf_dir):
    """Events that were over 50 minutes old when an hourly worker got to them."""
    processed = F.date_trunc("hour", F.col("occurred_at")) + F.expr("INTERVAL 1 HOUR")
    return lag.late_events(payments(spark, sf_dir), processed, 3000)


@query
def lag_histogram(spark, sf_dir):
    """Lags of events processed at the next full minute, one worker per event type."""
    processed = F.date_trunc("minute", F.col("occurred_at")) + F.expr("INTERVAL 1 MINUTE")
    lags = payments(spark, sf_dir).select(
        F.col("event_type").alias("worker_id"),
        F.floor(lag_seconds(processed, event_time())).cast("double").alias("lag_seconds"),
    )
    return lag.lag_histogram(lags)


@query
def batch_lag(spark, sf_dir):
    """Fetched events and reported lag of hourly batches."""
    events = payments(spark, sf_dir).withColumn("batch", F.date_trunc("hour", "occurred_at"))
    return lag.batch_lag(events, F.col("batch") + F.expr("INTERVAL 1 HOUR"), "batch")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily batches of every event type as if each type were a consumer."""
    events = payments(spark, sf_dir)
    commits = events.groupBy(
        F.col("event_type").alias("consumer_id"), F.to_date("occurred_at").alias("day")
    ).agg(
        F.max_by("id", F.struct("occurred_at", "id")).alias("last_event_id"),
        F.max("occurred_at").alias("last_event_at"),
        F.max("occurred_at").alias("updated_at"),
        F.dayofmonth(F.max("occurred_at")).cast("bigint").alias("src_batch"),
    )
    return lag.consumer_positions(commits)


@query
def consumer_positions(spark, sf_dir):
    return _positions(spark, sf_dir)


@query
def pipeline_lag(spark, sf_dir):
    """Status per consumer. Market segments never consumed, so they are unknown."""
    types = payments(spark, sf_dir).select(F.col("event_type").alias("consumer_id"))
    segments = adapters.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("consumer_id")
    )
    consumers = types.distinct().unionByName(segments.distinct())
    return lag.pipeline_lag(_positions(spark, sf_dir), consumers, "2024-01-30 23:55")


@query
def ingestion_rate(spark, sf_dir):
    return lag.ingestion_rate(payments(spark, sf_dir))


# Reconciliation and compaction


def _two_histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Day cells that counted repeats and hour cells that did not."""
    events = valid(spark, sf_dir)
    days = rollup.cells_from_events(events, "day")
    return days, rollup.cells_from_events(dedup.first_per_key(events, ORDER), "hour")


@query
def day_hour_discrepancy(spark, sf_dir):
    return reconcile.discrepancies(*_two_histories(spark, sf_dir), RECONCILE_DAY)


@query
def compact_day(spark, sf_dir):
    return reconcile.day_from_hours(_two_histories(spark, sf_dir)[1], RECONCILE_DAY)


# Streams, run over what the source holds and read back from their tables


#: Micro-batches of the queries that let events arrive piece by piece.
PIECES = 4
#: Rows of an arriving file. One task reads a file's row group, and small files are dealt evenly to tasks.
FILE_ROWS = 100_000


def run_ingest(
    spark: SparkSession, sf_dir: str, root: str, pieces: int = 1,
    between: Callable[[IngestStore, int], None] | None = None, **options,
) -> IngestStore:
    """Ingest the events, in one pass or as so many files that arrive one after another and are each a micro-batch
    of one checkpoint. ``between`` runs after each."""
    store = IngestStore(spark, f"{root}/ingest", "long")
    options = {"order": ORDER} | options

    def ingest(events: DataFrame) -> None:
        stream = adapters.payments_from_events(events)
        start_ingest(store, stream, registered(spark, sf_dir), f"{root}/checkpoint-ingest", **options).awaitTermination()

    if pieces == 1:
        ingest(adapters.events_stream(spark, sf_dir))
        return store
    for number, piece in enumerate(adapters.in_time_order(adapters.table(spark, sf_dir, "events"), pieces)):
        piece.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{root}/inbox/{number:04}")
        ingest(adapters.events_inbox(spark, f"{root}/inbox"))
        if between:
            between(store, number)
    return store


def run_rollup(
    spark: SparkSession, ingest: IngestStore, root: str, run: str, batches_per_trigger: int = 100
) -> RollupStore:
    store = RollupStore(spark, f"{root}/rollups", "long")
    start_rollup(
        store, ingest, f"{root}/checkpoint-{run}", batches_per_trigger=batches_per_trigger
    ).awaitTermination()
    return store


def _fold_ledger(store: IngestStore, number: int) -> None:
    """A base and batches not folded yet, so that keys are looked up in both."""
    if number == 1:
        store.fold("ledger")
        store.fold("log")


def _cells_only(cells: DataFrame) -> DataFrame:
    return cells.select(*rollup.CELL, *rollup.MEASURES)


@query
def stream_ingest_log(spark, sf_dir):
    root = shared_dir(spark, "stream-ingest")
    return run_ingest(spark, sf_dir, root, PIECES, _fold_ledger).log().select(
        F.col("id").alias("event_id"), "merchant_id", "event_type", "amount_cents", "currency",
        "idempotency_key", "occurred_at", "client_timestamp", "occurred_date",
    )


@query
def stream_ingest_responses(spark, sf_dir):
    root = shared_dir(spark, "stream-responses")
    store = run_ingest(spark, sf_dir, root, PIECES, _fold_ledger, keep_responses=True)
    return store.read("responses").groupBy("idempotency_key", "event_id").agg(
        F.count_if("duplicate").alias("duplicates"),
        F.count("*").alias("submitted"),
        F.min("occurred_at").alias("occurred_at"),
    )


@query
def stream_quarantine(spark, sf_dir):
    root = shared_dir(spark, "stream-quarantine")
    rows = run_ingest(spark, sf_dir, root, PIECES).read("quarantine")
    return rows.groupBy(
        F.array_join("reject_reasons", ",").alias("reject_reasons"),
        "event_type",
        F.col("merchant_id").cast("bigint").alias("merchant_id"),
    ).agg(F.count("*").alias("rows"), F.sum("amount_cents").alias("amount_cents"))


@query
def stream_rollup_hour(spark, sf_dir):
    """Events and rollup take turns on their checkpoints. Halfway the commit rows taken so far
    are rolled away and the hours folded."""
    root = shared_dir(spark, "stream-rollup")

    def rolled_up(ingest: IngestStore, number: int) -> None:
        store = run_rollup(spark, ingest, root, "first", 1)
        if number == 1:
            ingest.roll_commits([store.taken()])
            store.fold("hour")
            store.roll_commits()

    run_ingest(spark, sf_dir, root, PIECES, rolled_up)
    return _cells_only(RollupStore(spark, f"{root}/rollups", "long").cells("hour"))


@query
def replay_rollup(spark, sf_dir):
    """The same log rolled up by two runs, several micro-batches each: the second finds every event marked."""
    root = shared_dir(spark, "replay-rollup")
    ingest = run_ingest(spark, sf_dir, root, PIECES)
    run_rollup(spark, ingest, root, "first", 1)
    return _cells_only(run_rollup(spark, ingest, root, "second", 2).cells("day"))


@query
def replay_batch_stats(spark, sf_dir):
    """Fetched, new and skipped events of both runs, over the commit rows of their micro-batches."""
    root = shared_dir(spark, "replay-stats")
    ingest = run_ingest(spark, sf_dir, root, PIECES)
    run_rollup(spark, ingest, root, "first", 1)
    store = run_rollup(spark, ingest, root, "second", 1)
    newest = F.struct("last_event_at", "last_event_id")
    runs = store.commits().groupBy("src_run", "consumer_id").agg(
        *(F.sum(c).alias(c) for c in ("fetched", "new", "skipped")),
        F.max_by("last_event_id", newest).alias("last_event_id"),
        F.max("last_event_at").alias("last_event_at"),
    )
    return runs.drop("src_run")


@query
def rebuild_minute(spark, sf_dir):
    root = shared_dir(spark, "rebuild")
    store = RollupStore(spark, f"{root}/rollups", "long", "rebuilt")
    rebuild(store, run_ingest(spark, sf_dir, root))
    return _cells_only(store.cells("minute"))


@query
def fold_and_backfill(spark, sf_dir):
    """Rollups folded into a base, then the events of merchants that were not registered
    backfilled on top, read merged."""
    root = shared_dir(spark, "fold")
    store = run_rollup(spark, run_ingest(spark, sf_dir, root), root, "first")
    store.fold("day")
    events = valid(spark, sf_dir)
    absent = validate.missing_merchants(events, registered(spark, sf_dir))
    deltas = events.join(absent, "merchant_id", "left_semi").select(
        "merchant_id",
        event_time().alias("bucket"),
        "event_type",
        F.lit(1).cast("bigint").alias("count_delta"),
        "amount_cents",
    )
    backfill(store, deltas, "backfill", 0)
    return _cells_only(store.cells("day"))


@query
def nightly_snapshots(spark, sf_dir):
    """The nightly job for one date: day replaced from hours, then the daily board."""
    root = shared_dir(spark, "nightly")
    store = run_rollup(spark, run_ingest(spark, sf_dir, root), root, "first")
    snaps = SnapshotStore(spark, root, "long")
    at = datetime(2024, 1, 16, 0, 5, tzinfo=timezone.utc)
    nightly.compact_day(store, RECONCILE_DAY, at)
    return _board(nightly.take_snapshot(store, snaps, RECONCILE_DAY, "daily", at))


@query
def served_leaderboard(spark, sf_dir):
    """The month's board from the table the rollup stream maintains."""
    root = shared_dir(spark, "served")
    store = run_rollup(spark, run_ingest(spark, sf_dir, root), root, "first")
    return _board(nightly.serve_leaderboard(store, "2024-01", 10))


@query
def retained_minutes(spark, sf_dir):
    """Minute cells left after dropping the days before the 20th."""
    root = shared_dir(spark, "retention")
    store = run_rollup(spark, run_ingest(spark, sf_dir, root), root, "first")
    nightly.drop_before(store, "minute", date(2024, 1, 20))
    store.vacuum()
    return _cells_only(store.cells("minute"))


@query
def stream_dedup_horizon(spark, sf_dir):
    """Keys that pass the bounded-horizon streaming dedup."""
    root = shared_dir(spark, "stream-dedup")
    stream = adapters.payments_from_events(adapters.events_stream(spark, sf_dir))
    passed = dedup.stream_first_per_key(stream, "60 days").select("idempotency_key", "event_type")
    (
        passed.writeStream.format("parquet")
        .option("path", f"{root}/passed")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("idempotency_key string, event_type string").parquet(f"{root}/passed")


# Reads of stored tables: a base of folded batches with later batches on top


def _half_folded(spark: SparkSession, sf_dir: str, root: str, *names: str) -> RollupStore:
    def rolled_up(ingest: IngestStore, number: int) -> None:
        store = run_rollup(spark, ingest, root, "first")
        if number == 0:
            for name in names:
                store.fold(name)

    run_ingest(spark, sf_dir, root, 2, rolled_up)
    return RollupStore(spark, f"{root}/rollups", "long")


@query
def stored_metrics(spark, sf_dir):
    """The combined record of every merchant for a week, from the stored hours of these days only."""
    store = _half_folded(spark, sf_dir, shared_dir(spark, "stored-metrics"), "hour")
    return _flat(nightly.metrics_from_store(store, "2024-01-08", "2024-01-15"))


@query
def stored_sparkline(spark, sf_dir):
    store = _half_folded(spark, sf_dir, shared_dir(spark, "stored-sparkline"), "minute")
    return nightly.sparkline_from_store(store, datetime(2024, 1, 20, 12, tzinfo=timezone.utc), 1440)


@query
def stored_late_events(spark, sf_dir):
    """The late table: a worker that runs long after the events finds all of them late."""
    store = _half_folded(spark, sf_dir, shared_dir(spark, "stored-late"), "late")
    return store.read("late").select("event_id", "merchant_id", "event_ts", "client_delay_s")


@query
def consumer_status(spark, sf_dir):
    """Position and status of a consumer that ran and of one that never did, from their commit rows."""
    root = shared_dir(spark, "consumer-status")
    store = _half_folded(spark, sf_dir, root)
    store.roll_commits()
    idle = RollupStore(spark, f"{root}/rollups", "long", "idle")
    return nightly.consumer_status([store, idle], datetime(2024, 1, 31, tzinfo=timezone.utc))


@query
def stored_recent_events(spark, sf_dir):
    """The newest events of the log, from the newest days' folders that hold as many."""
    store = run_ingest(spark, sf_dir, shared_dir(spark, "stored-recent"))
    store.fold("log")
    return store.recent(20).select(
        F.col("id").alias("event_id"), "merchant_id", "event_type", "amount_cents", "occurred_at"
    )


@query
def stored_history(spark, sf_dir):
    """The newest twelve monthly snapshots, published twice, read through their pointers."""
    store = SnapshotStore(spark, shared_dir(spark, "stored-history"), "long")
    snapshots = leaderboard.snapshots(order_days(spark, sf_dir), "monthly", ts_lit(AS_OF))
    store.write_all(snapshots.where("rank <= 3"))
    store.write_all(snapshots)
    return _history(store.read("monthly", 12), registered(spark, sf_dir))


@query
def merchants_source(spark, sf_dir):
    """Events of the merchants that a stored dimension lists, read with its declared schema."""
    path = shared_dir(spark, "merchants")
    registered(spark, sf_dir).write.parquet(path)
    known = validate.known_merchants(valid(spark, sf_dir), readers.read_merchants(spark, path, "long"))
    return known.groupBy("merchant_id").agg(F.count("*").alias("events"))


@query
def stamped_ingest(spark, sf_dir):
    """A stream without arrival times is stamped once a batch: events and stamps of the log, per currency."""
    root = shared_dir(spark, "stamped-ingest")
    store = IngestStore(spark, f"{root}/ingest", "long")
    stream = adapters.payments_from_events(adapters.events_stream(spark, sf_dir))
    stream = stream.withColumn("client_timestamp", event_time()).drop("occurred_at")
    start_ingest(
        store, stream, registered(spark, sf_dir), f"{root}/checkpoint", order=["client_timestamp", "id"]
    ).awaitTermination()
    return store.log().groupBy("event_type").agg(
        F.count("*").alias("events"), F.countDistinct("occurred_at").alias("stamps")
    )
