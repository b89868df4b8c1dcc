"""Declared schemas. Nothing is inferred; streaming sources need them anyway."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
EVENT_TYPES = ("PAYMENT_INITIATED", "PAYMENT_CONFIRMED", "PAYMENT_FAILED")
CONFIRMED = "PAYMENT_CONFIRMED"
FAILED = "PAYMENT_FAILED"
PERIODS = ("daily", "weekly", "monthly")
DEFAULT_CURRENCY = "EUR"
MAX_AMOUNT = 2147483647
MAX_KEY_LENGTH = 255
LATE_THRESHOLD_S = 60
LAG_THRESHOLD_S = 30
LAG_BOUNDS_S = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, float("inf"))
DEFAULT_TOP_N = 10
MAX_TOP_N = 100
SNAPSHOT_TOP_N = 100
DEFAULT_PAGE = 1000
DEFAULT_CONSUMER = "cells-main"
# Where the JSON reader leaves the text of a line it could not parse in full.
CORRUPT = "_corrupt_record"

MERCHANT_TYPES = {"uuid": T.StringType(), "long": T.LongType()}


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


S, L, TS, D = T.StringType(), T.LongType(), T.TimestampType(), T.DateType()

PRODUCER_EVENT = _fields(
    ("event_type", S),
    ("merchant_id", S),
    ("amount_cents", L),
    ("currency", S),
    ("idempotency_key", S),
    ("client_timestamp", TS),
    ("metadata", S),
)


def merchants(kind: str) -> T.StructType:
    return _fields(("merchant_id", MERCHANT_TYPES[kind]), ("name", S), ("created_at", TS))


def event_log(kind: str) -> T.StructType:
    return _fields(
        ("id", S),
        ("merchant_id", MERCHANT_TYPES[kind]),
        ("event_type", S),
        ("amount_cents", L),
        ("currency", S),
        ("idempotency_key", S),
        ("occurred_at", TS),
        ("client_timestamp", TS),
        ("metadata", S),
        ("created_at", TS),
        ("occurred_date", D),
    )


def quarantine(kind: str) -> T.StructType:
    return _fields(
        ("event_type", S),
        ("merchant_id", S),
        ("amount_cents", L),
        ("currency", S),
        ("idempotency_key", S),
        ("client_timestamp", TS),
        ("metadata", S),
        ("reject_reasons", T.ArrayType(S)),
        (CORRUPT, S),
        ("quarantined_date", D),
    )


LEDGER = _fields(
    ("idempotency_key", S),
    ("event_id", S),
    ("occurred_at", TS),
    ("created_date", D),
    ("key_part", S),
)

RESPONSES = _fields(
    ("idempotency_key", S),
    ("event_id", S),
    ("occurred_at", TS),
    ("duplicate", T.BooleanType()),
    ("received_date", D),
)

INGEST_COMMIT = _fields(
    ("src_run", S),
    ("src_batch", L),
    ("submitted", L),
    ("accepted", L),
    ("duplicates", L),
    ("rejected", L),
    ("last_event_id", S),
    ("last_event_at", TS),
    ("last_event_ts", TS),
    ("min_occurred_date", D),
    ("max_occurred_date", D),
    ("committed_at", TS),
)

RANGE = _fields(("run_id", S), ("first", L), ("last", L))

ROLLUP_COMMIT = _fields(
    ("src_run", S),
    ("src_batch", L),
    ("consumer_id", S),
    ("last_event_id", S),
    ("last_event_at", TS),
    ("fetched", L),
    ("new", L),
    ("skipped", L),
    ("lag_seconds", T.DoubleType()),
    ("updated_at", TS),
    # Batches of the log that this commit aggregates, and those a rebuild sets out to.
    ("taken", T.ArrayType(RANGE)),
    ("planned", T.ArrayType(RANGE)),
)

MARKER = _fields(("event_id", S), ("processed_at", TS), ("occurred_date", D))


# Day cells are few: a folder per month keeps their files large. Minutes and hours get
# a folder per day.
CELL_PART = {"minute": "bucket_date", "hour": "bucket_date", "day": "bucket_month"}


def cells(kind: str, grain: str) -> T.StructType:
    part = CELL_PART[grain]
    return _fields(
        ("merchant_id", MERCHANT_TYPES[kind]),
        ("bucket", TS),
        ("event_type", S),
        ("count", L),
        ("amount_sum_cents", L),
        ("amount_min_cents", L),
        ("amount_max_cents", L),
        ("updated_at", TS),
        (part, D if part == "bucket_date" else S),
    )


def board(kind: str) -> T.StructType:
    return _fields(
        ("merchant_id", MERCHANT_TYPES[kind]),
        ("volume_cents", L),
        ("transaction_count", L),
        ("period", S),
    )


def late_events(kind: str) -> T.StructType:
    return _fields(
        ("event_id", S),
        ("merchant_id", MERCHANT_TYPES[kind]),
        ("event_ts", TS),
        ("lag_seconds", T.DoubleType()),
        ("client_delay_s", T.DoubleType()),
        ("event_date", D),
    )


def snapshots(kind: str) -> T.StructType:
    return _fields(
        ("id", S),
        ("merchant_id", MERCHANT_TYPES[kind]),
        ("rank", T.IntegerType()),
        ("amount_sum_cents", L),
        ("created_at", TS),
        ("period", S),
        ("period_start", D),
    )
