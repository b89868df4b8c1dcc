"""Nightly compaction, snapshots, leaderboard service and retention over the stores."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions.time import cell_parts, month_bounds, ts_lit, utc
from paytally.operators.lag import consumer_positions, pipeline_lag
from paytally.operators.leaderboard import (
    confirmed_volumes,
    leaderboard_from_board,
    period_range,
    snapshots,
)
from paytally.operators.metrics import check_range, choose_grain, merchant_metrics, sparkline
from paytally.operators.reconcile import day_from_hours, discrepancies
from paytally.sources.store import BatchStore, RollupStore, SnapshotStore


def metrics_from_store(rollups: RollupStore, start, end, merchant_id=None) -> DataFrame:
    """``merchant_metrics`` reading only the routed table, the hours, and their days."""
    start_at, end_at = check_range(start, end)
    needed = {choose_grain(start_at, end_at), "hour"}
    cells = {g: rollups.cells(g, start_at.date(), end_at.date()) for g in needed}
    return merchant_metrics(cells, start_at, end_at, merchant_id)


def sparkline_from_store(
    rollups: RollupStore, as_of: datetime, window_minutes: int = 60, merchant_id=None
) -> DataFrame:
    until = utc(as_of)
    since = until - timedelta(minutes=window_minutes)
    cells = rollups.cells("minute", since.date(), until.date())
    return sparkline(cells, until, window_minutes, merchant_id)


def consumer_status(stores: list[RollupStore], as_of: datetime) -> DataFrame:
    """Position and lag status of consumers; one that never ran is ``unknown``."""
    commits = reduce(DataFrame.unionByName, [s.commits() for s in stores])
    names = stores[0].spark.createDataFrame([(s.consumer_id,) for s in stores], "consumer_id string")
    return pipeline_lag(consumer_positions(commits), names, as_of)


def serve_leaderboard(
    rollups: RollupStore, period: str, n: int = schemas.DEFAULT_TOP_N
) -> DataFrame:
    """The materialised board; a missing month is computed from the day rollup and not
    stored, so that reading never writes. ``rebuild_board`` stores it."""
    board = rollups.read("board", period, period)
    if not board.isEmpty():
        return leaderboard_from_board(board, period, n)
    computed = leaderboard_from_board(_board_rows(rollups, period), period, n)
    return computed.withColumn("source", F.lit("rollup_day"))


def _board_rows(rollups: RollupStore, period: str, committed=None) -> DataFrame:
    start, end = month_bounds(period)
    days = rollups.cells("day", start.date(), (end - timedelta(days=1)).date(), committed)
    return confirmed_volumes(days, start, end).withColumn("period", F.lit(period))


def rebuild_board(rollups: RollupStore, period: str) -> None:
    """Store a month's board anew from the day rollup of the batches committed so far."""
    committed = rollups.committed()
    rows = _board_rows(rollups, period, committed)
    rollups.fold("board", replacement=rows, parts=[period], committed=committed)


def compact_day(rollups: RollupStore, day: date, now: datetime | None = None) -> DataFrame:
    """Replace a date's day cells by the sums of its hours. Returns the discrepancies as
    they were before, at most ten rows, already computed."""
    now = now or datetime.now(timezone.utc)
    committed = rollups.committed()  # a batch committed from here on stays pending in the day table
    hours = rollups.cells("hour", day, day, committed)
    key = f"{day:%Y-%m}"
    month = rollups.read("day", key, key, committed)
    found = discrepancies(month, hours, day)
    before = rollups.spark.createDataFrame(found.collect(), found.schema)
    canonical = cell_parts(day_from_hours(hours.drop("updated_at"), day))
    others = month.where(F.to_date("bucket") != F.lit(day))
    replaced = canonical.withColumn("updated_at", ts_lit(now)).select(*others.columns)
    rollups.fold("day", others.unionByName(replaced), [key], committed=committed)
    return before


def take_snapshot(
    rollups: RollupStore,
    store: SnapshotStore,
    day: date,
    period: str = "daily",
    now: datetime | None = None,
) -> DataFrame:
    """Snapshot the period that holds ``day``."""
    start, end = period_range(period, day)
    cells = rollups.cells("day", start, end - timedelta(days=1))
    at = ts_lit(now or datetime.now(timezone.utc))
    store.write(snapshots(cells, period, at), period, start)
    return store.read().where((F.col("period") == period) & (F.col("period_start") == F.lit(start)))


def run_compaction(
    rollups: RollupStore,
    store: SnapshotStore,
    day: date | None = None,
    periods: tuple[str, ...] = ("daily",),
) -> DataFrame:
    """The nightly job for a date (default yesterday, UTC): reconcile, replace, snapshot."""
    day = day or (datetime.now(timezone.utc) - timedelta(days=1)).date()
    found = compact_day(rollups, day)
    for period in periods:
        take_snapshot(rollups, store, day, period)
    return found


def compact_tables(store: BatchStore, names: list[str]) -> None:
    for name in names:
        store.fold(name)


def drop_before(store: BatchStore, name: str, cutoff: date) -> None:
    """Retention: drop the parts of a table before ``cutoff``. For ``ledger`` this bounds
    the idempotency horizon: a pruned key can be claimed again."""
    store.fold(name, drop_before=cutoff)
