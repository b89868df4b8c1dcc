"""Time expressions: event time, buckets, periods, lag. All under a UTC session."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("minute", "hour", "day")


def event_time() -> Column:
    """Producer time when given, else the server's arrival time."""
    return F.coalesce(F.col("client_timestamp"), F.col("occurred_at"))


def bucket(grain: str, ts: Column) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"unknown granularity {grain!r}")
    return F.date_trunc(grain, ts)


def period_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def period_start(key: Column) -> Column:
    return F.to_date(F.concat(key, F.lit("-01"))).cast("timestamp")


def period_end(key: Column) -> Column:
    return F.add_months(F.to_date(F.concat(key, F.lit("-01"))), 1).cast("timestamp")


def cell_parts(cells: DataFrame) -> DataFrame:
    """Both partition columns of stored cells."""
    return cells.withColumns(
        {"bucket_date": F.to_date("bucket"), "bucket_month": period_key(F.col("bucket"))}
    )


def within_days(cells: DataFrame, first: date, last: date) -> DataFrame:
    """Prune the folders of stored cells to the days ``first..last``. A condition on
    ``bucket`` alone would not reach the partition columns derived from it."""
    if "bucket_date" in cells.columns:
        cells = cells.where(F.col("bucket_date").between(F.lit(first), F.lit(last)))
    if "bucket_month" in cells.columns:
        months = first.strftime("%Y-%m"), last.strftime("%Y-%m")
        cells = cells.where(F.col("bucket_month").between(*map(F.lit, months)))
    return cells


def month_bounds(key: str) -> tuple[datetime, datetime]:
    """Half-open bounds of a ``YYYY-MM`` period, needed before planning to prune dates."""
    start = datetime.strptime(key, "%Y-%m").replace(tzinfo=timezone.utc)
    end = start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    return start, end


def snapshot_start(period: str, ts: Column) -> Column:
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[period]
    return F.to_date(F.date_trunc(unit, ts))


def snapshot_end(period: Column, start: Column) -> Column:
    return (
        F.when(period == "monthly", F.add_months(start, 1))
        .when(period == "daily", F.date_add(start, 1))
        .otherwise(F.date_add(start, 7))
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def lag_seconds(as_of: Column, ts: Column) -> Column:
    """Lag floored at zero, as the histogram observes it."""
    return F.greatest(seconds_between(as_of, ts), F.lit(0.0))


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_interval(mins=F.lit(minutes))


def utc(value: datetime | str) -> datetime:
    """Naive values are taken as UTC."""
    dt = datetime.fromisoformat(value) if isinstance(value, str) else value
    return dt.replace(tzinfo=timezone.utc) if dt.tzinfo is None else dt.astimezone(timezone.utc)


def ts_lit(value: datetime | str) -> Column:
    """A timestamp literal Catalyst can fold into pushed-down filters."""
    return F.lit(utc(value).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
