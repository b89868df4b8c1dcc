from __future__ import annotations

import random
from datetime import timedelta

import pytest

from helpers import M, M2, T0, at, logged
from paytally.operators import lag, metrics, rollup
from paytally.functions.time import ts_lit


def tables(spark, rows):
    log = logged(spark, rows).cache()
    return {g: rollup.cells_from_events(log, g) for g in ("minute", "hour", "day")}


def test_ranges_include_both_ends(spark):
    rows = [(M, 10, at(f"2026-05-12 {h:02}:00"), T0) for h in range(6)]
    hours = tables(spark, rows)["hour"]
    found = metrics.range_buckets(hours, at("2026-05-12 01:00"), at("2026-05-12 04:00"), M)
    assert [r["bucket"].hour for r in found.collect()] == [1, 2, 3, 4]
    partial = metrics.range_buckets(hours, at("2026-05-12 01:30"), at("2026-05-12 04:00"), M)
    assert [r["bucket"].hour for r in partial.collect()] == [2, 3, 4]


def test_record_of_a_merchant_without_events(spark):
    cells = tables(spark, [(M, 10, T0, T0)])
    row = metrics.merchant_metrics(cells, T0 - timedelta(hours=2), T0, M2).first()
    assert (row["total_count"], row["total_volume_cents"], row["success_rate"], row["data"]) == (
        0, 0, None, [],
    )


def test_record(spark):
    minute = timedelta(minutes=1)
    rows = [(M, 100, T0, T0), (M, 50, T0, T0, "PAYMENT_FAILED"), (M, 7, T0 + minute, T0)]
    cells = tables(spark, rows)
    row = metrics.merchant_metrics(cells, T0 - timedelta(hours=1), T0 + minute, M).first()
    assert row["granularity"] == "minute"
    assert (row["total_count"], row["total_volume_cents"]) == (3, 157)
    assert [(d["volume_cents"], d["count"]) for d in row["data"]] == [(150, 2), (7, 1)]
    assert row["success_rate"] == 0.6667


def test_success_rate_uses_hours(spark):
    cells = tables(spark, [(M, 1, T0, T0)])
    inside = metrics.merchant_metrics(cells, T0, T0 + timedelta(minutes=10), M).first()
    assert inside["total_count"] == 1 and inside["success_rate"] is None


def test_sparkline(spark):
    rows = [(M, 10, T0 - timedelta(minutes=m), T0) for m in (0, 3, 59, 60, 61)]
    found = metrics.sparkline(tables(spark, rows)["minute"], T0, 60, M).collect()
    assert [r["bucket"].minute for r in found] == [30, 31, 27, 30]
    for window in (4, 1441):
        with pytest.raises(ValueError):
            metrics.sparkline(tables(spark, rows)["minute"], T0, window)


def brute(events, merchant, start, end):
    grain = metrics.choose_grain(start, end)
    cut = {
        "minute": lambda t: t.replace(second=0, microsecond=0),
        "hour": lambda t: t.replace(minute=0, second=0, microsecond=0),
        "day": lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0),
    }
    mine = [(t, a, k) for m, a, t, _, k in events if m == merchant]
    found = [a for t, a, _ in mine if start <= cut[grain](t) <= end]
    kinds = [k for t, _, k in mine if start <= cut["hour"](t) <= end]
    good, bad = kinds.count("PAYMENT_CONFIRMED"), kinds.count("PAYMENT_FAILED")
    rate = round(good / (good + bad), 4) if good + bad else None
    return sum(found), len(found), rate


def test_requests_match_a_loop(spark):
    """A hot merchant, all granularities, edges on and off bucket starts."""
    rng = random.Random(5)
    kinds = ["PAYMENT_CONFIRMED", "PAYMENT_FAILED", "PAYMENT_INITIATED"]
    events = [
        (
            M if rng.random() < 0.8 else M2,
            rng.randrange(1000),
            T0 - timedelta(seconds=rng.randrange(60 * 86400)),
            T0,
            rng.choice(kinds),
        )
        for _ in range(400)
    ]
    spans = [
        timedelta(hours=1), timedelta(hours=3), timedelta(hours=5), timedelta(days=2),
        timedelta(days=30), timedelta(days=31, hours=5), timedelta(days=60),
    ]
    requests = []
    for i in range(60):
        end = T0 - timedelta(seconds=rng.randrange(40 * 86400))
        if i % 3 == 0:
            end = end.replace(minute=0, second=0)
        if i % 6 == 0:
            end = end.replace(hour=0)
        requests.append((i, rng.choice([M, M, M2]), end - rng.choice(spans), end))
    table = spark.createDataFrame(
        requests, 'request_id int, merchant_id string, start timestamp, end timestamp'
    )
    answered = metrics.answer_requests(table, tables(spark, events))
    got = {
        r["request_id"]: (r["total_volume_cents"], r["total_count"], r["success_rate"])
        for r in answered.collect()
    }
    assert got == {i: brute(events, m, s, e) for i, m, s, e in requests}


def test_bad_requests_come_back_with_an_error(spark):
    table = spark.createDataFrame(
        [(1, M, T0, T0), (2, M, T0 - timedelta(days=366), T0), (3, M, T0 - timedelta(days=365), T0)],
        "request_id int, merchant_id string, start timestamp, end timestamp",
    )
    answered = metrics.answer_requests(table, tables(spark, [(M, 1, T0, T0)])).collect()
    errors = {r["request_id"]: r["error"] for r in answered}
    assert errors[1] == "start must be before end" and "365" in errors[2] and errors[3] is None
    assert {r["request_id"]: r["total_count"] for r in answered} == {1: None, 2: None, 3: 1}


def test_equal_requests_are_answered_one_by_one(spark):
    day_ago = T0 - timedelta(days=1)
    rows = [(1, M, day_ago, T0), (1, M, day_ago, T0), (1, M, day_ago, T0), (2, M2, day_ago, T0)]
    rows += [(3, None, day_ago, T0), (4, M, None, T0), (5, M, day_ago, None), (5, M, day_ago, None)]
    table = spark.createDataFrame(
        rows, "request_id int, merchant_id string, start timestamp, end timestamp"
    )
    events = [(M, 7, T0 - timedelta(hours=2), T0)]
    answered = metrics.answer_requests(table, tables(spark, events)).collect()
    got = sorted((r["request_id"], r["total_volume_cents"], r["total_count"]) for r in answered if r["error"] is None)
    assert got == [(1, 7, 1)] * 3 + [(2, 0, 0), (3, 0, 0)]
    bad = [r for r in answered if r["request_id"] >= 4]
    assert len(bad) == 3
    assert all(r["error"] == "start and end are required" and r["total_count"] is None for r in bad)


def test_late_events(spark):
    rows = [(M, 1, T0 - timedelta(hours=3), T0), (M, 1, T0 - timedelta(seconds=59), T0),
            (M, 1, None, T0 - timedelta(seconds=61))]
    late = lag.late_events(logged(spark, rows), ts_lit(T0)).collect()
    assert {(r["event_id"], r["lag_seconds"], r["client_delay_s"]) for r in late} == {
        ("e0", 10800.0, 10800.0), ("e2", 61.0, None),
    }


def test_lag_histogram_is_cumulative(spark):
    lags = spark.createDataFrame(
        [("w", v) for v in (0.0, 0.1, 0.4, 7.0, 1000.0)], "worker_id string, lag_seconds double"
    )
    counts = {r["le"]: r["count"] for r in lag.lag_histogram(lags).collect()}
    assert counts == {"0.1": 2, "0.5": 3, "1": 3, "5": 3, "10": 4, "30": 4, "60": 4, "120": 4,
                      "300": 4, "+Inf": 5}


def test_paging_keeps_rows_that_share_the_cursor_time(spark):
    log = logged(spark, [(M, 1, None, T0)] * 5 + [(M, 1, None, T0 + timedelta(seconds=1))])
    first = [r["id"] for r in lag.events_after(log, None, 3).collect()]
    rest = [r["id"] for r in lag.events_after(log, (T0, first[-1]), 3).collect()]
    assert first + rest == ["e0", "e1", "e2", "e3", "e4", "e5"]


def test_recent_events_newest_first(spark):
    log = logged(spark, [(M, 1, None, T0 + timedelta(days=d)) for d in range(30)])
    newest = lag.recent_events(log, 20, since=T0 + timedelta(days=25)).collect()
    assert [r["id"] for r in newest] == ["e29", "e28", "e27", "e26", "e25"]
    assert lag.recent_events(log).count() == 20


def test_pipeline_status(spark):
    positions = spark.createDataFrame(
        [("a", "x", T0 - timedelta(seconds=30)), ("b", "y", T0 - timedelta(seconds=31))],
        "consumer_id string, last_event_id string, last_event_at timestamp",
    )
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "consumer_id string")
    status = {r["consumer_id"]: r["status"] for r in lag.pipeline_lag(positions, names, T0).collect()}
    assert status == {"a": "ok", "b": "degraded", "c": "unknown"}
