from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import at
from paytally.functions import time as t
from paytally.functions.measures import as_uuid, success_rate
from paytally.operators import metrics


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_truncation_and_period_key(spark):
    ts = t.ts_lit("2026-05-12 14:37:42.123456")
    row = one(spark, *[t.bucket(g, ts) for g in t.GRAINS], t.period_key(ts))
    assert [str(v) for v in row] == [
        "2026-05-12 14:37:00", "2026-05-12 14:00:00", "2026-05-12 00:00:00", "2026-05",
    ]


def test_truncation_at_an_exact_boundary(spark):
    ts = t.ts_lit("2026-05-12 14:00:00")
    assert {str(v) for v in one(spark, t.bucket("minute", ts), t.bucket("hour", ts))} == {
        "2026-05-12 14:00:00"
    }


def test_unknown_granularity():
    with pytest.raises(ValueError):
        t.bucket("week", F.col("x"))


def test_period_bounds_roll_the_year(spark):
    assert t.month_bounds("2026-12") == (at("2026-12-01"), at("2027-01-01"))
    assert t.month_bounds("2026-01") == (at("2026-01-01"), at("2026-02-01"))
    row = one(spark, t.period_start(F.lit("2026-12")), t.period_end(F.lit("2026-12")))
    assert [str(v) for v in row] == ["2026-12-01 00:00:00", "2027-01-01 00:00:00"]


@pytest.mark.parametrize(
    "period, end", [("daily", "2026-12-02"), ("weekly", "2026-12-08"), ("monthly", "2027-01-01")]
)
def test_snapshot_end(spark, period, end):
    start = F.lit("2026-12-01").cast("date")
    assert str(one(spark, t.snapshot_end(F.lit(period), start))[0]) == end


def test_lag_is_floored_at_zero(spark):
    as_of = t.ts_lit("2026-05-12 14:00:00")
    early, later = t.ts_lit("2026-05-12 13:59:58.5"), t.ts_lit("2026-05-12 14:00:10")
    assert tuple(one(spark, t.lag_seconds(as_of, early), t.lag_seconds(as_of, later))) == (1.5, 0.0)


@pytest.mark.parametrize(
    "hours, grain",
    [
        (1, "minute"), (3, "minute"), (3.1, "hour"), (24 * 7, "hour"), (24 * 30, "hour"),
        (24 * 31, "day"), (24 * 365, "day"),
    ],
)
def test_granularity_by_range(spark, hours, grain):
    start = at("2026-01-01")
    end = start + timedelta(hours=hours)
    assert metrics.choose_grain(start, end) == grain
    assert one(spark, metrics.grain_of(t.ts_lit(start), t.ts_lit(end)))[0] == grain


def test_range_checks():
    now = at("2026-05-12 12:00:00")
    assert metrics.check_range(None, None, now) == (now - timedelta(hours=24), now)
    assert metrics.check_range(None, "2026-05-10", now)[0] == at("2026-05-09")
    naive = datetime(2026, 5, 1)
    assert metrics.check_range(naive, now)[0].tzinfo == timezone.utc
    with pytest.raises(ValueError, match="before"):
        metrics.check_range(now, now)
    metrics.check_range(now - timedelta(days=365, hours=23), now)
    with pytest.raises(ValueError, match="365"):
        metrics.check_range(now - timedelta(days=366), now)


def test_success_rate_rounds_half_even_and_is_null_without_outcomes(spark):
    rate = lambda c, f: one(spark, success_rate(F.lit(c), F.lit(f)))[0]
    assert rate(1, 31) == round(1 / 32, 4) == 0.0312
    assert rate(2, 1) == 0.6667
    assert rate(0, 0) is None


def test_ids_repeat_and_look_like_uuids(spark):
    row = one(spark, as_uuid(F.lit("k")), as_uuid(F.lit("k")), as_uuid(F.lit("j")))
    assert row[0] == row[1] != row[2]
    assert [len(p) for p in row[0].split("-")] == [8, 4, 4, 4, 12]
