from __future__ import annotations

from datetime import date, timedelta

import pytest

from helpers import M, M2, T0, at, logged, merchants
from paytally.operators import leaderboard as lb
from paytally.operators import rollup
from paytally.functions.time import ts_lit


def days(spark, rows):
    return rollup.cells_from_events(logged(spark, rows), "day")


def test_month_excludes_the_next_months_first_day(spark):
    rows = [
        (M, 100, at("2026-12-31 23:59"), T0), (M, 900, at("2027-01-01"), T0), (M2, 150, at("2026-12-01"), T0),
        (M2, 5000, at("2026-12-05"), T0, "PAYMENT_FAILED"),
    ]
    board = lb.leaderboard(days(spark, rows), "2026-12").collect()
    assert [(r["rank"], r["merchant_id"], r["volume_cents"]) for r in board] == [
        (1, M2, 150), (2, M, 100),
    ]
    assert str(board[0]["period_end"]) == "2027-01-01 00:00:00"


def test_ties_go_by_merchant_and_share_a_snapshot_rank(spark):
    rows = [(M2, 100, T0, T0), (M, 100, T0, T0), ("0" + M[1:], 50, T0, T0)]
    board = lb.leaderboard(days(spark, rows), "2026-05").collect()
    assert [r["merchant_id"] for r in board][:2] == [M, M2]
    snap = lb.snapshots(days(spark, rows), "daily").collect()
    assert sorted(r["rank"] for r in snap) == [1, 1, 3]


def test_top_n_bounds(spark):
    for n in (0, 101):
        with pytest.raises(ValueError):
            lb.leaderboard(days(spark, []), "2026-05", n)


def test_snapshot_keeps_a_hundred(spark):
    rows = [(f"{i:08d}-0000-4000-8000-000000000000", 1000 + i // 2, T0, T0) for i in range(130)]
    snap = lb.snapshots(days(spark, rows), "daily").collect()
    assert len(snap) == 100
    volumes = sorted((1000 + i // 2 for i in range(130)), reverse=True)
    assert {(r["amount_sum_cents"], r["rank"]) for r in snap} == {
        (v, 1 + sum(w > v for w in volumes)) for v in volumes[:100]
    }


def test_history_counts_periods_not_rows(spark):
    rows = [(m, 100, T0 - timedelta(days=d), T0) for d in range(31) for m in (M, M2)]
    stored = lb.snapshots(days(spark, rows), "daily", ts_lit(T0))
    known = merchants(spark, (M,))
    history = lb.snapshot_history(stored, known, "daily", 12).collect()
    assert len(history) == 12
    assert history[0]["period_start"] == date(2026, 5, 12)
    assert history[0]["period_end"] == date(2026, 5, 13)
    assert [e["merchant_name"] for e in history[0]["entries"]] == ["shop 1", None]
    for bad in ({"period": "yearly"}, {"limit": 0}, {"limit": 53}):
        with pytest.raises(ValueError):
            lb.snapshot_history(stored, known, **bad)


def test_weekly_and_monthly_period_of_a_day():
    assert lb.period_range("weekly", date(2026, 5, 13)) == (date(2026, 5, 11), date(2026, 5, 18))
    assert lb.period_range("monthly", date(2026, 12, 31)) == (date(2026, 12, 1), date(2027, 1, 1))
    with pytest.raises(ValueError):
        lb.period_range("yearly", date(2026, 1, 1))
