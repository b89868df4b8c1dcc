from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from helpers import M, M2, T0, at, cell_rows, logged
from paytally.operators import reconcile, rollup


def cells(spark, rows, grain="minute"):
    return cell_rows(rollup.cells_from_events(logged(spark, rows), grain))


def now(text):
    return at(text).replace(tzinfo=None)


def test_one_event(spark):
    for grain, bucket in (("minute", "2026-05-12 14:30"), ("day", "2026-05-12")):
        assert cells(spark, [(M, 5000, T0, T0)], grain) == {
            (M, now(bucket), "PAYMENT_CONFIRMED"): (1, 5000, 5000, 5000)
        }


def test_sum_min_and_max(spark):
    assert list(cells(spark, [(M, 1000, T0, T0)] * 10).values()) == [(10, 10000, 1000, 1000)]
    rows = [(M, a, T0, T0) for a in (100, 9900, 500)]
    assert list(cells(spark, rows).values()) == [(3, 10500, 100, 9900)]
    rows = [(M, a, T0, T0) for a in (0, 1000)]
    assert list(cells(spark, rows).values()) == [(2, 1000, 0, 1000)]


def test_missing_amount_counts_as_zero(spark):
    assert list(cells(spark, [(M, None, T0, T0), (M, 5, T0, T0)]).values()) == [(2, 5, 0, 5)]


def test_keys_separate_cells(spark):
    minute = timedelta(minutes=1)
    assert len(cells(spark, [(M, 1, T0, T0), (M, 1, T0 + minute, T0)])) == 2
    assert len(cells(spark, [(M, 1, T0, T0), (M2, 1, T0, T0)])) == 2
    assert len(cells(spark, [(M, 1, T0, T0), (M, 1, T0, T0, "PAYMENT_FAILED")])) == 2
    assert cells(spark, []) == {}


def test_hour_and_day_cross_finer_units(spark):
    hour = [(M, 1000, at("2026-05-12 14:00"), T0), (M, 2000, at("2026-05-12 14:45"), T0)]
    assert list(cells(spark, hour, "hour").values()) == [(2, 3000, 1000, 2000)]
    day = [(M, 1000, at("2026-05-12 09:00"), T0), (M, 2000, at("2026-05-12 18:30"), T0)]
    assert list(cells(spark, day, "day").values()) == [(2, 3000, 1000, 2000)]


def test_event_time_prefers_the_client(spark):
    early = [(M, 1, at("2026-05-12 13:55:30"), at("2026-05-12 14:00"))]
    assert [k[1] for k in cells(spark, early)] == [now("2026-05-12 13:55")]
    unset = [(M, 3000, None, at("2026-05-12 14:00:10"))]
    assert [k[1] for k in cells(spark, unset)] == [now("2026-05-12 14:00")]


def test_merging_any_split_equals_the_whole(spark):
    rows = [(M, i * 10, T0 + timedelta(seconds=37 * i), T0) for i in range(60)]
    log = logged(spark, rows)
    number = F.substring("id", 2, 9).cast("int")
    whole = cell_rows(rollup.cells_from_events(log, "minute"))
    for cut in (1, 17, 59):
        parts = [
            rollup.cells_from_events(log.where(c), "minute") for c in (number < cut, number >= cut)
        ]
        assert cell_rows(rollup.merge_cells(*parts)) == whole
    chain = rollup.rollup_chain(log)
    for grain in ("hour", "day"):
        assert cell_rows(chain[grain]) == cell_rows(rollup.cells_from_events(log, grain))


def test_backfill_adds_the_amount_once(spark):
    rows = spark.createDataFrame(
        [(M, T0, "PAYMENT_CONFIRMED", 3, 500), (M, T0, "PAYMENT_CONFIRMED", 1, 200)],
        "merchant_id string, bucket timestamp, event_type string, count_delta long, amount_cents long",
    )
    assert list(cell_rows(rollup.backfill_cells(rows, "minute")).values()) == [(4, 700, 200, 500)]


def test_board_takes_confirmed_volume_by_event_month(spark):
    rows = [
        (M, 100, at("2026-04-30 23:59:59"), T0),
        (M, 200, at("2026-05-01 00:00:00"), T0),
        (M, 999, T0, T0, "PAYMENT_FAILED"),
    ]
    board = rollup.board_increments(logged(spark, rows)).collect()
    assert {(r["period"], r["volume_cents"], r["transaction_count"]) for r in board} == {
        ("2026-04", 100, 1), ("2026-05", 200, 1),
    }


def test_discrepancies_name_a_tampered_day(spark):
    log = logged(spark, [(M, 100, T0, T0), (M, 100, T0 + timedelta(hours=2), T0), (M2, 5, T0, T0)])
    hours = rollup.cells_from_events(log, "hour")
    days = rollup.cells_from_events(log, "day")
    day = T0.date()
    assert reconcile.discrepancies(days, hours, day).isEmpty()
    tampered = days.withColumn(
        "count", F.when(F.col("merchant_id") == M, F.col("count") + 4).otherwise(F.col("count"))
    )
    found = reconcile.discrepancies(tampered, hours, day).collect()
    assert [tuple(r) for r in found] == [(M, "PAYMENT_CONFIRMED", 6, 2, 4)]
    no_hours = reconcile.discrepancies(days, hours.where("false"), day).collect()
    assert sorted(r["delta"] for r in no_hours) == [1, 2]


def test_events_per_day_newest_first(spark):
    rows = [(M, 1, None, T0 - timedelta(days=d)) for d in range(9)]
    days = rollup.events_per_day(logged(spark, rows)).collect()
    assert len(days) == 7 and days[0]["day"] == now("2026-05-12")
