"""Batches, commits, folds and the nightly jobs, without a running stream."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import GHOST, M, M2, T0, at, cell_rows, merchants, producer
from paytally.operators.rollup import cells_from_events
from paytally.plans import nightly, queries
from paytally.sources.store import IngestStore, RollupStore, SnapshotStore
from paytally.streaming.ingest import ingest_batch
from paytally.streaming.rollup import backfill, rebuild, rollup_batch

pytestmark = pytest.mark.usefixtures("interpreted")


class Crash(RuntimeError):
    pass


def crash_at(store, name, monkeypatch):
    """Make the next write of a table (or the commit) fail."""
    method = "commit" if name == "commit" else "write"
    real = getattr(type(store), method)

    def failing(self, *args, **kwargs):
        if name == "commit" or args[0] == name:
            monkeypatch.setattr(type(store), method, real)
            raise Crash(name)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(store), method, failing)


@pytest.fixture
def ingest(spark, tmp_path):
    return IngestStore(spark, f"{tmp_path}/ingest")


@pytest.fixture
def rollups(spark, tmp_path):
    return RollupStore(spark, f"{tmp_path}/rollups")


def send(spark, ingest, rows, batch_id, run="r1", now=T0, **options):
    ingest_batch(
        ingest, producer(spark, rows), merchants(spark), run, batch_id, now=now, **options
    )


def roll(rollups, ingest, run, batch_id, commits=None, now=T0):
    rollup_batch(rollups, ingest, ingest.commits() if commits is None else commits, run, batch_id, now)


def state(rollups):
    return {g: cell_rows(rollups.cells(g)) for g in ("minute", "hour", "day")}


def test_ingest_summary_and_tables(spark, ingest):
    rows = [("a", M, 100, T0), ("a", M, 999, T0 + timedelta(seconds=5)), ("b", GHOST, 1, T0),
            ("c", M, -1, T0), ("d", M2, 5, None)]
    send(spark, ingest, rows, 0, keep_responses=True)
    row = ingest.commits().first()
    counts = {k: row[k] for k in ("submitted", "accepted", "duplicates", "rejected")}
    assert counts == {"submitted": 5, "accepted": 2, "duplicates": 1, "rejected": 2}
    log = {r["idempotency_key"]: r["amount_cents"] for r in ingest.log().collect()}
    assert log == {"a": 100, "d": 5}
    reasons = {r["idempotency_key"]: r["reject_reasons"] for r in ingest.read("quarantine").collect()}
    assert reasons == {"b": ["unknown_merchant"], "c": ["amount_cents"]}
    answers = ingest.read("responses").collect()
    assert sorted((r["idempotency_key"], r["duplicate"]) for r in answers) == [
        ("a", False), ("a", True), ("d", False),
    ]


def test_key_is_claimed_once_across_batches_and_days(spark, ingest):
    send(spark, ingest, [("a", M, 100, T0)], 0)
    first = ingest.log().first()
    send(spark, ingest, [("a", M, 100, T0), ("b", M, 1, T0)], 1, now=T0 + timedelta(days=3),
         keep_responses=True)
    assert ingest.log().count() == 2
    answer = {r["idempotency_key"]: r for r in ingest.read("responses").collect()}
    assert answer["a"]["duplicate"] and answer["a"]["event_id"] == first["id"]
    assert answer["a"]["occurred_at"] == first["occurred_at"]
    assert not answer["b"]["duplicate"]
    ingest.fold("ledger")
    send(spark, ingest, [("b", M, 7, T0)], 2)
    assert ingest.log().count() == 2


def test_committed_batch_is_not_repeated(spark, ingest):
    send(spark, ingest, [("a", M, 100, T0)], 0)
    send(spark, ingest, [("z", M, 100, T0)], 0)
    assert [r["idempotency_key"] for r in ingest.log().collect()] == ["a"]


@pytest.mark.parametrize("table", ["log", "ledger", "commit"])
def test_ingest_crash_hides_the_batch_and_a_retry_completes_it(spark, ingest, monkeypatch, table):
    send(spark, ingest, [("a", M, 1, T0)], 0)
    crash_at(ingest, table, monkeypatch)
    with pytest.raises(Crash):
        send(spark, ingest, [("a", M, 1, T0), ("b", M, 2, T0)], 1)
    assert ingest.log().count() == 1 and ingest.ledger().count() == 1
    send(spark, ingest, [("a", M, 1, T0), ("b", M, 2, T0)], 1)
    assert ingest.log().count() == 2 and ingest.ledger().count() == 2


def test_rollup_and_replay(spark, ingest, rollups):
    send(spark, ingest, [("a", M, 1000, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    before = state(rollups)
    assert {k: list(v.values()) for k, v in before.items()} == {
        g: [(1, 1000, 1000, 1000)] for g in before
    }
    for again in range(2):
        roll(rollups, ingest, f"replay{again}", 0)
        assert state(rollups) == before
    send(spark, ingest, [("b", M, 2000, T0)], 1)
    roll(rollups, ingest, "replay-new", 0)
    assert list(state(rollups)["minute"].values()) == [(2, 3000, 1000, 2000)]
    last = rollups.commits().where("src_run = 'replay-new'").first()
    assert (last["fetched"], last["new"], last["skipped"]) == (2, 1, 1)


def test_position_and_empty_log(spark, ingest, rollups):
    roll(rollups, ingest, "r1", 0)
    assert state(rollups) == {"minute": {}, "hour": {}, "day": {}}
    assert rollups.commits().where("last_event_at is not null").isEmpty()
    send(spark, ingest, [("a", M, 1, T0)], 0)
    status = nightly.consumer_status([rollups], T0)
    assert [r["status"] for r in status.collect()] == ["unknown"]
    roll(rollups, ingest, "r1", 1, now=T0 + timedelta(seconds=90))
    status = nightly.consumer_status([rollups], T0 + timedelta(seconds=31)).first()
    assert (status["lag_seconds"], status["status"]) == (31.0, "degraded")
    row = rollups.commits().where("src_batch = 1").first()
    assert row["last_event_id"] == ingest.log().first()["id"]
    assert row["lag_seconds"] == 90.0


def test_late_event_updates_its_own_minute(spark, ingest, rollups):
    early = T0 - timedelta(hours=3)
    send(spark, ingest, [("a", M, 7500, early), ("b", M, 1, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    buckets = {k[1] for k in cell_rows(rollups.cells("minute", early.date(), T0.date()))}
    assert buckets == {early.replace(tzinfo=None), T0.replace(tzinfo=None)}
    late = rollups.read("late").collect()
    assert [(r["lag_seconds"], r["client_delay_s"]) for r in late] == [(10800.0, 10800.0)]


@pytest.mark.parametrize("table", ["minute", "late", "commit"])
def test_rollup_crash_then_an_abandoned_run(spark, ingest, rollups, monkeypatch, table):
    send(spark, ingest, [("a", M, 1, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    send(spark, ingest, [("b", M, 2, T0)], 1)
    crash_at(rollups, table, monkeypatch)
    with pytest.raises(Crash):
        roll(rollups, ingest, "r1", 1)
    assert list(state(rollups)["day"].values()) == [(1, 1, 1, 1)]
    roll(rollups, ingest, "other", 0)
    assert list(state(rollups)["day"].values()) == [(2, 3, 1, 2)]
    # The first run comes back for its batch and finds everything marked.
    roll(rollups, ingest, "r1", 1)
    assert list(state(rollups)["day"].values()) == [(2, 3, 1, 2)]
    assert rollups.read("markers").count() == 2


def test_consumers_do_not_share_tables(spark, ingest, rollups, tmp_path):
    send(spark, ingest, [("a", M, 1, T0)], 0)
    other = RollupStore(spark, f"{tmp_path}/rollups", consumer_id="second")
    for store in (rollups, other):
        roll(store, ingest, "r1", 0)
        assert list(state(store)["day"].values()) == [(1, 1, 1, 1)]


def test_splits_folds_and_rebuild_agree(spark, ingest, rollups, tmp_path):
    rows = [(f"k{i}", M if i % 3 else M2, i, T0 + timedelta(minutes=37 * i)) for i in range(40)]
    for batch, start in enumerate((0, 5, 22)):
        send(spark, ingest, rows[start : (5, 22, 40)[batch]], batch)
        commits = ingest.commits().where(F.col("src_batch") == batch)
        roll(rollups, ingest, "r1", batch, commits)
        if batch == 1:
            for name in rollups.tables:
                rollups.fold(name)
    log = ingest.log()
    whole = {g: cell_rows(cells_from_events(log, g)) for g in ("minute", "hour", "day")}
    assert state(rollups) == whole
    for name in rollups.tables:
        rollups.fold(name)
    assert not rollups.pending("minute") and state(rollups) == whole
    assert len(rollups.vacuum()) > 0
    assert state(rollups) == whole and rollups.read("markers").count() == 40
    roll(rollups, ingest, "replay", 0)
    assert state(rollups) == whole
    fresh = RollupStore(spark, f"{tmp_path}/rollups", consumer_id="fresh")
    rebuild(fresh, ingest)
    assert state(fresh) == whole
    with pytest.raises(ValueError):
        rebuild(fresh, ingest)


def test_fold_rewrites_touched_days_only(spark, ingest, rollups):
    send(spark, ingest, [("a", M, 1, T0), ("b", M, 1, T0 + timedelta(days=1))], 0)
    roll(rollups, ingest, "r1", 0)
    rollups.fold("minute")
    send(spark, ingest, [("c", M, 1, T0)], 1)
    roll(rollups, ingest, "r1", 1, ingest.commits().where("src_batch = 1"))
    rollups.fold("minute")
    assert rollups.base_parts("minute") == {"2026-05-12": 1, "2026-05-13": 0}
    assert sum(c[0] for c in state(rollups)["minute"].values()) == 3


def test_crash_while_folding_changes_nothing(spark, ingest, rollups, monkeypatch):
    send(spark, ingest, [("a", M, 1, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    before = state(rollups)
    real = RollupStore._write

    def torn(self, *args):
        real(self, *args)
        raise Crash("fold")

    monkeypatch.setattr(RollupStore, "_write", torn)
    with pytest.raises(Crash):
        rollups.fold("minute")
    monkeypatch.setattr(RollupStore, "_write", real)
    assert state(rollups) == before
    rollups.fold("minute")
    assert state(rollups) == before


def test_vacuum_removes_uncommitted_files(spark, ingest, monkeypatch):
    send(spark, ingest, [("a", M, 1, T0)], 0)
    crash_at(ingest, "commit", monkeypatch)
    with pytest.raises(Crash):
        send(spark, ingest, [("b", M, 1, T0)], 1)
    gone = ingest.vacuum()
    assert any("/log/" in p and p.endswith("batch_id=1") for p in gone)
    assert not any(p.endswith("batch_id=0") for p in gone)
    assert ingest.log().count() == 1


def test_backfill_reaches_all_granularities_once(spark, rollups):
    deltas = spark.createDataFrame(
        [(M, T0, "PAYMENT_CONFIRMED", 2, 500)],
        "merchant_id string, bucket timestamp, event_type string, count_delta long, amount_cents long",
    )
    for _ in range(2):
        backfill(rollups, deltas, "backfill", 0, T0)
    assert {g: list(c.values()) for g, c in state(rollups).items()} == {
        g: [(2, 500, 500, 500)] for g in ("minute", "hour", "day")
    }


def test_retention_drops_old_days(spark, ingest, rollups):
    rows = [(f"k{d}", M, 1, T0 - timedelta(days=d)) for d in range(4)]
    send(spark, ingest, rows, 0)
    roll(rollups, ingest, "r1", 0)
    nightly.drop_before(rollups, "minute", date(2026, 5, 11))
    assert {k[1].day for k in state(rollups)["minute"]} == {11, 12}
    assert len(state(rollups)["day"]) == 4
    rollups.vacuum()
    assert {k[1].day for k in state(rollups)["minute"]} == {11, 12}


def test_pruned_ledger_lets_a_key_in_again(spark, ingest):
    send(spark, ingest, [("a", M, 1, T0)], 0)
    nightly.drop_before(ingest, "ledger", T0.date())
    send(spark, ingest, [("a", M, 1, T0)], 1)
    assert ingest.log().count() == 1
    nightly.drop_before(ingest, "ledger", T0.date() + timedelta(days=1))
    send(spark, ingest, [("a", M, 1, T0)], 2)
    assert ingest.log().count() == 2


def test_nightly_reports_a_tampered_day_and_repairs_it(spark, ingest, rollups, tmp_path):
    other_day = T0 + timedelta(days=2)
    send(spark, ingest, [("a", M, 100, T0), ("b", M2, 50, T0), ("c", M, 7, other_day)], 0)
    roll(rollups, ingest, "r1", 0)
    good = state(rollups)
    month = "2026-05"
    wrong = rollups.read("day", month, month).withColumn(
        "count", F.when(F.col("merchant_id") == M, F.col("count") + 3).otherwise(F.col("count"))
    )
    rollups.fold("day", wrong, [month])
    snaps = SnapshotStore(spark, str(tmp_path))
    found = nightly.run_compaction(rollups, snaps, T0.date(), ("daily", "weekly", "monthly"))
    assert [tuple(r) for r in found.collect()] == [(M, "PAYMENT_CONFIRMED", 4, 1, 3)]
    repaired = state(rollups)["day"]
    assert repaired[(M, T0.replace(hour=0, minute=0, tzinfo=None), "PAYMENT_CONFIRMED")][0] == 1
    assert repaired[(M, other_day.replace(hour=0, minute=0, tzinfo=None), "PAYMENT_CONFIRMED")][0] == 4
    nightly.run_compaction(rollups, snaps, other_day.date())
    assert state(rollups) == good
    daily = snaps.read().where("period = 'daily' and period_start = '2026-05-12'")
    assert [(r["merchant_id"], r["rank"]) for r in daily.orderBy("rank").collect()] == [(M, 1), (M2, 2)]
    monthly = snaps.read().where("period = 'monthly'").orderBy("rank").collect()
    assert [r["amount_sum_cents"] for r in monthly] == [107, 50]
    again = nightly.run_compaction(rollups, snaps, T0.date())
    assert again.isEmpty() and state(rollups) == good


def test_rerun_snapshot_drops_merchants_that_left(spark, tmp_path):
    snaps = SnapshotStore(spark, str(tmp_path))
    row = lambda m: spark.createDataFrame([("i", m, 1, 5, T0, "daily", T0.date())], snaps.schema)
    snaps.write(row(M), "daily", T0.date())
    snaps.write(row(M2), "daily", T0.date())
    assert [r["merchant_id"] for r in snaps.read().collect()] == [M2]
    snaps.write_all(row(M))
    assert [r["merchant_id"] for r in snaps.read().collect()] == [M]


def test_leaderboard_is_served_then_rebuilt(spark, ingest, rollups):
    send(spark, ingest, [("a", M, 100, T0), ("b", M2, 100, T0), ("c", M, 1, at("2026-06-01"))], 0)
    roll(rollups, ingest, "r1", 0)
    served = nightly.serve_leaderboard(rollups, "2026-05", 1).collect()
    assert [(r["merchant_id"], r["source"]) for r in served] == [(M, "board")]
    rollups.fold("board", drop_before="2026-06")
    rebuilt = nightly.serve_leaderboard(rollups, "2026-05", 1).collect()
    assert [(r["merchant_id"], r["source"]) for r in rebuilt] == [(M, "rollup_day")]
    nightly.rebuild_board(rollups, "2026-05")
    larger = nightly.serve_leaderboard(rollups, "2026-05", 10).collect()
    assert [(r["merchant_id"], r["volume_cents"], r["source"]) for r in larger] == [
        (M, 100, "board"), (M2, 100, "board"),
    ]


def test_metric_reads_prune_folders(spark, ingest, rollups):
    rows = [(f"k{d}", M, 1, T0 - timedelta(days=d)) for d in range(5)]
    send(spark, ingest, rows, 0)
    roll(rollups, ingest, "r1", 0)
    for name in ("minute", "hour", "day"):
        rollups.fold(name)
    record = nightly.metrics_from_store(rollups, T0 - timedelta(hours=2), T0, M)
    assert record.first()["total_count"] == 1
    plan = rollups.cells("minute", T0.date(), T0.date())._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [" in plan.toString()
    files = rollups.cells("minute", T0.date(), T0.date()).where("count > 0").select(F.input_file_name())
    assert {f[0].split("bucket_date=")[1][:10] for f in files.collect()} == {"2026-05-12"}
    line = nightly.sparkline_from_store(rollups, T0, 60, M).collect()
    assert [r["count"] for r in line] == [1]


def test_a_board_read_writes_nothing(spark, ingest, rollups):
    send(spark, ingest, [("a", M, 100, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    rollups.fold("board", drop_before="2026-06")
    before = rollups.base_state("board")
    for _ in range(2):
        nightly.serve_leaderboard(rollups, "2026-05", 1).collect()
    assert rollups.base_state("board") == before


def test_folded_and_vacuumed_log_keeps_its_rows(spark, ingest):
    send(spark, ingest, [("a", M, 100, T0), ("b", M, 200, T0)], 0)
    before = {r["idempotency_key"] for r in ingest.log().collect()}
    for name in ("log", "ledger", "quarantine", "responses"):
        ingest.fold(name)
    assert {r["idempotency_key"] for r in ingest.log().collect()} == before
    ingest.vacuum()
    assert {r["idempotency_key"] for r in ingest.log().collect()} == before


def test_a_torn_commit_folder_is_not_a_commit(spark, ingest):
    torn = f"{ingest.batch_path('commit', 'src', 0)}/_temporary"
    ingest._make(torn.removeprefix(f"{ingest.root}/"))
    assert not ingest.is_committed("src", 0)
    send(spark, ingest, [("a", M, 100, T0)], 0)
    assert ingest.log().count() == 1


def test_a_batch_committed_while_a_day_is_compacted_stays(spark, ingest, rollups, monkeypatch):
    send(spark, ingest, [("a", M, 100, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    fold = rollups.fold

    def late(name, *rest, **more):
        monkeypatch.setattr(rollups, "fold", fold)
        send(spark, ingest, [("b", M, 200, T0)], 1)
        roll(rollups, ingest, "r1", 1)
        return fold(name, *rest, **more)

    monkeypatch.setattr(rollups, "fold", late)
    nightly.compact_day(rollups, T0.date())
    total = lambda grain: rollups.cells(grain).agg({"count": "sum"}).first()[0]
    assert total("hour") == total("day") == 2


def test_a_batch_of_one_part_is_written_by_several_tasks(spark, ingest, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ingest_batch(ingest, producer(spark, [(f"k{i}", M, 5, T0) for i in range(40)]), merchants(spark), "r", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "ingest/ledger/run_id=r/batch_id=0").glob("key_part=*/part-*"))) > 1
    assert ingest.ledger().count() == 40


def test_arriving_files_are_small_enough_to_deal_out(spark, tmp_path, monkeypatch):
    events = spark.range(30).selectExpr(
        "id event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) ts", "id user_id", "'purchase' event_type",
        "1.0d value", "'{}' props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(30).selectExpr("id c_custkey", "'a' c_name", "'BUILDING' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(queries, "FILE_ROWS", 5, raising=False)
    store = queries.run_ingest(spark, str(tmp_path), f"{tmp_path}/root", 2)
    assert store.log().count() == 30
    assert all(len(list((tmp_path / f"root/inbox/{n:04}").glob("part-*"))) >= 3 for n in range(2))
