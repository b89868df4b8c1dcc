"""Published state: concurrent folds, rolled commit rows, keyed lookups, resumed rebuilds, snapshots."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import M, M2, T0, cell_rows
from paytally.operators import lag
from paytally.operators.rollup import cells_from_events
from paytally.sources import store as stores
from paytally.sources.state import Batches, Conflict, Published
from paytally.sources.store import IngestStore, RollupStore, SnapshotStore
from paytally.streaming.rollup import rebuild, start_rollup
from test_stores import Crash, ingest, roll, rollups, send, state  # noqa: F401

pytestmark = pytest.mark.usefixtures("interpreted")


def test_batches_are_sets():
    draw = random.Random(1)
    pairs = lambda: {(draw.choice("xy"), draw.randint(0, 12)) for _ in range(draw.randint(0, 14))}
    for _ in range(300):
        a, b = pairs(), pairs()
        x, y = Batches.of(a), Batches.of(b)
        assert set(x) == a and set(x | y) == a | b and set(x - y) == a - b and set(x & y) == a & b
        assert all((p in x) == (p in a) for p in a | b)
        assert Batches.of_rows([dict(zip(("run_id", "first", "last"), r)) for r in x.rows()]) == x
        assert x | y == Batches.of(a | b) and bool(x - x) is False


def test_a_version_is_published_once(spark, tmp_path):
    published = Published(spark, f"{tmp_path}/state")
    stores._make_folder(spark, published.folder)
    assert published.latest() == (-1, {})
    published.publish(0, {"a": 1})
    with pytest.raises(Conflict):
        published.publish(0, {"a": 2})
    published.publish(1, {"a": 3})
    assert published.latest() == (1, {"a": 3}) and published.versions() == [0, 1]
    published.prune()
    assert published.versions() == [1]


def test_of_two_folds_at_once_one_is_refused(spark, ingest, rollups, tmp_path, monkeypatch):  # noqa: F811
    send(spark, ingest, [("a", M, 1, T0), ("b", M2, 2, T0 + timedelta(days=1))], 0)
    roll(rollups, ingest, "r1", 0)
    before = state(rollups)
    other = RollupStore(spark, f"{tmp_path}/rollups")
    real = RollupStore._write

    def meanwhile(self, *args):
        monkeypatch.setattr(RollupStore, "_write", real)
        real(self, *args)
        other.fold("minute")

    monkeypatch.setattr(RollupStore, "_write", meanwhile)
    with pytest.raises(Conflict):
        rollups.fold("minute")
    assert state(rollups) == before and not rollups.pending("minute")
    folds = stores._children(spark, f"{rollups.root}/base/minute", "fold=")
    assert len(folds) == 2  # each wrote its own
    gone = rollups.vacuum()
    assert len([g for g in gone if "/base/minute/" in g]) == 1 and state(rollups) == before


def test_no_job_runs_before_a_stored_read(spark, ingest, rollups):  # noqa: F811
    send(spark, ingest, [("a", M, 1, T0)], 0)
    roll(rollups, ingest, "r1", 0)
    rollups.fold("hour")
    spark.sparkContext.setJobGroup("planning", "reads that are not run")
    try:
        cells = rollups.cells("hour", T0.date(), T0.date())
        ingest.log()
        assert not ingest.is_committed("r1", 7) and ingest.is_committed("r1", 0)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert cells.count() == 1


def _claims(spark, keys, day=T0):
    rows = [(k, f"e-{k}", day, day.date(), None) for k in keys]
    return spark.createDataFrame(rows, stores.schemas.LEDGER)


def _files(rows):
    return {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}


def test_a_lookup_reads_as_much_of_a_long_history(spark, ingest, monkeypatch):  # noqa: F811
    monkeypatch.setattr(stores, "PART_ROWS", 5)
    monkeypatch.setattr(stores, "FANOUT", 3)
    asked = spark.createDataFrame([("k3",), ("k17",), ("new",)], "idempotency_key string")
    files, batch = {}, 0
    for history in (60, 600):
        while (have := 20 * batch) < history:
            step = 20 if history == 60 else 540
            for at in range(have, have + step, 20):
                ingest.commit("r", at // 20, accepted=20)
            # one write for many batches keeps the test short: the first holds all their rows
            ingest.write("ledger", _claims(spark, [f"k{i}" for i in range(have, have + step)]), "r", batch)
            batch += step // 20
            ingest.fold("ledger")
        found = ingest.claims(asked)
        files[history] = len(_files(found))
        keys = {r["idempotency_key"] for r in found.join(asked, "idempotency_key", "left_semi").collect()}
        assert keys == {"k3", "k17"}
        assert ingest.ledger().count() == history
        runs = ingest._published("ledger").latest()[1]["runs"]
        assert sum(r["rows"] for r in runs) == history and all(len([r for r in runs if r["level"] == level]) < 3 for level in range(9))
    everything = len(_files(ingest.ledger()))
    assert files[600] <= files[60] + 3 and 10 * files[600] < everything


def test_ledger_runs_merge_and_forget(spark, ingest, monkeypatch):  # noqa: F811
    monkeypatch.setattr(stores, "FANOUT", 2)
    for batch in range(5):
        day = T0 + timedelta(days=batch)
        ingest.write("ledger", _claims(spark, [f"{batch}-{i}" for i in range(3)], day), "r", batch)
        ingest.commit("r", batch, accepted=3)
        if batch != 4:
            ingest.fold("ledger")
    assert ingest.ledger().count() == 15 and len(ingest.pending("ledger")) == 1
    since = (T0 + timedelta(days=2)).date()
    assert ingest.claims(ingest.ledger().select("idempotency_key"), since).count() == 9
    ingest.fold("ledger", drop_before=since)
    assert ingest.ledger().count() == 9 and not ingest.pending("ledger")
    ingest.vacuum()
    assert ingest.ledger().count() == 9


def test_rolled_commit_rows(spark, ingest, rollups, tmp_path):  # noqa: F811
    def aggregate(store, checkpoint):
        start_rollup(store, ingest, f"{tmp_path}/{checkpoint}", batches_per_trigger=2).awaitTermination()

    def whole(grain="minute"):
        return cell_rows(cells_from_events(ingest.log(), grain))

    slow = RollupStore(spark, f"{tmp_path}/rollups", consumer_id="slow")
    for batch in range(3):
        send(spark, ingest, [(f"k{batch}", M, 5, T0 + timedelta(days=9 * batch))], batch)
    aggregate(rollups, "c1")
    # What a consumer has not taken stays; nothing is lost for it.
    assert ingest.roll_commits([rollups.taken(), slow.taken()]) == 0
    assert ingest.roll_commits([rollups.taken()]) == 3
    assert not ingest._live_commits() and ingest.commits().count() == 3 and len(list(ingest.committed())) == 3
    assert ingest.is_committed("r1", 1)
    send(spark, ingest, [("k1", M, 5, T0), ("late", M2, 7, T0)], 3)
    aggregate(rollups, "c1")
    assert cell_rows(rollups.cells("minute")) == whole()
    assert rollups.roll_commits() > 0 and rollups.taken() == ingest.committed()
    # A consumer that comes later is caught up by day ranges, then follows the stream; once.
    for _ in range(2):
        aggregate(slow, "c2")
        assert cell_rows(slow.cells("minute")) == whole() and slow.read("markers").count() == 4
    assert ingest.roll_commits([rollups.taken(), slow.taken()]) == 1
    for name in ingest.tables:
        ingest.fold(name)
    ingest.vacuum()
    assert ingest.log().count() == 4 and ingest.commits().count() == 4


def test_a_rebuild_that_was_cut_short_goes_on(spark, ingest, rollups, tmp_path, monkeypatch):  # noqa: F811
    for batch, day in enumerate((0, 3, 6)):
        at = T0 + timedelta(days=day)
        send(spark, ingest, [(f"a{day}", M, day, at), (f"b{day}", M2, 1, None)], batch, now=at)
    fresh = RollupStore(spark, f"{tmp_path}/rollups", consumer_id="fresh")
    real, done = RollupStore.commit, []

    def failing(self, run_id, batch_id, **row):
        if len(done) == 2:
            raise Crash("second range")
        done.append(batch_id)
        return real(self, run_id, batch_id, **row)

    monkeypatch.setattr(RollupStore, "commit", failing)
    with pytest.raises(Crash):
        rebuild(fresh, ingest, days=2)
    monkeypatch.setattr(RollupStore, "commit", real)
    first = {r["src_batch"]: r["updated_at"] for r in fresh.commits().collect()}
    assert len(first) == 2  # the plan and one range
    send(spark, ingest, [("after", M, 1, T0)], 3, now=T0 + timedelta(days=6))  # committed later: not part of the plan
    rebuild(fresh, ingest, days=2)
    after = {r["src_batch"]: r["updated_at"] for r in fresh.commits().collect()}
    assert all(after[b] == at for b, at in first.items()) and len(after) == 5
    assert fresh.taken() == Batches({"r1": [[0, 2]]})
    planned = ingest.log(committed=Batches({"r1": [[0, 2]]}))
    for grain in ("minute", "day"):
        assert cell_rows(fresh.cells(grain)) == cell_rows(cells_from_events(planned, grain))
    with pytest.raises(ValueError):
        rebuild(fresh, ingest)


def test_a_snapshot_that_is_not_published_changes_nothing(spark, tmp_path, monkeypatch):
    snaps = SnapshotStore(spark, str(tmp_path))
    row = lambda m, d=0: spark.createDataFrame(
        [("i", m, 1, 5, T0, "daily", (T0 + timedelta(days=d)).date())], snaps.schema
    )
    snaps.write(row(M), "daily", T0.date())
    snaps.write(row(M, 1), "daily", (T0 + timedelta(days=1)).date())

    def crash(*_):
        raise Crash("publish")

    with monkeypatch.context() as patch:
        patch.setattr(Published, "publish", crash)
        with pytest.raises(Crash):
            snaps.write(row(M2), "daily", T0.date())
    assert {r["merchant_id"] for r in snaps.read().collect()} == {M}
    assert len(snaps.vacuum()) == 1 and snaps.read().count() == 2
    assert [str(r["period_start"]) for r in snaps.read("daily", 1).collect()] == [str((T0 + timedelta(days=1)).date())]
    assert snaps.read("weekly").isEmpty()
    # A writer that loses the race for a version publishes the next one and keeps the other's snapshot.
    real = Published.publish

    def raced(self, version, document):
        monkeypatch.setattr(Published, "publish", real)
        SnapshotStore(spark, str(tmp_path)).write(row(M, 2), "daily", (T0 + timedelta(days=2)).date())
        real(self, version, document)

    monkeypatch.setattr(Published, "publish", raced)
    snaps.write(row(M2), "daily", T0.date())
    assert snaps.read().count() == 3 and {r["merchant_id"] for r in snaps.read().collect()} == {M, M2}


def test_newest_events_and_pages_open_few_days(spark, ingest, monkeypatch):  # noqa: F811
    for day in range(6):
        now = T0 + timedelta(days=day)
        send(spark, ingest, [(f"k{day}-{i}", M, i, now) for i in range(4)], day, now=now)
        if day == 4:
            ingest.fold("log")
    log = ingest.log()
    for n in (1, 4, 9, 100):
        assert [r["id"] for r in ingest.recent(n).collect()] == [r["id"] for r in lag.recent_events(log, n).collect()]
    cursor, seen = None, []
    while page := ingest.page(cursor, 5).collect():
        assert page == lag.events_after(log, cursor, 5).collect()
        cursor = (page[-1]["created_at"], page[-1]["id"])
        seen += [r["id"] for r in page]
    assert len(seen) == len(set(seen)) == 24
    for name in ("log", "ledger"):
        ingest.fold(name)
    opened, real = [], ingest._base_files

    def recording(name, parts):
        opened.append(sorted(parts))
        return real(name, parts)

    monkeypatch.setattr(ingest, "_base_files", recording)
    assert ingest.recent(5).count() == 5 and ingest.page((T0 + timedelta(days=3), "~"), 3).count() == 3
    assert opened == [["2026-05-16", "2026-05-17"], ["2026-05-15", "2026-05-16"]]
