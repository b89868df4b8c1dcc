"""The jobs as running streams over files that keep arriving."""

from __future__ import annotations

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import GHOST, M, M2, T0, cell_rows, merchants
from paytally.operators import dedup, lag
from paytally.operators.rollup import cells_from_events
from paytally.sources.readers import stream_producer_json
from paytally.sources.store import IngestStore, RollupStore
from paytally.streaming.ingest import start_ingest
from paytally.streaming.rollup import start_rollup


def drop_file(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"event_type": t, "merchant_id": m, "amount_cents": a, "idempotency_key": k,
                    "client_timestamp": c.isoformat() if c else None})
        for k, m, a, c, t in rows
    ]
    (folder / f"{number:03}.json").write_text("\n".join(lines))


def traffic(seed, files, per_file):
    """Skewed merchants, late and repeated events, some invalid."""
    rng = random.Random(seed)
    sent = []
    for _ in range(files):
        rows = []
        for _ in range(per_file):
            if sent and rng.random() < 0.2:
                rows.append(rng.choice(sent))
                continue
            late = timedelta(seconds=rng.choice([0, 0, 0, 200, 90000]))
            row = (
                f"key-{len(sent)}-{rng.random()}",
                rng.choices([M, M2, GHOST], [70, 25, 5])[0],
                rng.choice([rng.randrange(5000), rng.randrange(5000), -1]),
                T0 - late if rng.random() < 0.8 else None,
                rng.choice(["PAYMENT_CONFIRMED", "PAYMENT_FAILED", "PAYMENT_INITIATED"]),
            )
            sent.append(row)
            rows.append(row)
        yield rows

pytestmark = pytest.mark.usefixtures("interpreted")


class Jobs:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.inbox = root / "inbox"
        self.ingest = IngestStore(spark, f"{root}/ingest")
        self.rollups = RollupStore(spark, f"{root}/rollups")

    def run_ingest(self, checkpoint="i1"):
        stream = stream_producer_json(self.spark, str(self.inbox), files_per_batch=2)
        start_ingest(
            self.ingest, stream, merchants(self.spark), f"{self.root}/ck-{checkpoint}"
        ).awaitTermination()

    def run_rollup(self, checkpoint="r1"):
        query = start_rollup(
            self.rollups, self.ingest, f"{self.root}/ck-{checkpoint}", batches_per_trigger=2
        )
        query.awaitTermination()
        return query

    def check(self):
        log = self.ingest.log()
        for grain in ("minute", "day"):
            assert cell_rows(self.rollups.cells(grain)) == cell_rows(cells_from_events(log, grain))
        keys = log.agg(F.count("*"), F.countDistinct("idempotency_key"), F.countDistinct("id"))
        assert len(set(keys.first())) == 1


def test_streams_with_replay_and_abandoned_checkpoints(spark, tmp_path, monkeypatch):
    jobs = Jobs(spark, tmp_path)
    batches = list(traffic(1, 4, 30))
    for number, rows in enumerate(batches[:3]):
        drop_file(jobs.inbox, number, rows)
    jobs.run_ingest()
    jobs.run_rollup()
    jobs.check()
    assert jobs.ingest.commits().count() == 2
    before = cell_rows(jobs.rollups.cells("hour"))
    # A second rollup run from zero changes nothing.
    jobs.run_rollup("r2")
    assert cell_rows(jobs.rollups.cells("hour")) == before
    # More input on the same checkpoints is added.
    drop_file(jobs.inbox, 3, batches[3])
    jobs.run_ingest()
    jobs.run_rollup()
    jobs.check()
    valid = {
        r[0] for rows in batches for r in rows if r[2] >= 0 and r[1] != GHOST
    }
    assert jobs.ingest.log().count() == len(valid)
    # An ingest run from zero re-sends every event: all keys are taken.
    jobs.run_ingest("i2")
    jobs.run_rollup()
    jobs.check()
    assert jobs.ingest.log().count() == len(valid)
    runs = jobs.ingest.commits().select("src_run").distinct().count()
    assert runs == 2


def test_stream_crash_between_writes_recovers(spark, tmp_path, monkeypatch):
    jobs = Jobs(spark, tmp_path)
    for number, rows in enumerate(traffic(2, 3, 20)):
        drop_file(jobs.inbox, number, rows)
    jobs.run_ingest()
    real = RollupStore.write

    def failing(self, name, *args):
        if name == "hour":
            raise RuntimeError("lost")
        real(self, name, *args)

    monkeypatch.setattr(RollupStore, "write", failing)
    with pytest.raises(Exception, match="lost"):
        jobs.run_rollup()
    monkeypatch.setattr(RollupStore, "write", real)
    assert jobs.rollups.cells("minute").isEmpty()
    jobs.run_rollup()
    jobs.check()


def test_bounded_horizon_dedup_stream(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=i)) for i, k in enumerate("aaaaabacaada" * 3)]
    table = spark.createDataFrame(rows, "idempotency_key string, occurred_at timestamp")
    table.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(
        f"{tmp_path}/in"
    )
    (
        dedup.stream_first_per_key(stream, "1 day", salts=4)
        .writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True)
        .start().awaitTermination()
    )
    passed = [r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("idempotency_key").collect()]
    assert sorted(passed) == ["a", "b", "c", "d"]


def test_ingestion_rate_as_a_stream(spark, tmp_path):
    rows = [(i, T0 + timedelta(milliseconds=400 * i)) for i in range(10)]
    table = spark.createDataFrame(rows, "id int, occurred_at timestamp")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    rate = lag.ingestion_rate(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    query = (
        rate.writeStream.format("memory").queryName("rate_per_second").outputMode("complete")
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    streamed = {(r[0], r[1]) for r in spark.table("rate_per_second").collect()}
    assert streamed == {(r[0], r[1]) for r in lag.ingestion_rate(table).collect()}
    assert sorted(n for _, n in streamed) == [2, 2, 3, 3]
