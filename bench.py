"""Headline timings on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and is then timed; its result goes to a sink that keeps
nothing, so all rows and columns are computed. ``read_*`` keys read rollup tables that
the streaming jobs built; ``scan_*`` keys compute the same kind of answer from the events.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from datetime import timedelta

import pyspark
from pyspark.sql import DataFrame

from paytally.functions.time import ts_lit, utc
from paytally.operators import metrics, rollup
from paytally.plans import nightly, queries
from paytally.session import local_session, shared_dir
from paytally.streaming.rollup import rollup_batch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "validate_accept",
    "missing_merchants",
    "dedup_accepted",
    "dedup_response",
    "rollup_minute",
    "rollup_hour",
    "rollup_day",
    "rollup_merge",
    "raw_metrics_24h",
    "metrics_hour",
    "success_rate",
    "merchant_metrics",
    "metrics_requests_join",
    "sparkline",
    "leaderboard_month",
    "leaderboard_increments",
    "leaderboard_snapshot",
    "leaderboard_history",
    "events_per_day",
    "late_events",
    "lag_histogram",
    "day_hour_discrepancy",
]
END = utc("2024-01-30 00:00")
RANGES = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=29)}
MERCHANT = 42


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build: Callable[[], DataFrame]) -> float:
    drain(build())
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        drain(build())
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 4)


def once(action: Callable[[], object]) -> tuple[float, object]:
    start = time.perf_counter()
    result = action()
    return round(time.perf_counter() - start, 4), result


def main() -> dict:
    spark = local_session(CPUS, "paytally-bench")
    results = {n: timed(lambda n=n: queries.REGISTRY[n](spark, SF_DIR)) for n in HEADLINE}

    root = shared_dir(spark, "bench")
    results["stream_ingest"], ingest = once(lambda: queries.run_ingest(spark, SF_DIR, root))
    results["stream_rollup"], store = once(lambda: queries.run_rollup(spark, ingest, root, "first"))
    results["stream_full_replay"], _ = once(lambda: queries.run_rollup(spark, ingest, root, "replay"))
    fresh = queries.RollupStore(spark, f"{root}/rollups", "long", "batch")
    results["rollup_batch_build"], _ = once(
        lambda: rollup_batch(fresh, ingest, ingest.commits(), "build", 0)
    )
    results["fold_tables"], _ = once(lambda: [store.fold(n) for n in store.tables])
    logged = ingest.log().count()

    events = queries.valid(spark, SF_DIR)
    for name, span in RANGES.items():
        start = END - span
        results[f"read_rollup_{name}"] = timed(
            lambda: nightly.metrics_from_store(store, start, END, MERCHANT)
        )
        results[f"scan_events_{name}"] = timed(
            lambda: rollup.raw_totals(events, ts_lit(start), ts_lit(END)).where(
                f"merchant_id = {MERCHANT}"
            )
        )
    results["read_rollup_all_merchants_7d"] = timed(
        lambda: metrics.success_rates(
            store.cells("hour", (END - RANGES["7d"]).date(), END.date()), END - RANGES["7d"], END
        )
    )
    results["read_board"] = timed(lambda: nightly.serve_leaderboard(store, "2024-01", 10))
    results["scan_events_board"] = timed(
        lambda: queries.leaderboard.leaderboard(rollup.cells_from_events(events, "day"), "2024-01")
    )
    return {
        "metric": "headline_total",
        "value": round(sum(results[n] for n in HEADLINE), 4),
        "unit": "sec",
        "queries": results,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "events_logged": logged,
        "rollup_events_per_sec": round(logged / results["rollup_batch_build"]),
        "cores": CPUS,
        "spark": pyspark.__version__,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "driver_memory": spark.conf.get("spark.driver.memory"),
    }


if __name__ == "__main__":
    with contextlib.redirect_stdout(sys.stderr):
        report = main()
    print(json.dumps(report))
