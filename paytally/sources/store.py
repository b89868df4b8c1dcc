"""Batch-committed Parquet tables.

Parquet has no transaction over several tables, so a batch becomes visible through one
commit row, written after all its files. Layout under a root::

    <table>/run_id=R/batch_id=N/<part>=V/...   files of one batch
    commit/run_id=R/batch_id=N/...             the row that publishes the batch
    rolled/<id>/...                            older commit rows, many in a file
    base/<table>/fold=<id>/<part>=V/...        batches merged by one ``fold``
    state/<table>/<version>.json               which folds are live, which batches they hold
    state/commit/<version>.json                which commit rows are rolled, and where

A retried batch overwrites its own paths. Readers see the newest base of every part plus
the committed batches not folded yet; files of a batch that never committed stay unseen.
What is live is settled by names and one JSON document a table (``state``): no Spark job
runs before a stored read. Every fold writes to a folder of its own and then publishes the next
version, so of two folds at once one is refused and neither touches the other's files.

A table with a ``key`` is looked up by it (the idempotency ledger). Its base is a few sorted
runs; a run's folders are prefixes of the key's digest, as many as its rows need. A fold writes
a new run and merges ``FANOUT`` runs of one size into one of the next, so a key is rewritten once a
size, and a lookup opens, of every run, the folders its keys fall into.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally import schemas
from paytally.functions.time import GRAINS, utc
from paytally.operators.lag import events_after, recent_events
from paytally.operators.rollup import merge_board, merge_cells
from paytally.session import use_utc
from paytally.sources.state import Batches, Conflict, Published, file_system

BATCH = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())]
)
FOLD = T.StructField("fold", T.StringType())
#: Runs of one size in a table with a key, before they are merged.
FANOUT = 8
#: Rows of a run for which one more folder level is not worth it.
PART_ROWS = 1_000_000
#: Files of rolled commit rows before they are merged.
ROLLED_FILES = 16


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    part: str
    sort: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame] | None = None
    key: str | None = None
    #: With a key: the date that bounds reads and retention.
    dated: str | None = None
    #: Few parts hold a whole batch: its rows are dealt to the writing tasks by the first sort column too.
    coarse: bool = False


class BatchStore:
    """A set of tables that commit together."""

    def __init__(
        self, spark: SparkSession, root: str, tables: list[Table], commit_schema: T.StructType
    ) -> None:
        self.spark = use_utc(spark)
        self.root = root.rstrip("/")
        self.tables = {t.name: t for t in tables}
        self.commit_schema = commit_schema
        for table in tables:
            for kind in ("", "base/", "state/"):
                self._make(f"{kind}{table.name}")
        for folder in ("commit", "state/commit"):
            self._make(folder)

    def _make(self, path: str) -> None:
        _make_folder(self.spark, f"{self.root}/{path}")

    # Batches

    def batch_path(self, name: str, run_id: str, batch_id: int) -> str:
        return f"{self.root}/{name}/run_id={run_id}/batch_id={batch_id}"

    def write(self, name: str, rows: DataFrame, run_id: str, batch_id: int) -> None:
        table = self.tables[name]
        if table.key:
            rows = rows.withColumn(table.part, _prefix(table, 0))
        self._write(table, rows, self.batch_path(name, run_id, batch_id))

    def _write(self, table: Table, rows: DataFrame, path: str) -> None:
        """One overwrite of an explicit path. Rebalancing by the part column writes few
        files per part and splits a part that holds much of the data, but only past 64 MB: one
        task would sort and write a coarse table's whole batch. Sorting lets row group statistics skip."""
        fields = [F.col(f.name).cast(f.dataType) for f in table.schema.fields]
        dealt = [table.part, table.sort[0]] if table.coarse else [table.part]
        writer = (
            rows.select(*fields)
            .hint("rebalance", *map(F.col, dealt))
            .sortWithinPartitions(table.part, *table.sort)
            .write.mode("overwrite")
            .partitionBy(table.part)
        )
        if table.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{table.key}", "true")
        writer.parquet(path)

    # Commits

    def _published(self, name: str) -> Published:
        return Published(self.spark, f"{self.root}/state/{name}")

    def _rolled(self) -> tuple[int, Batches, list[str]]:
        version, document = self._published("commit").latest()
        return version, Batches(document.get("batches")), document.get("files", [])

    def _live_commits(self) -> Batches:
        """Batches with a commit row of their own, by the names of its files: a torn write has none."""
        where, files = file_system(self.spark, f"{self.root}/commit/run_id=*/batch_id=*/part-*")
        names = [str(s.getPath().getParent()).rsplit("/", 2) for s in files.globStatus(where) or []]
        return Batches.of((n[1].removeprefix("run_id="), int(n[2].removeprefix("batch_id="))) for n in names)

    def is_committed(self, run_id: str, batch_id: int) -> bool:
        where, files = file_system(self.spark, f"{self.batch_path('commit', run_id, batch_id)}/part-*")
        return bool(files.globStatus(where)) or (run_id, batch_id) in self._rolled()[1]

    def commit(self, run_id: str, batch_id: int, **row) -> None:
        values = {"src_run": run_id, "src_batch": batch_id, **row}
        record = tuple(values.get(f.name) for f in self.commit_schema.fields)
        one = self.spark.createDataFrame([record], self.commit_schema).coalesce(1)
        one.write.mode("overwrite").parquet(self.batch_path("commit", run_id, batch_id))

    def commits(self) -> DataFrame:
        rolled, files = self._rolled()[1:]
        live = (
            self.spark.read.schema(self.commit_schema)
            .option("recursiveFileLookup", "true")
            .parquet(f"{self.root}/commit")
            .where(F.col("src_run").isNotNull())
        )
        if not files:
            return live
        # A roll-up that was cut short leaves rows in both places.
        live = live.where(~_among(F.col("src_run"), F.col("src_batch"), rolled))
        older = self.spark.read.schema(self.commit_schema).parquet(*(f"{self.root}/{f}" for f in files))
        return live.unionByName(older)

    def committed(self) -> Batches:
        """The batches committed so far. Reads and folds that are given one such set agree,
        whatever is committed meanwhile."""
        live = self._live_commits()  # first: a roll-up publishes before it deletes
        return self._rolled()[1] | live

    def roll_commits(self, taken: Iterable[Batches] = ()) -> int:
        """Move commit rows into one file, so that triggers list only the rows after them.

        Streams over the commit rows must have taken them before they go: ``taken`` has a set
        for each (``RollupStore.taken``), and what any of them lacks stays where it is. A stream's own
        position is in its checkpoint and is kept. Returns the number of batches moved.
        """
        version, rolled, files = self._rolled()
        ready = self._live_commits() - rolled
        for some in taken:
            ready = ready & some
        if not ready:
            return 0
        rows, kept = self.commits(), files
        moved = ready
        if len(files) >= ROLLED_FILES:
            moved, kept = ready | rolled, []
        target = f"rolled/{uuid.uuid4().hex}"
        chosen = rows.where(_among(F.col("src_run"), F.col("src_batch"), moved))
        chosen.repartition(1).write.parquet(f"{self.root}/{target}")
        document = {"batches": (rolled | ready).ranges, "files": [*kept, target]}
        self._published("commit").publish(version + 1, document)
        for run, batch in ready:
            _delete(self.spark, self.batch_path("commit", run, batch))
        return len(list(ready))

    def _files(self, name: str) -> DataFrame:
        schema = T.StructType([*self.tables[name].schema.fields, *BATCH.fields])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def read_batches(self, name: str, batches: list[tuple[str, int]]) -> DataFrame:
        """The files of named batches, without listing the rest of the table. The caller
        names only batches that have rows in it."""
        table = self.tables[name]
        if not batches:
            return self.spark.createDataFrame([], table.schema)
        schema = T.StructType([*table.schema.fields, *BATCH.fields])
        paths = [self.batch_path(name, run, batch) for run, batch in batches]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*paths).select(*table.schema.fieldNames())

    def read_batch(self, name: str, run_id: str, batch_id: int) -> DataFrame:
        """The files of one batch. Without rows an object store has no folder for it."""
        path = self.batch_path(name, run_id, batch_id)
        return _read_if_there(self.spark, self.tables[name].schema, path)

    # Folded tables

    def pending(self, name: str, committed: Batches | None = None) -> list[tuple[str, int]]:
        """Committed batches not folded into the table's base, kept few by regular folding."""
        return list(self._pending(self._published(name).latest()[1], committed))

    def _pending(self, state: dict, committed: Batches | None) -> Batches:
        return (self.committed() if committed is None else committed) - Batches(state.get("folded"))

    def base_state(self, name: str) -> tuple[dict[str, str], int]:
        """The fold that holds each live part (one entry per day or month), and the number
        the next version gets."""
        version, state = self._published(name).latest()
        return {p: v["fold"] for p, v in state.get("parts", {}).items()}, version + 1

    def base_parts(self, name: str) -> dict[str, int]:
        """The version that wrote each live part."""
        return {p: int(fold.split("-")[0]) for p, fold in self.base_state(name)[0].items()}

    def _base_files(self, name: str, parts: dict[str, str]) -> DataFrame:
        """Live parts: the conditions name folders only."""
        return self._folds(name, {f: [p for p in parts if parts[p] == f] for f in set(parts.values())})

    def _folds(self, name: str, chosen: dict[str, list[str] | None]) -> DataFrame:
        """Rows of folds; of each the named parts, or all of them."""
        table = self.tables[name]
        rows = self.spark.read.schema(T.StructType([*table.schema.fields, FOLD])).parquet(f"{self.root}/base/{name}")
        live = [
            (F.col("fold") == fold) & (F.lit(True) if parts is None else F.col(table.part).isin(sorted(parts)))
            for fold, parts in sorted(chosen.items())
        ]
        return rows.where(_either(live)).select(*table.schema.fieldNames())

    def _pending_files(self, name: str, batches: list[tuple[str, int]]) -> DataFrame:
        chosen = _either(
            [
                (F.col("run_id") == run)
                & F.col("batch_id").isin(sorted(b for r, b in batches if r == run))
                for run in sorted({r for r, _ in batches})
            ]
        )
        return self._files(name).where(chosen).select(*self.tables[name].schema.fieldNames())

    def read(
        self,
        name: str,
        start: date | str | None = None,
        end: date | str | None = None,
        committed: Batches | None = None,
    ) -> DataFrame:
        """Base and pending batches, merged. ``start``/``end`` (inclusive) prune parts.

        The conditions name partition columns only, so they are settled while planning.
        Without pending batches the base is returned as stored, with no shuffle.
        """
        table = self.tables[name]
        state = self._published(name).latest()[1]
        if table.key:
            return self._keyed_rows(table, state, committed, None).where(_between(F.col(table.dated), start, end))
        parts = {
            p: v["fold"]
            for p, v in state.get("parts", {}).items()
            if (start is None or p >= str(start)) and (end is None or p <= str(end))
        }
        base = self._base_files(name, parts)
        batches = list(self._pending(state, committed))
        if not batches:
            return base
        deltas = self._pending_files(name, batches).where(_between(F.col(table.part), start, end))
        rows = base.unionByName(deltas)
        return table.merge(rows).select(*table.schema.fieldNames()) if table.merge else rows

    def fold(
        self,
        name: str,
        replacement: DataFrame | None = None,
        parts: list[str] | None = None,
        drop_before: date | str | None = None,
        committed: Batches | None = None,
    ) -> int:
        """Merge pending batches into a new base version and return its number.

        Only parts that pending batches touch are rewritten. ``replacement`` supplies the
        whole content of ``parts``; it must come from reads of the same ``committed`` set,
        so that a batch committed meanwhile stays pending. Parts before ``drop_before`` are
        dropped. Raises ``Conflict`` if another fold of the table published meanwhile; its
        own files are then seen by no reader.
        """
        table = self.tables[name]
        published = self._published(name)
        version, state = published.latest()
        batches = self._pending(state, committed)
        target = f"{version + 1:06d}-{uuid.uuid4().hex}"
        path = f"{self.root}/base/{name}/fold={target}"
        if table.key:
            document = self._fold_keyed(table, state, batches, target, drop_before)
            published.publish(version + 1, document)
            return version + 1
        known = state.get("parts", {})
        part = F.col(table.part)
        deltas = self._pending_files(name, list(batches))
        touched = set(self._parts_of(name, batches))
        replaced = set(parts or [])
        dropped = {
            p for p in touched | set(known) if drop_before is not None and p < str(drop_before)
        }
        merged = touched - replaced - dropped
        old = {p: v["fold"] for p, v in known.items() if p in merged}
        rows = self._base_files(name, old).unionByName(deltas.where(part.isin(sorted(merged))))
        rows = table.merge(rows) if table.merge else rows
        rows = rows.select(*table.schema.fieldNames())
        if replacement is not None:
            rows = rows.unionByName(
                replacement.where(part.isin(sorted(replaced))).select(*table.schema.fieldNames())
            )
        self._write(table, rows, path)
        first = F.col(table.sort[0])
        written = _read_if_there(self.spark, table.schema, path).groupBy(part.cast("string").alias("part")).agg(
            F.count("*").alias("rows"), F.min(first).cast("string").alias("low"), F.max(first).cast("string").alias("high")
        )
        live = {p: v for p, v in known.items() if p not in dropped | replaced}
        for r in written.collect():  # a row per day or month
            live[r["part"]] = {"fold": target, "rows": r["rows"], "low": r["low"], "high": r["high"]}
        folded = Batches(state.get("folded")) | batches
        published.publish(version + 1, {"parts": live, "folded": folded.ranges})
        return version + 1

    def _parts_of(self, name: str, batches: Batches) -> list[str]:
        """Part values of batches, by the names of their folders."""
        found = set()
        for run, batch in batches:
            for folder in _children(self.spark, self.batch_path(name, run, batch), f"{self.tables[name].part}="):
                found.add(folder.rsplit("=", 1)[1])
        return sorted(found)

    # Tables with a key

    def _fold_keyed(self, table: Table, state: dict, batches: Batches, target: str, drop_before) -> dict:
        runs = state.get("runs", [])
        folded = (Batches(state.get("folded")) | batches).ranges
        deltas = self._pending_files(table.name, list(batches))
        level, absorbed = 0, []
        while len(same := [r for r in runs if r["level"] == level]) >= FANOUT - 1:
            absorbed += same
            level += 1
        if drop_before is not None:  # every run may hold rows of any date
            absorbed, level = runs, max([level, *(r["level"] for r in runs)])
        kept = [r for r in runs if r not in absorbed]
        rows = deltas.unionByName(self._folds(table.name, {r["fold"]: None for r in absorbed}))
        if drop_before is not None:
            rows = rows.where(F.col(table.dated) >= F.lit(str(drop_before)).cast("date"))
        n, last = rows.agg(F.count("*"), F.max(table.dated)).first()
        if not n:
            return {"runs": kept, "folded": folded}
        depth = max(0, math.ceil(math.log(n / PART_ROWS, 16)))
        rows = rows.withColumn(table.part, _prefix(table, depth))
        self._write(table, rows, f"{self.root}/base/{table.name}/fold={target}")
        run = {"fold": target, "level": level, "rows": n, "depth": depth, "last": str(last)}
        return {"runs": [*kept, run], "folded": folded}

    def _keyed_rows(self, table: Table, state: dict, committed, keys: DataFrame | None, since=None) -> DataFrame:
        runs = [r for r in state.get("runs", []) if since is None or r["last"] >= str(since)]
        depth = max((r["depth"] for r in runs), default=0)
        prefixes = None
        if keys is not None and depth:  # no more than the folders of the largest run
            prefixes = {r[0] for r in keys.select(_prefix(table, depth)).distinct().collect()}
        chosen = {
            r["fold"]: None if prefixes is None or not r["depth"] else sorted({p[: r["depth"]] for p in prefixes if p})
            for r in runs
        }
        rows = self._folds(table.name, chosen)
        batches = list(self._pending(state, committed))
        return rows.unionByName(self._pending_files(table.name, batches)) if batches else rows

    def lookup(self, name: str, keys: DataFrame, since: date | None = None) -> DataFrame:
        """Stored rows that can have one of the keys, since a date if given: of every run the folders of
        the keys' prefixes, and the pending batches. The caller joins them with the keys."""
        table = self.tables[name]
        rows = self._keyed_rows(table, self._published(name).latest()[1], None, keys, since)
        return rows.where(_between(F.col(table.dated), since, None))

    # Clean-up. Only with no writer or reader running.

    def vacuum(self) -> list[str]:
        """Delete what no reader can see: files of uncommitted batches, folded batches
        and superseded base parts. Returns the deleted paths."""
        committed = self.committed()
        doomed = []
        for name, table in self.tables.items():
            published = self._published(name)
            state = published.latest()[1]
            folded = Batches(state.get("folded"))
            for run in _children(self.spark, f"{self.root}/{name}", "run_id="):
                for batch in _children(self.spark, run, "batch_id="):
                    key = (run.rsplit("run_id=", 1)[1], int(batch.rsplit("batch_id=", 1)[1]))
                    if key not in committed or key in folded:
                        doomed.append(batch)
            live = {(v["fold"], p) for p, v in state.get("parts", {}).items()}
            runs = {r["fold"] for r in state.get("runs", [])}
            for fold in _children(self.spark, f"{self.root}/base/{name}", "fold="):
                number = fold.rsplit("fold=", 1)[1]
                if number not in runs | {f for f, _ in live}:
                    doomed.append(fold)
                elif not table.key:
                    folders = _children(self.spark, fold, f"{table.part}=")
                    doomed += [f for f in folders if (number, f.rsplit("=", 1)[1]) not in live]
            published.prune()
        files = self._rolled()[2]
        doomed += [f for f in _children(self.spark, f"{self.root}/rolled", "") if f.removeprefix(f"{self.root}/") not in files]
        self._published("commit").prune()
        for path in doomed:
            _delete(self.spark, path)
        return doomed


def _make_folder(spark: SparkSession, path: str) -> None:
    where, files = file_system(spark, path)
    files.mkdirs(where)


def _read_if_there(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    where, files = file_system(spark, path)
    if files.exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _either(conditions: list[Column]) -> Column:
    chosen = F.lit(False)
    for condition in conditions:
        chosen = chosen | condition
    return chosen


def _between(column: Column, start, end) -> Column:
    condition = F.lit(True)
    if start is not None:
        condition = condition & (column >= F.lit(start))
    if end is not None:
        condition = condition & (column <= F.lit(end))
    return condition


def _among(run: Column, batch: Column, batches: Batches) -> Column:
    return _either([(run == r) & batch.between(first, last) for r, first, last in batches.rows()])


def _time_text(at: datetime) -> str:
    """A time as Spark writes it, so that texts compare as times do."""
    return utc(at).strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".")


def _prefix(table: Table, depth: int) -> Column:
    """The folder of a key in a run of so many levels: hexadecimal digits of the key's digest."""
    return F.substring(F.md5(F.col(table.key)), 1, depth) if depth else F.lit("all")


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    where, files = file_system(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
    return sorted(f"{path}/{n}" for n in names if n.startswith(prefix))


def _delete(spark: SparkSession, path: str) -> None:
    where, files = file_system(spark, path)
    files.delete(where, True)


class IngestStore(BatchStore):
    """Event log, idempotency ledger, quarantine and responses."""

    def __init__(self, spark: SparkSession, root: str, merchant_kind: str = "uuid") -> None:
        self.merchant_kind = merchant_kind
        super().__init__(
            spark,
            root,
            [
                Table("log", schemas.event_log(merchant_kind), "occurred_date", ("created_at", "id")),
                Table(
                    "ledger", schemas.LEDGER, "key_part", ("idempotency_key",),
                    key="idempotency_key", dated="created_date", coarse=True,
                ),
                Table(
                    "quarantine",
                    schemas.quarantine(merchant_kind),
                    "quarantined_date",
                    ("merchant_id",),
                    coarse=True,
                ),
                Table("responses", schemas.RESPONSES, "received_date", ("idempotency_key",), coarse=True),
            ],
            schemas.INGEST_COMMIT,
        )

    def log(self, start: date | None = None, end: date | None = None, committed: Batches | None = None) -> DataFrame:
        return self.read("log", start, end, committed)

    def days(self, committed: Batches | None = None) -> list[date]:
        """Days the log has folders for: of its base and of the batches not folded yet."""
        state = self._published("log").latest()[1]
        pending = self._parts_of("log", self._pending(state, committed))
        return [date.fromisoformat(p) for p in sorted({*state.get("parts", {}), *pending})]

    def ledger(self, since: date | None = None) -> DataFrame:
        """All claims, or those since a date when the user accepts a bounded horizon."""
        return self.read("ledger", start=since)

    def claims(self, keys: DataFrame, since: date | None = None) -> DataFrame:
        """Claims among which the keys' are: what a batch reads of the ledger follows its keys, not the history."""
        return self.lookup("ledger", keys, since)

    def recent(self, n: int) -> DataFrame:
        """The newest ``n`` events, from the newest days that hold so many and the batches not folded yet."""
        version, state = self._published("log").latest()
        first, rows = None, 0
        for part, about in sorted(state.get("parts", {}).items(), reverse=True):
            first, rows = part, rows + about["rows"]
            if rows >= n:
                break
        return recent_events(self.log(first if rows >= n else None), n)

    def page(self, cursor: tuple[datetime, object] | None = None, n: int = schemas.DEFAULT_PAGE) -> DataFrame:
        """The next ``n`` events past the cursor, by the times of creation that each day's folder spans.

        Days that end before the cursor are left out, and so are days that begin after a time by which
        the others already hold ``n`` events past it.
        """
        table, state = self.tables["log"], self._published("log").latest()[1]
        parts, since = state.get("parts", {}), "" if cursor is None else _time_text(cursor[0])
        open_ = {p: v for p, v in parts.items() if v["high"] >= since}
        rows, until = 0, None
        for about in sorted((v for v in open_.values() if v["low"] > since), key=lambda v: v["high"]):
            rows += about["rows"]
            if rows >= n:
                until = about["high"]
                break
        chosen = {p: v["fold"] for p, v in open_.items() if until is None or v["low"] <= until}
        log = self._base_files("log", chosen)
        batches = list(self._pending(state, None))
        if batches:
            log = log.unionByName(self._pending_files("log", batches).select(*table.schema.fieldNames()))
        return events_after(log, cursor, n)


class RollupStore(BatchStore):
    """Rollups, markers, boards and late events of one consumer.

    Markers are per consumer while the cells are sums, so each consumer owns its tables;
    two consumers sharing them would count every event twice.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        merchant_kind: str = "uuid",
        consumer_id: str = schemas.DEFAULT_CONSUMER,
    ) -> None:
        self.merchant_kind = merchant_kind
        self.consumer_id = consumer_id
        order = ("merchant_id", "bucket")
        cells = [
            Table(
                g, schemas.cells(merchant_kind, g), schemas.CELL_PART[g], order, merge_cells,
                coarse=schemas.CELL_PART[g] == "bucket_month",
            )
            for g in GRAINS
        ]
        super().__init__(
            spark,
            f"{root.rstrip('/')}/consumer={consumer_id}",
            [
                Table("markers", schemas.MARKER, "occurred_date", ("event_id",)),
                *cells,
                Table("board", schemas.board(merchant_kind), "period", ("merchant_id",), merge_board, coarse=True),
                Table("late", schemas.late_events(merchant_kind), "event_date", ("event_id",)),
            ],
            schemas.ROLLUP_COMMIT,
        )

    def taken(self) -> Batches:
        """Batches of the log this consumer has aggregated, by its commit rows."""
        rows = self.commits().select(F.explode("taken").alias("range")).select("range.*").distinct()
        return Batches.of_rows(rows.collect())  # ranges: a stream's batches are consecutive

    def cells(
        self,
        grain: str,
        start: date | None = None,
        end: date | None = None,
        committed: Batches | None = None,
    ) -> DataFrame:
        """Cells of the days ``start..end``, read from their folders only."""
        if schemas.CELL_PART[grain] == "bucket_month":
            months = start and f"{start:%Y-%m}", end and f"{end:%Y-%m}"
            rows = self.read(grain, *months, committed=committed)
        else:
            rows = self.read(grain, start, end, committed)
        return rows.where(_between(F.to_date("bucket"), start, end))


class SnapshotStore:
    """Leaderboard snapshots keyed (period, period_start, merchant).

    A snapshot is written aside and then published by a pointer from its period to its folder, so
    a crash in between leaves the former one readable, and a reader sees one or the other whole.
    """

    def __init__(self, spark: SparkSession, root: str, merchant_kind: str = "uuid") -> None:
        self.spark = use_utc(spark)
        self.path = f"{root.rstrip('/')}/snapshots"
        self.schema = schemas.snapshots(merchant_kind)
        for folder in ("data", "state"):
            _make_folder(self.spark, f"{self.path}/{folder}")
        self.pointers = Published(self.spark, f"{self.path}/state")

    def write(self, rows: DataFrame, period: str, period_start: date) -> None:
        """Replace one snapshot; merchants that left the top 100 go with the old files."""
        self._replace(rows.withColumns({"period": F.lit(period), "period_start": F.lit(period_start)}), (period, str(period_start)))

    def write_all(self, rows: DataFrame) -> None:
        """Replace every snapshot that occurs in ``rows``, all by one publication."""
        self._replace(rows, None)

    def _replace(self, rows: DataFrame, one: tuple[str, str] | None) -> None:
        folder = uuid.uuid4().hex
        names = [f.name for f in self.schema.fields]
        dealt = rows.select(*names).hint("rebalance", F.col("period"), F.col("period_start"))
        dealt.write.partitionBy("period", "period_start").parquet(f"{self.path}/data/{folder}")
        written = [
            (period.rsplit("=", 1)[1], start.rsplit("=", 1)[1])
            for period in _children(self.spark, f"{self.path}/data/{folder}", "period=")
            for start in _children(self.spark, period, "period_start=")
        ]
        while True:  # snapshots of other periods that are published meanwhile are kept
            version, state = self.pointers.latest()
            known = {k: v for k, v in state.get("folders", {}).items() if one is None or k != "/".join(one)}
            known |= {f"{period}/{start}": folder for period, start in written}
            try:
                self.pointers.publish(version + 1, {"folders": known})
                return
            except Conflict:
                continue

    def read(self, period: str | None = None, newest: int | None = None) -> DataFrame:
        """Published snapshots: of one period if named, and of that only the newest so many."""
        keys = sorted((k.split("/") + [f] for k, f in self.pointers.latest()[1].get("folders", {}).items()), reverse=True)
        keys = [k for k in keys if period is None or k[0] == period]
        if newest is not None:
            keys = [k for i, k in enumerate(keys) if sum(x[0] == k[0] for x in keys[:i]) < newest]
        if not keys:
            return self.spark.createDataFrame([], self.schema)
        by_folder: dict[str, list[str]] = {}
        for p, start, folder in keys:
            by_folder.setdefault(folder, []).append(f"{self.path}/data/{folder}/period={p}/period_start={start}")
        parts = [
            self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data/{folder}").parquet(*paths)
            for folder, paths in sorted(by_folder.items())
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.where(F.col("merchant_id").isNotNull())

    def vacuum(self) -> list[str]:
        """Delete the folders no pointer names. Only with no writer or reader running."""
        live = set(self.pointers.latest()[1].get("folders", {}).values())
        doomed = [f for f in _children(self.spark, f"{self.path}/data", "") if f.rsplit("/", 1)[1] not in live]
        for path in doomed:
            _delete(self.spark, path)
        self.pointers.prune()
        return doomed
