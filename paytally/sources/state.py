"""Published state of stored tables: one small JSON document a version.

A version is written aside and moved to its name, which fails if the name is taken, as Spark's own
streaming log does. So of two writers that start from the same version one publishes and the other is
refused, and a reader never sees half a document. Reading the state runs no Spark job. A store without
an atomic rename needs a committer that gives it one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer published this version first."""


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Published:
    """The versions of one document in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def versions(self) -> list[int]:
        where, files = file_system(self.spark, f"{self.folder}/[0-9]*.json")
        return sorted(int(s.getPath().getName()[:12]) for s in files.globStatus(where) or [])

    def latest(self) -> tuple[int, dict]:
        """The newest version and its document; -1 and an empty one before the first."""
        found = self.versions()
        if not found:
            return -1, {}
        where, files = file_system(self.spark, self._name(found[-1]))
        stream = files.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return found[-1], json.loads(text)

    def publish(self, version: int, document: dict) -> None:
        """Publish ``version``, which must follow the one the writer started from."""
        aside, files = file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}")
        stream = files.create(aside, True)
        stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        keep = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(keep, 1)
        options[0] = keep.NONE
        where = jvm.org.apache.hadoop.fs.Path(self._name(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, where, options)
        except Exception as error:
            files.delete(aside, False)
            if files.exists(where):
                raise Conflict(f"another writer published {self._name(version)}") from error
            raise

    def prune(self) -> None:
        """Delete the documents before the newest one."""
        for version in self.versions()[:-1]:
            where, files = file_system(self.spark, self._name(version))
            files.delete(where, False)


class Batches:
    """A set of ``(run id, batch number)``, held as ranges: streams number their batches consecutively."""

    def __init__(self, ranges: dict[str, list[list[int]]] | None = None) -> None:
        self.ranges = {run: [list(r) for r in some] for run, some in (ranges or {}).items() if some}

    @classmethod
    def of(cls, pairs: Iterable[tuple[str, int]]) -> Batches:
        out = cls()
        for run, batch in sorted(set(pairs)):
            some = out.ranges.setdefault(run, [])
            if some and some[-1][1] == batch - 1:
                some[-1][1] = batch
            else:
                some.append([batch, batch])
        return out

    @classmethod
    def of_rows(cls, rows: Iterable) -> Batches:
        """From structs ``(run_id, first, last)``, in any order, that may overlap."""
        out = cls()
        for row in rows:
            out = out | cls({row["run_id"]: [[row["first"], row["last"]]]})
        return out

    def rows(self) -> list[tuple[str, int, int]]:
        return [(run, first, last) for run, some in sorted(self.ranges.items()) for first, last in some]

    def __contains__(self, batch: tuple[str, int]) -> bool:
        return any(first <= batch[1] <= last for first, last in self.ranges.get(batch[0], ()))

    def __iter__(self) -> Iterator[tuple[str, int]]:
        for run, first, last in self.rows():
            yield from ((run, batch) for batch in range(first, last + 1))

    def __bool__(self) -> bool:
        return bool(self.ranges)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Batches) and self.ranges == other.ranges

    def __or__(self, other: Batches) -> Batches:
        out = {}
        for run in {*self.ranges, *other.ranges}:
            merged: list[list[int]] = []
            for first, last in sorted([*self.ranges.get(run, []), *other.ranges.get(run, [])]):
                if merged and first <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            out[run] = merged
        return Batches(out)

    def __sub__(self, other: Batches) -> Batches:
        out = {}
        for run, some in self.ranges.items():
            left = [list(r) for r in some]
            for low, high in other.ranges.get(run, []):
                cut = []
                for first, last in left:
                    cut += [[first, min(last, low - 1)], [max(first, high + 1), last]] if first <= high and low <= last else [[first, last]]
                left = [r for r in cut if r[0] <= r[1]]
            out[run] = left
        return Batches(out)

    def __and__(self, other: Batches) -> Batches:
        return self - (self - other)
