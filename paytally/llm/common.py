"""Words, shared tables and Arrow batches used by several operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import paytally
from paytally.session import shared_dir

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_LOWER = {upper: upper + 32 for upper in range(0x41, 0x5B)}
_TO_WORDS = bytes(_LOWER.get(b, b if b in _KEPT else 0x20) for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8. Null has none."""
    return (text or "").encode().translate(_TO_WORDS).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8. Null has none."""
    return (text or "").encode().lower().split()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of ``saved`` tables that nothing reads any more."""
    for df in tables:
        folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}  # of one folder each; none if empty
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """Only the id columns and the text, which is named ``text``; further columns never reach Python."""
    return docs.select(*ids, F.col(text).cast("string").alias("text"))


def per_batch(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema):
    """A ``mapInArrow`` function from column lists to column lists, with bounded output batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                columns = fn({name: part.column(name).to_pylist() for name in part.schema.names})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[field.name], field.type) for field in schema], schema=schema
                )

    return run


#: Rows handled in Python at once: bounds what a batch of long texts needs.
ROWS_AT_ONCE = 1000


def crc32_of(column: str):
    """Unsigned CRC-32 of a column written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors once per application, for sessions started without it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="paytally-code-")  # the driver serves it as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(paytally.__file__).parent
        context.addPyFile(shutil.make_archive(f"{folder}/paytally", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return spark
