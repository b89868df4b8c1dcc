"""Producer events and merchants, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally import schemas
from paytally.session import use_utc

CORRUPT = schemas.CORRUPT


def _json_schema() -> T.StructType:
    return T.StructType([*schemas.PRODUCER_EVENT.fields, T.StructField(CORRUPT, T.StringType())])


def read_producer_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of producer events. A line that does not parse keeps its text in
    ``_corrupt_record`` and nulls elsewhere, so validation quarantines it."""
    return use_utc(spark).read.schema(_json_schema()).option("mode", "PERMISSIVE").json(path)


def stream_producer_json(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        use_utc(spark)
        .readStream.schema(_json_schema())
        .option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def read_producer_parquet(spark: SparkSession, path: str) -> DataFrame:
    return use_utc(spark).read.schema(schemas.PRODUCER_EVENT).parquet(path)


def stream_producer_parquet(
    spark: SparkSession, path: str, files_per_batch: int = 1000
) -> DataFrame:
    return (
        use_utc(spark)
        .readStream.schema(schemas.PRODUCER_EVENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def corrupt_lines(events: DataFrame) -> DataFrame:
    return events.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_merchants(spark: SparkSession, path: str, kind: str = "uuid") -> DataFrame:
    """The merchant dimension. Joins decide on a broadcast by its size."""
    return use_utc(spark).read.schema(schemas.merchants(kind)).parquet(path)
