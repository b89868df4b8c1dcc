"""Driver tables read as payment events and merchants.

Their ``timestamp_ntz`` columns become UTC ``timestamp`` on read, since
``date_trunc`` and the streaming operators work on the latter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytally.functions.measures import as_uuid
from paytally.session import use_utc

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The events table as a stream. The braces make the path a pattern, so that a
    single file and a directory of files both work."""
    return (
        use_utc(spark)
        .readStream.schema(EVENTS_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{sf_dir}/{{events}}.parquet")
    )


def events_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the event files that keep arriving under a folder."""
    reader = use_utc(spark).readStream.schema(EVENTS_SCHEMA).option("recursiveFileLookup", "true")
    return reader.parquet(folder)


def in_time_order(events: DataFrame, pieces: int) -> list[DataFrame]:
    """The events cut into spans of equal length, oldest first."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [events]
    bounds = [first + (last - first) * k / pieces for k in range(1, pieces)]
    spans = zip([None, *bounds], [*bounds, None])
    ts = F.col("ts")
    return [
        events.where((F.lit(True) if low is None else ts >= F.lit(low)) & (F.lit(True) if high is None else ts < F.lit(high)))
        for low, high in spans
    ]


def payments_from_events(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("merchant_id"),
        F.when(kind == "purchase", "PAYMENT_CONFIRMED")
        .when(kind == "error", "PAYMENT_FAILED")
        .when(kind == "click", "PAYMENT_INITIATED")
        .otherwise(F.upper(kind))
        .alias("event_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 11 == 0, "usd")
        .otherwise("EUR")
        .alias("currency"),
        F.concat_ws("-", F.col("user_id"), kind, F.to_date(ts)).alias(
            "idempotency_key"
        ),
        ts.alias("occurred_at"),
        F.when(F.col("event_id") % 20 == 0, ts - F.expr("INTERVAL 300 SECOND"))
        .when(F.col("event_id") % 3 == 0, F.lit(None).cast("timestamp"))
        .otherwise(ts)
        .alias("client_timestamp"),
        F.col("props").alias("metadata"),
    )


def payments_from_orders(orders: DataFrame) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("merchant_id"),
        F.when(status == "F", "PAYMENT_CONFIRMED")
        .when(status == "P", "PAYMENT_FAILED")
        .otherwise("PAYMENT_INITIATED")
        .alias("event_type"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_cents"),
        F.lit("EUR").alias("currency"),
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("idempotency_key"),
        ts.alias("occurred_at"),
        F.lit(None).cast("timestamp").alias("client_timestamp"),
        F.lit(None).cast("string").alias("metadata"),
    )


def producer_feed_from_customers(customer: DataFrame) -> DataFrame:
    """Opening balances sent as events with UUID merchants. The balances, segments and
    nations make every kind of invalid input occur."""
    segment = F.col("c_mktsegment")
    return customer.select(
        F.when(segment == "AUTOMOBILE", "PAYMENT_REVERSED")
        .otherwise("PAYMENT_INITIATED")
        .alias("event_type"),
        F.when(segment == "MACHINERY", F.col("c_name"))
        .when(segment == "BUILDING", F.upper(as_uuid(F.col("c_name"))))
        .otherwise(as_uuid(F.col("c_name")))
        .alias("merchant_id"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("amount_cents"),
        F.when(F.col("c_nationkey") < 3, "euro")
        .when(F.col("c_nationkey") < 6, "gbp")
        .alias("currency"),
        F.when(F.col("c_nationkey") == 7, "")
        .when(F.col("c_nationkey") == 8, F.repeat(F.col("c_name"), 15))
        .otherwise(F.col("c_name"))
        .alias("idempotency_key"),
        F.lit(None).cast("timestamp").alias("client_timestamp"),
        F.when(F.col("c_nationkey") == 9, F.lit("{broken"))
        .when(F.col("c_nationkey") == 10, F.lit("[1, 2]"))
        .otherwise(F.concat(F.lit('{"segment": "'), segment, F.lit('"}')))
        .alias("metadata"),
    )


def merchants_from_customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("merchant_id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def registered_merchants(customer: DataFrame) -> DataFrame:
    """Merchants proper: households are customers but no merchants."""
    return merchants_from_customers(customer.where(F.col("c_mktsegment") != "HOUSEHOLD"))
