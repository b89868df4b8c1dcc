"""First-writer-wins deduplication by a global idempotency key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.functions.measures import as_uuid
from paytally.operators.joins import lookup_join

KEY = "idempotency_key"


def with_event_id(events: DataFrame) -> DataFrame:
    return events.withColumn("event_id", as_uuid(F.col(KEY)))


def first_per_key(events: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, one shuffle.

    An aggregate rather than ``row_number``: every map task sends one row per key, so
    a key holding a third of the batch does not land in one task.
    """
    rest = [c for c in events.columns if c != KEY]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return events.groupBy(KEY).agg(first).select(KEY, "_first.*").select(*events.columns)


def existing_claims(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of the submitted keys. Both sides hold a key once; Catalyst sends
    the smaller one (usually the batch) to the other, or filters the ledger by a
    runtime Bloom filter before its shuffle."""
    claims = ledger.select(KEY, "event_id", "occurred_at")
    return claims.join(keys.select(KEY).distinct(), KEY, "left_semi")


def claim(events: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Rows that win their key: first within the batch, and not yet in the ledger. Ids
    are derived last, so that the shuffle does not carry them."""
    firsts = first_per_key(events, order)
    taken = existing_claims(firsts, ledger).select(KEY)
    return with_event_id(firsts.join(taken, KEY, "left_anti"))


def claim_rows(claimed: DataFrame, claim_date: Column) -> DataFrame:
    return claimed.select(KEY, "event_id", "occurred_at", claim_date.alias("created_date"))


def responses(
    events: DataFrame, ledger: DataFrame, order: list[str]
) -> DataFrame:
    """One row per submitted row: the original's id and arrival, and whether it repeats.

    The winning position is a slim per-key aggregate; only that is joined back, with
    the rows of hot keys split over tasks.
    """
    position = F.struct(*order)
    winners = events.groupBy(KEY).agg(
        F.min(position).alias("_position"),
        F.min_by("occurred_at", position).alias("_occurred_at"),
    )
    claims = ledger.select(
        KEY,
        F.col("event_id").alias("_ledger_id"),
        F.col("occurred_at").alias("_ledger_at"),
    ).join(winners.select(KEY), KEY, "left_semi")
    originals = winners.join(claims, KEY, "left")
    submitted = events.withColumn("_own", position)
    joined = lookup_join(submitted, originals, [KEY], "left")
    fresh = F.col("_ledger_id").isNull() & (F.col("_own") == F.col("_position"))
    result = with_event_id(joined).withColumns(
        {
            "event_id": F.coalesce(F.col("_ledger_id"), F.col("event_id")),
            "duplicate": ~fresh,
            "occurred_at": F.coalesce(F.col("_ledger_at"), F.col("_occurred_at")),
        }
    )
    return result.drop("_own", "_position", "_occurred_at", "_ledger_id", "_ledger_at")


def batch_summary(answered: DataFrame) -> DataFrame:
    return answered.agg(
        F.count_if(~F.col("duplicate")).alias("accepted"),
        F.count_if(F.col("duplicate")).alias("duplicates"),
    )


def counts_by_type(answered: DataFrame) -> DataFrame:
    return answered.groupBy("event_type").agg(
        F.count_if(~F.col("duplicate")).alias("events_ingested"),
        F.count_if(F.col("duplicate")).alias("duplicate_events"),
    )


def existing_events(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Logged events of the given keys; the log holds a key once, the keys are made so."""
    return log.join(keys.select(KEY).distinct(), KEY, "left_semi")


def stream_first_per_key(events: DataFrame, horizon: str, salts: int = 16) -> DataFrame:
    """Streaming dedup for users who accept a bounded horizon, without a ledger.

    Two stages: each salt of a key keeps its first row, then the key keeps one, so a
    hot key's copies are spread over ``salts`` state partitions. Rows that arrive more than
    ``horizon`` after the newest one are dropped as late, whether their key is new or not;
    the query's progress counts them (``numRowsDroppedByWatermark``). Ingest through the
    ledger loses none.
    """
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *events.columns), F.lit(salts))
    return (
        events.withColumn("_salt", salt)
        .withWatermark("occurred_at", horizon)
        .dropDuplicatesWithinWatermark([KEY, "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark([KEY])
    )
