"""Metric reads over rollup cells.

Every function takes ``merchant_id=None`` to answer for all merchants in one scan.
Ranges are inclusive at both ends on the bucket start, so a first partial bucket is
left out, and a success rate over less than an hour may see no cells.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paytally import schemas
from paytally.functions.measures import success_rate, sum_where
from paytally.functions.time import GRAINS, bucket, minutes_before, ts_lit, utc, within_days
from paytally.operators.joins import lookup_join
from paytally.operators.rollup import per_bucket

MINUTE_RANGE = timedelta(hours=3)
HOUR_RANGE = timedelta(hours=720)
MAX_RANGE_DAYS = 365
DEFAULT_RANGE = timedelta(hours=24)


def choose_grain(start: datetime, end: datetime) -> str:
    span = end - start
    if span <= MINUTE_RANGE:
        return "minute"
    return "hour" if span <= HOUR_RANGE else "day"


def grain_of(start: Column, end: Column) -> Column:
    """``choose_grain`` for a table of requests."""
    span = F.unix_micros(end) - F.unix_micros(start)
    return (
        F.when(span <= MINUTE_RANGE // timedelta(microseconds=1), "minute")
        .when(span <= HOUR_RANGE // timedelta(microseconds=1), "hour")
        .otherwise("day")
    )


def check_range(
    start: datetime | str | None, end: datetime | str | None, now: datetime | None = None
) -> tuple[datetime, datetime]:
    """Defaults (24 h up to ``now``) and limits of a metrics request."""
    end_at = utc(end) if end is not None else utc(now or datetime.now(timezone.utc))
    start_at = utc(start) if start is not None else end_at - DEFAULT_RANGE
    if start_at >= end_at:
        raise ValueError("start must be before end")
    if (end_at - start_at).days > MAX_RANGE_DAYS:
        raise ValueError(f"range cannot exceed {MAX_RANGE_DAYS} days")
    return start_at, end_at


def in_range(cells: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Cells with ``start <= bucket <= end``."""
    cells = within_days(cells, utc(start).date(), utc(end).date())
    return cells.where(F.col("bucket").between(ts_lit(start), ts_lit(end)))


def _keys(merchant_id) -> list[str]:
    return ["merchant_id"] if merchant_id is None else []


def _of(cells: DataFrame, merchant_id) -> DataFrame:
    return cells if merchant_id is None else cells.where(F.col("merchant_id") == merchant_id)


def range_buckets(
    cells: DataFrame, start: datetime, end: datetime, merchant_id=None
) -> DataFrame:
    """Count and volume per bucket across event types, in time order."""
    keys = _keys(merchant_id)
    chosen = in_range(_of(cells, merchant_id), utc(start), utc(end))
    return per_bucket(chosen, *keys).orderBy("bucket", *keys)


def success_rates(
    hour_cells: DataFrame, start: datetime, end: datetime, merchant_id=None
) -> DataFrame:
    chosen = in_range(_of(hour_cells, merchant_id), utc(start), utc(end))
    outcomes = chosen.groupBy(*_keys(merchant_id)).agg(
        F.coalesce(sum_where(schemas.CONFIRMED), F.lit(0)).alias("confirmed"),
        F.coalesce(sum_where(schemas.FAILED), F.lit(0)).alias("failed"),
    )
    rate = success_rate(F.col("confirmed"), F.col("failed")).alias("success_rate")
    return outcomes.select(*_keys(merchant_id), "confirmed", "failed", rate)


def merchant_metrics(
    cells: dict[str, DataFrame],
    start: datetime | str,
    end: datetime | str,
    merchant_id=None,
) -> DataFrame:
    """The combined record: totals, success rate, granularity and ordered ``data``.

    Buckets and outcomes are stacked and aggregated once, so nothing is joined. One
    row of ``data`` holds at most 721 buckets by the routing (367 beyond 30 days).
    """
    start_at, end_at = check_range(start, end)
    grain = choose_grain(start_at, end_at)
    keys = _keys(merchant_id)
    buckets = per_bucket(
        in_range(_of(cells[grain], merchant_id), start_at, end_at), *keys
    ).withColumns({"confirmed": F.lit(None).cast("bigint"), "failed": F.lit(None).cast("bigint")})
    rates = (
        success_rates(cells["hour"], start_at, end_at, merchant_id)
        .select(*keys, "confirmed", "failed")
        .withColumns(
            {
                "bucket": F.lit(None).cast("timestamp"),
                "count": F.lit(None).cast("bigint"),
                "volume_cents": F.lit(None).cast("bigint"),
            }
        )
    )
    point = F.when(
        F.col("bucket").isNotNull(), F.struct("bucket", "volume_cents", "count")
    )
    merged = (
        buckets.unionByName(rates)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("volume_cents"), F.lit(0)).cast("bigint").alias("total_volume_cents"),
            F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_count"),
            F.coalesce(F.sum("confirmed"), F.lit(0)).alias("confirmed"),
            F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
            F.array_sort(F.collect_list(point)).alias("data"),
        )
    )
    merchant = F.col("merchant_id") if merchant_id is None else F.lit(merchant_id)
    return merged.select(
        merchant.alias("merchant_id"),
        ts_lit(start_at).alias("start"),
        ts_lit(end_at).alias("end"),
        F.lit(grain).alias("granularity"),
        "total_volume_cents",
        "total_count",
        success_rate(F.col("confirmed"), F.col("failed")).alias("success_rate"),
        "data",
    )


def sparkline(
    minute_cells: DataFrame, as_of: datetime | str, window_minutes: int = 60, merchant_id=None
) -> DataFrame:
    """Per-minute count and volume from ``as_of - window`` to ``as_of``; empty minutes are absent."""
    if not 5 <= window_minutes <= 1440:
        raise ValueError("window_minutes must be in 5..1440")
    until = utc(as_of)
    since = until - timedelta(minutes=window_minutes)
    chosen = within_days(_of(minute_cells, merchant_id), since.date(), until.date())
    first = minutes_before(ts_lit(as_of), window_minutes)
    chosen = chosen.where(F.col("bucket").between(first, ts_lit(as_of)))
    keys = _keys(merchant_id)
    return per_bucket(chosen, *keys).orderBy("bucket", *keys)


REQUEST = ["request_id", "merchant_id", "start", "end", "granularity", "error"]
MEASURES = ["count", "volume_cents", "confirmed", "failed"]


def answer_requests(requests: DataFrame, cells: dict[str, DataFrame]) -> DataFrame:
    """Totals and success rate for a table of ``(request_id, merchant_id, start, end)``.

    The buckets of a range are the difference of two running sums, so a request costs two
    lookups a kind of cell, whatever its span. A request outside the limits of
    ``check_range``, or without a start or an end, comes back with ``error`` set and null
    totals. Rows that repeat are answered once and returned as often as they were asked.
    """
    start, end = F.col("start"), F.col("end")
    whole_days = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000)
    error = (
        F.when(start.isNull() | end.isNull(), "start and end are required")
        .when(start >= end, "start must be before end")
        .when(whole_days > MAX_RANGE_DAYS, f"range cannot exceed {MAX_RANGE_DAYS} days")
    )
    routed = requests.select(
        "request_id", "merchant_id", "start", "end",
        F.when(error.isNull(), grain_of(start, end)).alias("granularity"),
        error.alias("error"),
    )
    asked = routed.groupBy(*REQUEST).agg(F.count("*").alias("copies"))
    ok = F.col("error").isNull()
    reads = _lookups(asked.where(ok))
    sums = running_sums(cells, reads.select("merchant_id", "grain", "at"))
    found = lookup_join(reads, sums, ["merchant_id", "grain", "at"], "inner")
    # Outcomes come from the hours whatever the granularity, totals from its own cells.
    of_grain, of_hours = F.col("grain") == F.col("granularity"), F.col("grain") == "hour"
    zero = F.lit(0).cast("bigint")
    measured = found.select(
        *REQUEST,
        "copies",
        *[F.when(of_grain, F.col("sign") * F.col(m)).otherwise(zero).alias(m) for m in MEASURES[:2]],
        *[F.when(of_hours, F.col("sign") * F.col(m)).otherwise(zero).alias(m) for m in MEASURES[2:]],
    )
    silent = asked.withColumns({m: zero for m in MEASURES})
    answered = silent.unionByName(measured).groupBy(*REQUEST, "copies").agg(
        *[F.sum(m).cast("bigint").alias(m) for m in MEASURES]
    )
    each = answered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select(
        *REQUEST,
        F.when(ok, F.col("volume_cents")).alias("total_volume_cents"),
        F.when(ok, F.col("count")).alias("total_count"),
        F.when(ok, success_rate(F.col("confirmed"), F.col("failed"))).alias("success_rate"),
    )


def _lookups(asked: DataFrame) -> DataFrame:
    """The running sums a request needs, with their signs: those of the hours, and those of
    its own granularity where that is another."""
    edges = {g: _edges(g) for g in GRAINS}
    own = F.col("granularity")
    needed = (
        F.when(own == "minute", F.array(*edges["hour"], *edges["minute"]))
        .when(own == "day", F.array(*edges["hour"], *edges["day"]))
        .otherwise(F.array(*edges["hour"]))
    )
    return asked.withColumn("read", F.explode(needed)).select(*REQUEST, "copies", "read.*")


def _edges(grain: str) -> list[Column]:
    """The first bucket not before ``start``, and the first one after ``end``."""
    step = F.expr(f"INTERVAL 1 {grain}")
    first = bucket(grain, F.col("start"))
    begin = F.when(first < F.col("start"), first + step).otherwise(first)
    after = bucket(grain, F.col("end")) + step
    return [
        F.struct(F.lit(grain).alias("grain"), at.alias("at"), F.lit(sign).alias("sign"))
        for at, sign in ((begin, -1), (after, 1))
    ]


def running_sums(cells: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """For each ``(merchant_id, grain, at)``, the sums over the merchant's buckets before it.

    The days before come from a window over one row a day, the day's own part from a window
    over its buckets and the distinct points in it: at most 1,440 of each, however many
    events or requests a merchant has.
    """
    key = ["merchant_id", "grain"]
    zero = F.lit(0).cast("bigint")
    stored = reduce(
        DataFrame.unionByName,
        [_range_measures(cells[g]).withColumn("grain", F.lit(g)) for g in GRAINS],
    ).withColumnRenamed("bucket", "at")
    wanted = points.distinct().withColumns({m: zero for m in MEASURES})
    rows = (
        stored.withColumn("is_point", F.lit(False))
        .unionByName(wanted.withColumn("is_point", F.lit(True)))
        .withColumn("day", F.to_date("at"))
    )
    days_before = W.partitionBy(*key).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    per_day = rows.groupBy(*key, "day").agg(*[F.sum(m).alias(m) for m in MEASURES])
    before = per_day.select(
        *key, "day", *[F.coalesce(F.sum(m).over(days_before), zero).alias(f"{m}_before") for m in MEASURES]
    )
    # A point sorts before the bucket that starts at it.
    earlier = (
        W.partitionBy(*key, "day").orderBy("at", F.desc("is_point")).rowsBetween(W.unboundedPreceding, -1)
    )
    inside = rows.select(
        *key, "day", "at", "is_point",
        *[F.coalesce(F.sum(m).over(earlier), zero).alias(m) for m in MEASURES],
    ).where("is_point")
    return inside.join(before, [*key, "day"]).select(
        *key, "at", *[(F.col(m) + F.col(f"{m}_before")).cast("bigint").alias(m) for m in MEASURES]
    )


def _range_measures(cells: DataFrame) -> DataFrame:
    return cells.groupBy("merchant_id", "bucket").agg(
        F.sum("count").cast("bigint").alias("count"),
        F.sum("amount_sum_cents").cast("bigint").alias("volume_cents"),
        sum_where(schemas.CONFIRMED).alias("confirmed"),
        sum_where(schemas.FAILED).alias("failed"),
    )
