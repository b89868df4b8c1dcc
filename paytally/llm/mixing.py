"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a share of all words by its weight, at most ``most`` times its own size; the
excess is shared again by weight. Its words come as a stream of passes over its documents in a
pseudo-random order. A schedule says how fast a source is read at each time of training; its
integral is the share of the source's words needed up to then, and the inverse of that gives each
copy of a document its position in training. Copies are range-sorted by position.

Scale: sums per source and per bucket of the order are combined on the map side, so a source with
a third of all rows is never in one task. The running sum inside a source is the sum of the buckets
before plus a window over one bucket. There are as many buckets as the root of the documents, so
both windows see about that many rows of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paytally.llm.common import saved

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Reading rates over training time, dealt to the sources in turn like the weights: (time, rate).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
_ORDER_BITS = 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, turn, source_size, target, total of all sizes) from rows with ``source`` and ``size``.

    Sources by code point, null last, take the weights in turn. A source's limit is ``most`` times
    its size. In ascending order of limit per weight, a source is held at its limit as long as the
    level, what is left per weight left, is no lower; all others get weight times the level.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.asc_nulls_last("source"))
    turned = per_source.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    weighted = turned.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1))
    limit = F.col("source_size") * F.lit(most)
    by_limit = W.orderBy(limit / F.col("weight"), F.asc_nulls_last("source"))
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    ) / F.sum("weight").over(onward)
    leveled = weighted.withColumns({"limit": limit, "level": level})
    free = F.col("limit") > F.col("level") * F.col("weight")
    # The level where the first source stays under its limit; from there on it no longer changes.
    final = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("limit") / F.col("weight"))).over(everything)
    share = F.when(free, F.col("weight") * final).otherwise(F.col("limit")).cast("double")
    return leveled.select(
        "source", "turn", "source_size", share.alias("target"), F.sum("source_size").over(everything).alias("total")
    )


def training_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time in 0..1 at which the integral of a rate, linear between ``knots``, reaches ``share`` of its total."""
    pieces, total = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        area = (r0 + r1) / 2 * (t1 - t0)
        pieces.append((t0, t1, r0, (r1 - r0) / (t1 - t0), total))
        total += area
    time = F.lit(knots[-1][0])
    for t0, t1, rate, slope, before in reversed(pieces):
        rest = share * F.lit(total) - F.lit(before)
        if slope:
            root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * rest, F.lit(0.0)))
            here = F.lit(t0) + (root - F.lit(rate)) / F.lit(slope)
        else:
            here = F.lit(t0) + rest / F.lit(rate)
        area = rate * (t1 - t0) + slope * (t1 - t0) ** 2 / 2
        time = F.when(rest <= F.lit(area), here).otherwise(time)
    return time


def plan(
    rows: DataFrame, weights=WEIGHTS, most: int = MOST, schedules=SCHEDULES
) -> DataFrame:
    """Rows with ``id``, ``source`` and ``size``, further columns kept, plus what the mix does with them.

    Adds source_size, target, copies (whole passes over the document) and position (of the first
    copy, in words of the whole mix, -1 without copies). A copy belongs to the mix if its middle
    word lies before its source's target, so a source misses its target by half a document at most.
    """
    sizes = saved(rows.select("id", "source", "size"), "sizes")
    goal = saved(targets(sizes, weights, most), "targets")
    # 52 bits of a digest order the documents; buckets are equal ranges of them.
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    order = F.conv(F.substring(digest, 1, _ORDER_BITS // 4), 16, 10).cast("long")
    n_buckets = max(1, math.isqrt(sizes.count()))
    bucket = F.floor(order.cast("double") * F.lit(n_buckets) / F.lit(float(1 << _ORDER_BITS)))
    key = {"_order": order, "_bucket": bucket}
    per_bucket = sizes.withColumns(key).groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_in"),
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = W.partitionBy("source", "_bucket").orderBy("_order", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumns(key).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_in"))
    ).withColumn("_begin", F.col("_offset") + F.col("_inside"))
    renamed = goal.withColumnsRenamed({"source": "_of", "turn": "_turn", "total": "_total"})
    mixed = placed.join(renamed, F.col("source").eqNullSafe(F.col("_of")))
    room = (F.col("target") - F.col("_begin") - F.col("size") / 2) / F.col("source_size")
    copies = F.when(F.col("source_size") > 0, F.least(F.greatest(F.floor(room) + 1, F.lit(0)), F.lit(most)))
    mixed = mixed.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int"))
    first = F.when(F.col("copies") > 0, _position(F.col("_begin"), schedules))
    return mixed.withColumn("position", F.coalesce(first, F.lit(-1)))


def _position(begin: Column, schedules) -> Column:
    share = F.least(begin / F.col("target"), F.lit(1.0))
    time = None
    for turn, knots in enumerate(schedules):
        here = F.pmod(F.col("_turn"), F.lit(len(schedules))) == turn
        then = training_time(share, knots)
        time = F.when(here, then) if time is None else time.when(here, then)
    return F.floor(time * F.col("_total")).cast("long")


def summary(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position.

    A null or wordless text has size 0 and takes no words; null sources form one source, the last.
    Rows that repeat an id are each mixed. An empty table gives no rows, and a source without words
    has target 0.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
    )
    return plan(saved(rows, "rows"), **options).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        "position",
    )


def mix(
    docs: DataFrame,
    id_col="doc_id",
    source_col="source",
    text_col="text",
    schedules=SCHEDULES,
    position_col: str | None = None,
    **options,
) -> DataFrame:
    """The documents in training order: each as often as the mix takes it, with their own columns only.

    With ``position_col`` each copy's position in training is a further, last column, which carries
    the order on where that of the rows is lost. Whole rows travel as one struct, so their column names cannot clash with the plan's.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.struct(*docs.columns).alias("row"),
    )
    planned = plan(rows, schedules=schedules, **options).where("copies > 0")
    passes = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    copies = planned.withColumn("_pass", passes)
    at = _position(F.col("_begin") + F.col("_pass") * F.col("source_size"), schedules)
    placed = copies.select("row", "id", at.alias("at"))
    position = [] if position_col is None else [F.col("at").alias(position_col)]
    return placed.repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("row.*", *position)
