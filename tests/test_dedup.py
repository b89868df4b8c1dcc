from __future__ import annotations

from collections import Counter
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import T0
from paytally import schemas
from paytally.operators import dedup
from paytally.operators.joins import lookup_join

ROW = "idempotency_key string, seq long, occurred_at timestamp, event_type string"


def events(spark, keys):
    rows = [
        (k, i, T0 + timedelta(seconds=i), "PAYMENT_CONFIRMED") for i, k in enumerate(keys)
    ]
    return spark.createDataFrame(rows, ROW)


def empty_ledger(spark):
    return spark.createDataFrame([], schemas.LEDGER)


def test_first_of_a_key_wins(spark):
    firsts = dedup.first_per_key(events(spark, "abab"), ["seq"]).collect()
    assert {(r["idempotency_key"], r["seq"]) for r in firsts} == {("a", 0), ("b", 1)}


def test_new_batch_is_accepted_whole(spark):
    answered = dedup.responses(events(spark, "abcde"), empty_ledger(spark), ["seq"])
    assert tuple(dedup.batch_summary(answered).first()) == (5, 0)


def test_repeat_in_a_later_batch_answers_with_the_original(spark):
    first = dedup.claim(events(spark, "ab"), empty_ledger(spark), ["seq"])
    ledger = dedup.claim_rows(first, F.to_date("occurred_at")).cache()
    again = events(spark, "xxb")
    assert [r["idempotency_key"] for r in dedup.claim(again, ledger, ["seq"]).collect()] == ["x"]
    rows = dedup.responses(again, ledger, ["seq"]).orderBy("seq").collect()
    assert [r["duplicate"] for r in rows] == [False, True, True]
    original = ledger.where("idempotency_key = 'b'").first()
    assert (rows[2]["event_id"], rows[2]["occurred_at"]) == (
        original["event_id"], original["occurred_at"],
    )
    assert rows[0]["event_id"] == rows[1]["event_id"]
    assert rows[1]["occurred_at"] == rows[0]["occurred_at"]


def test_counts_by_type_name_the_real_type(spark):
    rows = dedup.responses(events(spark, "aab"), empty_ledger(spark), ["seq"])
    counted = dedup.counts_by_type(rows).collect()
    assert [tuple(r) for r in counted] == [("PAYMENT_CONFIRMED", 2, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=25), st.sets(st.sampled_from("abcd")))
def test_responses_match_a_loop(spark, keys, claimed):
    claims = events(spark, sorted(claimed) or ["zz"])
    ledger = dedup.claim_rows(dedup.with_event_id(claims), F.to_date("occurred_at"))
    answered = dedup.responses(events(spark, keys), ledger, ["seq"])
    seen, expected = set(claimed), {}
    for i, key in enumerate(keys):
        expected[i] = key in seen
        seen.add(key)
    assert {r["seq"]: r["duplicate"] for r in answered.collect()} == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_the_plain_join(spark, how):
    """One key holds most rows, as equal copies; some keys are null or unmatched."""
    left = (
        spark.range(3000)
        .select(
            F.when(F.col("id") < 2000, "hot")
            .when(F.col("id") < 2100, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("k"), F.col("id") % 50))
            .alias("key"),
            F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("value"),
        )
        .repartition(8)
    )
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("absent", 5)], "key string, other int"
    )
    spread = lookup_join(left, right, ["key"], how)
    plain = left.join(right, ["key"], how)
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))


def test_hot_rows_are_split_over_tasks(spark):
    """Several hot keys and a hot null; small sizes stand for large ones."""
    hot = F.when(F.col("id") % 5 > 0, F.concat(F.lit("hot"), F.col("id") % 5))
    left = spark.range(0, 40000, 1, 40).select(hot.alias("key"), F.md5(F.col("id").cast("string")).alias("value"))
    right = spark.createDataFrame([(f"hot{i}", i) for i in range(5)], "key string, other int")
    small = {
        "spark.sql.shuffle.partitions": "64",  # so that the hot ones stand out
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = lookup_join(left, right, ["key"], "left")
        # The maximum keeps the values in the shuffle, which is split by its size.
        tasks = joined.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("value"))
        sizes = [r[1] for r in tasks.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40000 and max(sizes) < 6000


def test_lookup_join_without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = events(spark, "aab")
    right = spark.createDataFrame([("a", 1)], "idempotency_key string, other int")
    joined = lookup_join(left, right, ["idempotency_key"], "left")
    found = sorted((r["seq"], r["other"]) for r in joined.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert found == [(0, 1), (1, 1), (2, None)]


def test_outer_joins_that_would_repeat_the_right_side_are_refused(spark):
    left = events(spark, "a")
    with pytest.raises(ValueError):
        lookup_join(left, left, ["idempotency_key"], "full")


def test_existing_events(spark):
    log = events(spark, "abc")
    found = dedup.existing_events(events(spark, "ccx"), log).collect()
    assert [(r["idempotency_key"], r["seq"]) for r in found] == [("c", 2)]
