from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import GHOST, M, T0, merchants, producer
from paytally import schemas
from paytally.operators import validate as v
from paytally.sources.readers import CORRUPT, corrupt_lines, read_producer_json

GOOD = ("PAYMENT_CONFIRMED", M, 5000, "EUR", "k", None, None)


def event(**changes):
    row = dict(zip(schemas.PRODUCER_EVENT.fieldNames(), GOOD))
    row.update(changes)
    return tuple(row.values())


def checked(spark, *rows, kind="uuid"):
    return v.validate(spark.createDataFrame(list(rows), schemas.PRODUCER_EVENT), kind).collect()


@pytest.mark.parametrize(
    "change",
    [
        {"amount_cents": 0},
        {"amount_cents": 2147483647},
        {"metadata": None},
        {"metadata": '{"order": {"id": 7}}'},
        {"client_timestamp": T0},
        {"idempotency_key": "x" * 255},
        {"merchant_id": M.replace("-", "")},
        {"merchant_id": "{" + M + "}"},
        {"merchant_id": "urn:uuid:" + M.upper()},
    ],
)
def test_accepted(spark, change):
    row = checked(spark, event(**change))[0]
    assert row["reject_reasons"] == []
    assert row["merchant_id"] == M


def test_currency_defaults_and_is_upper_cased(spark):
    rows = checked(spark, event(currency="usd"), event(currency=None))
    assert [r["currency"] for r in rows] == ["USD", "EUR"]


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"amount_cents": -1}, "amount_cents"),
        ({"amount_cents": 2147483648}, "amount_cents"),
        ({"amount_cents": None}, "amount_cents"),
        ({"event_type": "PAYMENT_REVERSED"}, "event_type"),
        ({"event_type": None}, "event_type"),
        ({"idempotency_key": ""}, "idempotency_key"),
        ({"idempotency_key": "x" * 256}, "idempotency_key"),
        ({"idempotency_key": None}, "idempotency_key"),
        ({"merchant_id": "not-a-uuid"}, "merchant_id"),
        ({"merchant_id": None}, "merchant_id"),
        ({"currency": "EURO"}, "currency"),
        ({"metadata": "{broken"}, "metadata"),
        ({"metadata": "[1]"}, "metadata"),
    ],
)
def test_rejected_with_its_reason(spark, change, reason):
    row = checked(spark, event(**change))[0]
    assert row["reject_reasons"] == [reason]


def test_every_reason_is_named(spark):
    row = checked(spark, event(amount_cents=-1, currency="E", merchant_id="x"))[0]
    assert row["reject_reasons"] == ["merchant_id", "amount_cents", "currency"]


def test_filter_keeps_what_validation_accepts(spark):
    rows = [event(), event(currency="usd"), event(currency=None), event(amount_cents=-1),
            event(merchant_id="x"), event(merchant_id=M.upper()), event(metadata="{"),
            event(idempotency_key=None), event(metadata=' {"a": 1}')]
    events = spark.createDataFrame(rows, schemas.PRODUCER_EVENT)
    kept = v.valid_events(events).collect()
    assert len(kept) == 5
    assert sorted(map(str, kept)) == sorted(map(str, v.accepted(v.validate(events)).collect()))


def test_unknown_merchants(spark):
    events = producer(spark, [("a", M, 1, None), ("b", GHOST, 1, None), ("c", "bad", 1, None)])
    validated = v.validate(events)
    flagged = v.flag_unknown_merchants(validated, merchants(spark))
    reasons = {r["idempotency_key"]: r["reject_reasons"] for r in flagged.collect()}
    assert reasons == {"a": [], "b": ["unknown_merchant"], "c": ["merchant_id"]}
    missing = v.missing_merchants(v.accepted(validated), merchants(spark)).collect()
    assert [r[0] for r in missing] == [GHOST]
    with pytest.raises(v.UnknownMerchant):
        v.flag_unknown_merchants(validated, merchants(spark), "fail_batch")
    only_known = v.validate(producer(spark, [("a", M, 1, None)]))
    assert v.flag_unknown_merchants(only_known, merchants(spark), "fail_batch") is only_known


def test_json_lines(spark, tmp_path):
    lines = [
        json.dumps({"event_type": "PAYMENT_FAILED", "merchant_id": M, "amount_cents": 7,
                    "idempotency_key": "j", "client_timestamp": "2026-05-12T14:30:00Z",
                    "metadata": {"a": {"b": 1}}}),
        '{"event_type": "PAYMENT_FAILED", "merchant_id": ',
        json.dumps({"event_type": "PAYMENT_FAILED", "merchant_id": M, "amount_cents": 7,
                    "idempotency_key": "bad time", "client_timestamp": "yesterday"}),
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = read_producer_json(spark, str(tmp_path)).cache()
    good = rows.where(F.col(CORRUPT).isNull()).first()
    assert json.loads(good["metadata"]) == {"a": {"b": 1}}
    assert good["client_timestamp"].hour == 14
    assert {r[0] for r in corrupt_lines(rows).collect()} == set(lines[1:])
    reasons = {r["idempotency_key"]: r["reject_reasons"] for r in v.rejected(v.validate(rows)).collect()}
    assert reasons["bad time"] == ["record"] and "idempotency_key" in reasons[None]
    assert [r["idempotency_key"] for r in v.valid_events(rows).collect()] == ["j"]
