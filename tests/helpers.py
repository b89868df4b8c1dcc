from __future__ import annotations

from datetime import datetime, timezone

from paytally import schemas

M = "11111111-1111-4111-8111-111111111111"
M2 = "22222222-2222-4222-8222-222222222222"
GHOST = "99999999-9999-4999-8999-999999999999"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


T0 = at("2026-05-12 14:30:00")


def producer(spark, rows):
    """Rows of (key, merchant, amount, client_timestamp[, type])."""
    full = [
        (r[4] if len(r) > 4 else schemas.CONFIRMED, r[1], r[2], "EUR", r[0], r[3], None)
        for r in rows
    ]
    return spark.createDataFrame(full, schemas.PRODUCER_EVENT)


def logged(spark, rows):
    """Log rows of (merchant, amount, client_timestamp, occurred_at[, type])."""
    full = [
        (f"e{i}", r[0], r[4] if len(r) > 4 else schemas.CONFIRMED, r[1], "EUR", f"k{i}", r[3], r[2],
         None, r[3], r[3].date())
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.event_log("uuid"))


def merchants(spark, ids=(M, M2)):
    return spark.createDataFrame(
        [(m, f"shop {m[0]}", None) for m in ids], schemas.merchants("uuid")
    )


def cell_rows(df):
    return {
        (r["merchant_id"], r["bucket"], r["event_type"]): (
            r["count"], r["amount_sum_cents"], r["amount_min_cents"], r["amount_max_cents"]
        )
        for r in df.collect()
    }
