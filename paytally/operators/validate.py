"""Event validation: one pass that normalises, and names every reason to reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally import schemas
from paytally.operators.joins import lookup_join

# The accepted spellings of a UUID, hyphenated or plain hex.
UUID_HYPHENATED = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
UUID_PLAIN = "^[0-9a-f]{32}$"
UUID_WRAPPING = "^(urn:uuid:|\\{)|\\}$"


class UnknownMerchant(ValueError):
    """Raised under ``on_missing='fail_batch'``."""


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form, or null when ``text`` is no UUID."""
    bare = F.regexp_replace(F.lower(text), UUID_WRAPPING, "")
    hyphens = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike(UUID_HYPHENATED), bare).when(bare.rlike(UUID_PLAIN), hyphens)


def _merchant(merchant_kind: str) -> Column:
    merchant = F.col("merchant_id")
    return canonical_uuid(merchant) if merchant_kind == "uuid" else merchant


def _currency() -> Column:
    return F.coalesce(F.col("currency"), F.lit(schemas.DEFAULT_CURRENCY))


def _checks(events: DataFrame, merchant_kind: str) -> dict[str, Column]:
    """What each field must satisfy; null means a missing required field. A JSON line
    with one unreadable field is rejected even where that field is optional."""
    metadata = F.col("metadata")
    is_object = F.ltrim(metadata, F.lit(" \t\r\n")).startswith("{")
    checks = {
        "event_type": F.col("event_type").isin(*schemas.EVENT_TYPES),
        "merchant_id": _merchant(merchant_kind).isNotNull(),
        "amount_cents": F.col("amount_cents").between(0, schemas.MAX_AMOUNT),
        "currency": F.length(_currency()) == 3,
        "idempotency_key": F.length("idempotency_key").between(1, schemas.MAX_KEY_LENGTH),
        "metadata": metadata.isNull() | (is_object & F.try_parse_json(metadata).isNotNull()),
    }
    if schemas.CORRUPT in events.columns:
        checks["record"] = F.col(schemas.CORRUPT).isNull()
    return checks


def validate(events: DataFrame, merchant_kind: str = "uuid") -> DataFrame:
    """Add ``reject_reasons`` (empty when accepted) and normalise currency and merchant.

    Needs no shuffle. Rejected rows keep the values they came with, so that a
    quarantine shows what was sent.
    """
    checks = _checks(events, merchant_kind)
    passed = {name: F.coalesce(ok, F.lit(False)) for name, ok in checks.items()}
    # array_remove compiles; the lambda-based filters of arrays do not.
    reasons = F.array(*[F.when(ok, "").otherwise(name) for name, ok in passed.items()])
    checked = events.withColumn("reject_reasons", F.array_remove(reasons, ""))
    good = F.size("reject_reasons") == 0
    return checked.withColumns(
        {
            "currency": F.when(good, F.upper(_currency())).otherwise(F.col("currency")),
            "merchant_id": F.when(good, _merchant(merchant_kind)).otherwise(F.col("merchant_id")),
        }
    )


def valid_events(events: DataFrame, merchant_kind: str = "uuid") -> DataFrame:
    """The rows ``validate`` accepts, for readers that need no reasons: a plain filter
    that stops at the first failed check, the JSON parse being the last."""
    for ok in _checks(events, merchant_kind).values():
        events = events.where(ok)
    return events.withColumns(
        {"currency": F.upper(_currency()), "merchant_id": _merchant(merchant_kind)}
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reject_reasons") == 0).drop("reject_reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reject_reasons") > 0)


def missing_merchants(events: DataFrame, merchants: DataFrame) -> DataFrame:
    """Distinct merchant ids of ``events`` with no merchant row.

    ``distinct`` combines on the map side, so a hot merchant shuffles once per task.
    """
    ids = events.select("merchant_id").where(F.col("merchant_id").isNotNull()).distinct()
    return ids.join(merchants.select("merchant_id"), "merchant_id", "left_anti")


def known_merchants(events: DataFrame, merchants: DataFrame) -> DataFrame:
    return lookup_join(events, merchants.select("merchant_id"), ["merchant_id"], "left_semi")


def flag_unknown_merchants(
    validated: DataFrame, merchants: DataFrame, on_missing: str = "quarantine"
) -> DataFrame:
    """Row-level merchant check on validated events.

    ``quarantine`` adds ``unknown_merchant`` to the reasons; ``fail_batch`` rejects the
    whole batch as soon as one accepted row has no merchant.
    """
    if on_missing == "fail_batch":
        absent = missing_merchants(accepted(validated), merchants).limit(1)
        found = absent.collect()
        if found:
            raise UnknownMerchant(str(found[0]["merchant_id"]))
        return validated
    if on_missing != "quarantine":
        raise ValueError(f"on_missing must be 'quarantine' or 'fail_batch', not {on_missing!r}")
    ids = merchants.select("merchant_id").distinct().withColumn("_known", F.lit(True))
    unknown = (F.size("reject_reasons") == 0) & F.col("_known").isNull()
    reasons = F.when(unknown, F.array(F.lit("unknown_merchant"))).otherwise(
        F.col("reject_reasons")
    )
    return (
        lookup_join(validated, ids, ["merchant_id"], "left")
        .withColumn("reject_reasons", reasons)
        .select(*validated.columns)
    )
