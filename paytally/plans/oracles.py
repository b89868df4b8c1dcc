"""The registered queries in plain SQL, for an engine that has the same tables as views."""

from __future__ import annotations

PAYMENTS = """
payments AS (
  SELECT event_id AS id, user_id AS merchant_id,
    CASE event_type WHEN 'purchase' THEN 'PAYMENT_CONFIRMED' WHEN 'error' THEN 'PAYMENT_FAILED'
      WHEN 'click' THEN 'PAYMENT_INITIATED' ELSE upper(event_type) END AS event_type,
    CAST(round(value * 100) AS BIGINT) AS amount_cents,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'usd' ELSE 'EUR' END AS currency,
    user_id || '-' || event_type || '-' || strftime(ts, '%Y-%m-%d') AS idempotency_key,
    ts AS occurred_at,
    CASE WHEN event_id % 20 = 0 THEN ts - INTERVAL 300 SECOND WHEN event_id % 3 = 0 THEN NULL
      ELSE ts END AS client_timestamp,
    props AS metadata,
    CASE WHEN event_id % 20 = 0 THEN ts - INTERVAL 300 SECOND ELSE ts END AS event_ts
  FROM events)"""

VALID = PAYMENTS + """,
valid AS (
  SELECT * REPLACE (upper(coalesce(currency, 'EUR')) AS currency) FROM payments
  WHERE event_type IN ('PAYMENT_INITIATED', 'PAYMENT_CONFIRMED', 'PAYMENT_FAILED'))"""

REGISTERED = """
registered AS (
  SELECT c_custkey AS merchant_id, c_name AS name FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')"""

FIRST = "row_number() OVER (PARTITION BY idempotency_key ORDER BY occurred_at, id) = 1"

ACCEPTED = VALID + "," + REGISTERED + f""",
accepted AS (
  SELECT * FROM valid WHERE merchant_id IN (SELECT merchant_id FROM registered) QUALIFY {FIRST})"""

ORDERS = """
order_payments AS (
  SELECT o_orderkey AS id, o_custkey AS merchant_id,
    CASE o_orderstatus WHEN 'F' THEN 'PAYMENT_CONFIRMED' WHEN 'P' THEN 'PAYMENT_FAILED'
      ELSE 'PAYMENT_INITIATED' END AS event_type,
    CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
    o_orderdate AS occurred_at, o_orderdate AS event_ts
  FROM orders)"""

LEDGER = VALID + f""",
ledger AS (
  SELECT idempotency_key, occurred_at FROM valid
  WHERE occurred_at < TIMESTAMP '2024-01-16' QUALIFY {FIRST})"""


def uuid_of(expression: str) -> str:
    digest = f"sha256({expression})"
    return " || '-' || ".join(
        f"substr({digest}, {start}, {length})"
        for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    )


def cells(name: str, source: str, grain: str) -> str:
    return f"""
{name} AS (
  SELECT merchant_id, CAST(date_trunc('{grain}', event_ts) AS TIMESTAMP) AS bucket, event_type,
    count(*) AS count, CAST(sum(amount_cents) AS BIGINT) AS amount_sum_cents,
    min(amount_cents) AS amount_min_cents, max(amount_cents) AS amount_max_cents
  FROM {source} GROUP BY ALL)"""


def merged(*sources: str) -> str:
    stacked = " UNION ALL ".join(f"SELECT * FROM {s}" for s in sources)
    return f"""
SELECT merchant_id, bucket, event_type, CAST(sum(count) AS BIGINT) AS count,
  CAST(sum(amount_sum_cents) AS BIGINT) AS amount_sum_cents,
  min(amount_min_cents) AS amount_min_cents, max(amount_max_cents) AS amount_max_cents
FROM ({stacked}) GROUP BY ALL"""


def bucket_sums(keys: str, source: str, where: str) -> str:
    return f"""
SELECT {keys} bucket, CAST(sum(count) AS BIGINT) AS count,
  CAST(sum(amount_sum_cents) AS BIGINT) AS volume_cents
FROM {source} WHERE {where} GROUP BY ALL"""


def between(start: str, end: str) -> str:
    return f"bucket BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'"


WEEK = between("2024-01-08", "2024-01-15")
RATE = "CASE WHEN confirmed + failed > 0 THEN round_even(confirmed / (confirmed + failed), 4) END"
OUTCOMES = """
  CAST(coalesce(sum(count) FILTER (event_type = 'PAYMENT_CONFIRMED'), 0) AS BIGINT) AS confirmed,
  CAST(coalesce(sum(count) FILTER (event_type = 'PAYMENT_FAILED'), 0) AS BIGINT) AS failed"""


def metrics_record(ctes: str, grain: str, start: str, end: str, merchant: str = "") -> str:
    only = f" AND merchant_id = {merchant}" if merchant else ""
    where = between(start, end) + only
    if merchant:
        base = f"ids AS (SELECT CAST({merchant} AS BIGINT) AS merchant_id)"
    else:
        base = (
            "ids AS (SELECT merchant_id FROM points UNION SELECT merchant_id FROM rates)"
        )
    return f"""WITH {ctes},
points AS ({bucket_sums("merchant_id,", "cells_" + grain, where)}),
rates AS (SELECT merchant_id, {OUTCOMES} FROM cells_hour WHERE {where} GROUP BY merchant_id),
{base},
data AS (
  SELECT merchant_id, CAST(sum(volume_cents) AS BIGINT) AS total_volume_cents,
    CAST(sum(count) AS BIGINT) AS total_count,
    string_agg(strftime(bucket, '%Y-%m-%d %H:%M') || '|' || volume_cents || '|' || count, ';'
      ORDER BY bucket) AS data
  FROM points GROUP BY merchant_id)
SELECT ids.merchant_id, TIMESTAMP '{start}' AS "start", TIMESTAMP '{end}' AS "end",
  '{grain}' AS granularity, coalesce(total_volume_cents, 0) AS total_volume_cents,
  coalesce(total_count, 0) AS total_count, {RATE} AS success_rate, coalesce(data, '') AS data
FROM ids LEFT JOIN data USING (merchant_id) LEFT JOIN rates USING (merchant_id)"""


def board(period: str, start: str, end: str, n: int, source: str) -> str:
    return f"""WITH {ORDERS}
SELECT '{period}' AS period, TIMESTAMP '{start}' AS period_start, TIMESTAMP '{end}' AS period_end,
  row_number() OVER (ORDER BY volume_cents DESC, merchant_id) AS rank, merchant_id, volume_cents,
  transaction_count, '{source}' AS source
FROM (
  SELECT merchant_id, CAST(sum(amount_cents) AS BIGINT) AS volume_cents,
    count(*) AS transaction_count
  FROM order_payments
  WHERE event_type = 'PAYMENT_CONFIRMED' AND event_ts >= '{start}' AND event_ts < '{end}'
  GROUP BY merchant_id)
ORDER BY volume_cents DESC, merchant_id LIMIT {n}"""


def snapshots(source: str, period: str, unit: str) -> str:
    key = f"'{period}|' || strftime(period_start, '%Y-%m-%d') || '|' || merchant_id"
    return f"""
SELECT {uuid_of(key)} AS id, merchant_id,
  rank() OVER (PARTITION BY period_start ORDER BY amount_sum_cents DESC) AS rank, amount_sum_cents,
  TIMESTAMP '2024-01-31' AS created_at, '{period}' AS period, period_start
FROM (
  SELECT CAST(date_trunc('{unit}', event_ts) AS DATE) AS period_start, merchant_id,
    CAST(sum(amount_cents) AS BIGINT) AS amount_sum_cents
  FROM {source} WHERE event_type = 'PAYMENT_CONFIRMED' GROUP BY ALL)
QUALIFY row_number() OVER (
  PARTITION BY period_start ORDER BY amount_sum_cents DESC, merchant_id) <= 100"""


SQL: dict[str, str] = {}

SQL["event_time_buckets"] = f"""WITH {PAYMENTS}
SELECT id, event_ts, CAST(date_trunc('minute', event_ts) AS TIMESTAMP) AS minute,
  CAST(date_trunc('hour', event_ts) AS TIMESTAMP) AS hour,
  CAST(date_trunc('day', event_ts) AS TIMESTAMP) AS day, strftime(event_ts, '%Y-%m') AS period,
  CAST(date_trunc('month', event_ts) AS TIMESTAMP) AS period_start,
  CAST(date_trunc('month', event_ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS period_end,
  greatest(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(event_ts), 0) / 1e6 AS lag_seconds
FROM payments"""

SQL["event_ids"] = f"""WITH {PAYMENTS}
SELECT id, idempotency_key, {uuid_of("idempotency_key")} AS event_id FROM payments"""

SQL["validate_accept"] = f"""WITH {VALID}
SELECT id, merchant_id, event_type, amount_cents, currency, idempotency_key, client_timestamp,
  metadata FROM valid"""

SQL["validate_reject_reasons"] = f"""
WITH feed AS (
  SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'PAYMENT_REVERSED' ELSE 'PAYMENT_INITIATED' END
      AS event_type,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name
      WHEN c_mktsegment = 'BUILDING' THEN upper({uuid_of("c_name")}) ELSE {uuid_of("c_name")} END
      AS sent_merchant,
    CAST(round(c_acctbal * 100) AS BIGINT) AS amount_cents,
    CASE WHEN c_nationkey < 3 THEN 'euro' WHEN c_nationkey < 6 THEN 'gbp' END AS currency,
    CASE WHEN c_nationkey = 7 THEN '' WHEN c_nationkey = 8 THEN repeat(c_name, 15) ELSE c_name END
      AS idempotency_key,
    c_nationkey IN (9, 10) AS bad_metadata, c_mktsegment = 'MACHINERY' AS bad_merchant
  FROM customer),
judged AS (
  SELECT *, concat_ws(',',
    CASE WHEN event_type = 'PAYMENT_REVERSED' THEN 'event_type' END,
    CASE WHEN bad_merchant THEN 'merchant_id' END,
    CASE WHEN amount_cents < 0 OR amount_cents > 2147483647 THEN 'amount_cents' END,
    CASE WHEN length(coalesce(currency, 'EUR')) <> 3 THEN 'currency' END,
    CASE WHEN length(idempotency_key) NOT BETWEEN 1 AND 255 THEN 'idempotency_key' END,
    CASE WHEN bad_metadata THEN 'metadata' END) AS reject_reasons
  FROM feed)
SELECT sent_merchant, event_type, amount_cents, idempotency_key,
  CASE WHEN reject_reasons = '' THEN upper(coalesce(currency, 'EUR')) ELSE currency END AS currency,
  CASE WHEN reject_reasons = '' THEN lower(sent_merchant) ELSE sent_merchant END AS merchant_id,
  reject_reasons
FROM judged"""

SQL["validate_merchant_check"] = f"""WITH {PAYMENTS},{REGISTERED}
SELECT id, merchant_id, reasons AS reject_reasons FROM (
  SELECT id, merchant_id,
    CASE WHEN event_type NOT IN ('PAYMENT_INITIATED', 'PAYMENT_CONFIRMED', 'PAYMENT_FAILED')
        THEN 'event_type'
      WHEN merchant_id NOT IN (SELECT merchant_id FROM registered) THEN 'unknown_merchant'
    END AS reasons
  FROM payments) WHERE reasons IS NOT NULL"""

SQL["missing_merchants"] = f"""WITH {VALID},{REGISTERED}
SELECT DISTINCT merchant_id FROM valid
WHERE merchant_id NOT IN (SELECT merchant_id FROM registered)"""

SQL["known_merchant_events"] = f"""WITH {VALID},{REGISTERED}
SELECT id, merchant_id, event_type, amount_cents FROM valid
WHERE merchant_id IN (SELECT merchant_id FROM registered)"""

SQL["json_source"] = f"""WITH {PAYMENTS},
lines AS (
  SELECT event_type = 'VIEW' AS corrupt, * FROM payments)
SELECT corrupt, CASE WHEN NOT corrupt THEN event_type END AS event_type,
  CASE WHEN NOT corrupt THEN currency END AS currency, count(*) AS lines,
  CAST(sum(CASE WHEN NOT corrupt THEN amount_cents END) AS BIGINT) AS amount_cents,
  min(CASE WHEN NOT corrupt THEN client_timestamp END) AS first_at,
  max(CASE WHEN NOT corrupt THEN client_timestamp END) AS last_at
FROM lines GROUP BY 1, 2, 3"""

SQL["dedup_first_per_key"] = f"""WITH {VALID}
SELECT id, idempotency_key, merchant_id, event_type, amount_cents, occurred_at FROM valid
QUALIFY {FIRST}"""

SQL["dedup_accepted"] = f"""WITH {LEDGER}
SELECT id, {uuid_of("idempotency_key")} AS event_id, idempotency_key, merchant_id, event_type,
  amount_cents, occurred_at
FROM (SELECT * FROM valid QUALIFY {FIRST})
WHERE idempotency_key NOT IN (SELECT idempotency_key FROM ledger)"""

ANSWERS = LEDGER + f""",
answers AS (
  SELECT v.id, v.idempotency_key, v.event_type, {uuid_of("v.idempotency_key")} AS event_id,
    coalesce(l.occurred_at,
      first_value(v.occurred_at) OVER (PARTITION BY v.idempotency_key ORDER BY v.occurred_at, v.id))
      AS occurred_at,
    l.idempotency_key IS NOT NULL OR
      row_number() OVER (PARTITION BY v.idempotency_key ORDER BY v.occurred_at, v.id) > 1
      AS duplicate
  FROM valid v LEFT JOIN ledger l USING (idempotency_key))"""

SQL["dedup_response"] = f"""WITH {ANSWERS}
SELECT id, idempotency_key, event_id, occurred_at, duplicate FROM answers"""

SQL["ingest_summary"] = f"""WITH {ANSWERS}
SELECT count(*) FILTER (NOT duplicate) AS accepted, count(*) FILTER (duplicate) AS duplicates
FROM answers"""

SQL["ingest_by_type"] = f"""WITH {ANSWERS}
SELECT event_type, count(*) FILTER (NOT duplicate) AS events_ingested,
  count(*) FILTER (duplicate) AS duplicate_events FROM answers GROUP BY event_type"""

SQL["existing_events"] = f"""WITH {VALID}
SELECT idempotency_key, id, occurred_at FROM (SELECT * FROM valid QUALIFY {FIRST})
WHERE idempotency_key IN (
  SELECT idempotency_key FROM valid WHERE event_type = 'PAYMENT_FAILED')"""

for grain in ("minute", "hour", "day"):
    SQL[f"rollup_{grain}"] = (
        f"WITH {ACCEPTED},{cells('c', 'accepted', grain)} SELECT * FROM c"
    )

SQL["rollup_merge"] = f"WITH {VALID},{cells('c', 'valid', 'day')} SELECT * FROM c"
SQL["rollup_chain_day"] = SQL["rollup_merge"]
SQL["rollup_backfill"] = (
    f"WITH {VALID},{ORDERS},{cells('a', 'valid', 'hour')},{cells('b', 'order_payments', 'hour')}"
    + merged("a", "b")
)

SQL["raw_metrics_24h"] = f"""WITH {VALID}
SELECT merchant_id, count(*) AS count, CAST(sum(amount_cents) AS BIGINT) AS volume_cents FROM valid
WHERE event_ts >= TIMESTAMP '2024-01-15' AND event_ts < TIMESTAMP '2024-01-16' GROUP BY merchant_id"""

SQL["events_per_day"] = f"""WITH {PAYMENTS}
SELECT CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day, count(*) AS events
FROM payments GROUP BY 1 ORDER BY 1 DESC LIMIT 7"""

SQL["leaderboard_increments"] = f"""WITH {ACCEPTED}
SELECT strftime(event_ts, '%Y-%m') AS period, merchant_id,
  CAST(sum(amount_cents) AS BIGINT) AS volume_cents, count(*) AS transaction_count
FROM accepted WHERE event_type = 'PAYMENT_CONFIRMED' GROUP BY ALL"""

VALID_HOUR = VALID + "," + cells("cells_hour", "valid", "hour")
VALID_MINUTE = VALID + "," + cells("cells_minute", "valid", "minute")
ORDER_DAY = ORDERS + "," + cells("cells_day", "order_payments", "day")

SQL["metrics_minute"] = f"WITH {VALID_MINUTE}" + bucket_sums(
    "merchant_id,", "cells_minute", between("2024-01-10 12:00", "2024-01-10 15:00")
)
SQL["metrics_hour"] = f"WITH {VALID_HOUR}" + bucket_sums("merchant_id,", "cells_hour", WEEK)
SQL["metrics_day"] = f"WITH {ORDER_DAY}" + bucket_sums(
    "merchant_id,", "cells_day", between("1997-01-01", "1997-12-31")
)
SQL["metrics_hour_one_merchant"] = f"WITH {VALID_HOUR}" + bucket_sums(
    "", "cells_hour", WEEK + " AND merchant_id = 42"
)
SQL["metrics_totals"] = f"""WITH {VALID_HOUR}
SELECT merchant_id, CAST(sum(amount_sum_cents) AS BIGINT) AS total_volume_cents,
  CAST(sum(count) AS BIGINT) AS total_count FROM cells_hour WHERE {WEEK} GROUP BY merchant_id"""
SQL["success_rate"] = f"""WITH {VALID_HOUR}
SELECT *, {RATE} AS success_rate FROM (
  SELECT merchant_id, {OUTCOMES} FROM cells_hour
  WHERE {between("2024-01-01", "2024-01-31")} GROUP BY merchant_id)"""

SQL["merchant_metrics"] = metrics_record(VALID_HOUR, "hour", "2024-01-08", "2024-01-15")
SQL["merchant_metrics_one"] = metrics_record(VALID_HOUR, "hour", "2024-01-08", "2024-01-15", "42")
SQL["merchant_metrics_year"] = metrics_record(
    ORDER_DAY + "," + cells("cells_hour", "order_payments", "hour"), "day", "1997-01-01", "1997-12-31"
)

SQL["metrics_requests_join"] = f"""WITH {VALID_HOUR},{cells("cells_minute", "valid", "minute")},
{cells("cells_day", "valid", "day")},
requests AS (
  SELECT id AS request_id, merchant_id,
    CASE WHEN amount_cents < 1000 THEN occurred_at - INTERVAL 2 HOUR
      WHEN amount_cents < 5000 THEN occurred_at - INTERVAL 5 DAY
      WHEN amount_cents < 15000 THEN occurred_at - INTERVAL 40 DAY
      WHEN amount_cents < 20000 THEN occurred_at
      ELSE occurred_at - INTERVAL 400 DAY END AS "start",
    occurred_at AS "end"
  FROM valid WHERE event_type = 'PAYMENT_FAILED'),
routed AS (
  SELECT *, CASE WHEN "start" >= "end" THEN 'start must be before end'
      WHEN "end" - "start" >= INTERVAL 366 DAY THEN 'range cannot exceed 365 days' END AS error,
    CASE WHEN "start" >= "end" OR "end" - "start" >= INTERVAL 366 DAY THEN NULL
      WHEN "end" - "start" <= INTERVAL 3 HOUR THEN 'minute'
      WHEN "end" - "start" <= INTERVAL 720 HOUR THEN 'hour' ELSE 'day' END AS granularity
  FROM requests),
tagged AS (
  SELECT 'minute' AS granularity, * FROM cells_minute
  UNION ALL SELECT 'hour', * FROM cells_hour UNION ALL SELECT 'day', * FROM cells_day),
found AS (
  SELECT request_id, CAST(sum(amount_sum_cents) AS BIGINT) AS volume, CAST(sum(count) AS BIGINT) AS n
  FROM routed r JOIN tagged c ON c.merchant_id = r.merchant_id AND c.granularity = r.granularity
    AND c.bucket BETWEEN r."start" AND r."end"
  GROUP BY request_id),
rates AS (
  SELECT request_id, {OUTCOMES}
  FROM routed r JOIN cells_hour c ON c.merchant_id = r.merchant_id
    AND c.bucket BETWEEN r."start" AND r."end"
  WHERE error IS NULL GROUP BY request_id)
SELECT request_id, merchant_id, "start", "end", granularity, error,
  CASE WHEN error IS NULL THEN coalesce(volume, 0) END AS total_volume_cents,
  CASE WHEN error IS NULL THEN coalesce(n, 0) END AS total_count, {RATE} AS success_rate
FROM routed LEFT JOIN found USING (request_id) LEFT JOIN rates USING (request_id)"""

DAY_BEFORE = (
    "bucket BETWEEN TIMESTAMP '2024-01-20 12:00' - INTERVAL 1440 MINUTE AND TIMESTAMP '2024-01-20 12:00'"
)
SQL["sparkline"] = f"WITH {VALID_MINUTE}" + bucket_sums("merchant_id,", "cells_minute", DAY_BEFORE)
SQL["sparkline_one_merchant"] = f"WITH {VALID_MINUTE}" + bucket_sums(
    "", "cells_minute", DAY_BEFORE + " AND merchant_id = 42"
)

SQL["leaderboard_month"] = board("1997-03", "1997-03-01", "1997-04-01", 10, "rollup_day")
SQL["leaderboard_december"] = board("1998-12", "1998-12-01", "1999-01-01", 100, "rollup_day")
SQL["leaderboard_materialised"] = board("1997-03", "1997-03-01", "1997-04-01", 10, "board")
SQL["leaderboard_snapshot"] = f"WITH {ACCEPTED}" + snapshots("accepted", "daily", "day")
SQL["leaderboard_snapshot_weekly"] = f"WITH {ACCEPTED}" + snapshots("accepted", "weekly", "week")
SQL["leaderboard_snapshot_monthly"] = f"WITH {ORDERS}" + snapshots(
    "order_payments", "monthly", "month"
)

SQL["leaderboard_history"] = f"""WITH {ORDERS},{REGISTERED},
snaps AS ({snapshots("order_payments", "monthly", "month")}),
kept AS (
  SELECT * FROM snaps WHERE period_start IN (
    SELECT DISTINCT period_start FROM snaps ORDER BY period_start DESC LIMIT 12))
SELECT period, period_start, CAST(period_start + INTERVAL 1 MONTH AS DATE) AS period_end,
  string_agg(rank || '|' || merchant_id || '|' || coalesce(name, '-') || '|' || amount_sum_cents, ';'
    ORDER BY rank, merchant_id) AS entries,
  'snapshot' AS source, max(created_at) AS generated_at
FROM kept LEFT JOIN registered USING (merchant_id) GROUP BY period, period_start"""

SQL["snapshot_bounds"] = f"""WITH {ORDERS},
days AS (SELECT DISTINCT CAST(occurred_at AS DATE) AS day FROM order_payments)
SELECT day, 'daily' AS period, CAST(day + INTERVAL 1 DAY AS DATE) AS period_end FROM days
UNION ALL SELECT day, 'weekly', CAST(day + INTERVAL 7 DAY AS DATE) FROM days
UNION ALL SELECT day, 'monthly', CAST(day + INTERVAL 1 MONTH AS DATE) FROM days"""

SQL["recent_events"] = f"""WITH {PAYMENTS}
SELECT id, merchant_id, event_type, amount_cents, occurred_at FROM payments
ORDER BY occurred_at DESC, id DESC LIMIT 20"""

SQL["events_page"] = f"""WITH {PAYMENTS}
SELECT id, occurred_at AS created_at, merchant_id FROM payments
WHERE (occurred_at, id) > (TIMESTAMP '2024-01-12 08:00', 0) ORDER BY occurred_at, id LIMIT 1000"""

SQL["late_events"] = f"""WITH {PAYMENTS},
lags AS (
  SELECT *, (epoch_us(date_trunc('hour', occurred_at) + INTERVAL 1 HOUR) - epoch_us(event_ts)) / 1e6
    AS lag FROM payments)
SELECT id AS event_id, merchant_id, event_ts, round_even(lag, 1) AS lag_seconds,
  (epoch_us(occurred_at) - epoch_us(client_timestamp)) / 1e6 AS client_delay_s
FROM lags WHERE lag > 3000"""

SQL["lag_histogram"] = f"""WITH {PAYMENTS},
lags AS (
  SELECT event_type AS worker_id, floor((epoch_us(
    date_trunc('minute', occurred_at) + INTERVAL 1 MINUTE) - epoch_us(event_ts)) / 1e6) AS lag
  FROM payments),
bounds(le, bound) AS (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1', 1), ('5', 5), ('10', 10), ('30', 30),
  ('60', 60), ('120', 120), ('300', 300), ('+Inf', 1e300))
SELECT worker_id, sum(lag) AS lag_sum, le, count(*) FILTER (lag <= bound) AS count
FROM lags, bounds GROUP BY worker_id, le"""

SQL["batch_lag"] = f"""WITH {PAYMENTS}
SELECT CAST(date_trunc('hour', occurred_at) AS TIMESTAMP) AS batch, count(*) AS fetched,
  greatest(epoch_us(date_trunc('hour', occurred_at) + INTERVAL 1 HOUR)
    - epoch_us(arg_max(event_ts, id)), 0) / 1e6 AS lag_seconds
FROM payments GROUP BY date_trunc('hour', occurred_at)"""

POSITIONS = PAYMENTS + """,
positions AS (
  SELECT event_type AS consumer_id, id AS last_event_id, occurred_at AS last_event_at,
    occurred_at AS updated_at
  FROM payments
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY occurred_at DESC, id DESC) = 1)"""

SQL["consumer_positions"] = f"WITH {POSITIONS} SELECT * FROM positions"

SQL["pipeline_lag"] = f"""WITH {POSITIONS},
consumers AS (
  SELECT DISTINCT event_type AS consumer_id FROM payments
  UNION SELECT DISTINCT c_mktsegment FROM customer),
lags AS (
  SELECT consumer_id, last_event_id, last_event_at, round_even(
    (epoch_us(TIMESTAMP '2024-01-30 23:55') - epoch_us(last_event_at)) / 1e6, 1) AS lag_seconds
  FROM consumers LEFT JOIN positions USING (consumer_id))
SELECT *, CASE WHEN lag_seconds IS NULL THEN 'unknown' WHEN lag_seconds > 30 THEN 'degraded'
  ELSE 'ok' END AS status FROM lags"""

SQL["ingestion_rate"] = f"""WITH {PAYMENTS}
SELECT CAST(date_trunc('second', occurred_at) AS TIMESTAMP) AS second,
  count(*) AS events_per_second FROM payments GROUP BY 1"""

TWO_HISTORIES = VALID + f""",
firsts AS (SELECT * FROM valid QUALIFY {FIRST}),{cells("days", "valid", "day")},
{cells("hours", "firsts", "hour")}"""

SQL["day_hour_discrepancy"] = f"""WITH {TWO_HISTORIES},
h AS (
  SELECT merchant_id, event_type, CAST(sum(count) AS BIGINT) AS hour_count FROM hours
  WHERE CAST(bucket AS DATE) = DATE '2024-01-15' GROUP BY ALL)
SELECT merchant_id, event_type, d.count AS day_count, coalesce(hour_count, 0) AS hour_count,
  abs(d.count - coalesce(hour_count, 0)) AS delta
FROM days d LEFT JOIN h USING (merchant_id, event_type)
WHERE d.bucket = TIMESTAMP '2024-01-15' AND abs(d.count - coalesce(hour_count, 0)) > 0
ORDER BY delta DESC, merchant_id, event_type LIMIT 10"""

SQL["compact_day"] = f"""WITH {TWO_HISTORIES},{cells("c", "firsts", "day")}
SELECT * FROM c WHERE bucket = TIMESTAMP '2024-01-15'"""

SQL["stream_ingest_log"] = f"""WITH {ACCEPTED}
SELECT {uuid_of("idempotency_key")} AS event_id, merchant_id, event_type, amount_cents, currency,
  idempotency_key, occurred_at, client_timestamp, CAST(occurred_at AS DATE) AS occurred_date
FROM accepted"""

SQL["stream_ingest_responses"] = f"""WITH {VALID},{REGISTERED}
SELECT idempotency_key, {uuid_of("idempotency_key")} AS event_id, count(*) - 1 AS duplicates,
  count(*) AS submitted, min(occurred_at) AS occurred_at
FROM valid WHERE merchant_id IN (SELECT merchant_id FROM registered) GROUP BY idempotency_key"""

SQL["stream_quarantine"] = f"""WITH {PAYMENTS},{REGISTERED},
judged AS (
  SELECT *, CASE WHEN event_type NOT IN ('PAYMENT_INITIATED', 'PAYMENT_CONFIRMED', 'PAYMENT_FAILED')
      THEN 'event_type'
    WHEN merchant_id NOT IN (SELECT merchant_id FROM registered) THEN 'unknown_merchant'
    END AS reject_reasons FROM payments)
SELECT reject_reasons, event_type, merchant_id, count(*) AS rows,
  CAST(sum(amount_cents) AS BIGINT) AS amount_cents
FROM judged WHERE reject_reasons IS NOT NULL GROUP BY ALL"""

SQL["stream_rollup_hour"] = SQL["rollup_hour"]
SQL["replay_rollup"] = SQL["rollup_day"]
SQL["rebuild_minute"] = SQL["rollup_minute"]

LAST = f"""arg_max({uuid_of("idempotency_key")}, (occurred_at, {uuid_of("idempotency_key")}))"""
SQL["replay_batch_stats"] = f"""WITH {ACCEPTED},
total AS (
  SELECT count(*) AS n, {LAST} AS last_event_id, max(occurred_at) AS last_event_at FROM accepted)
SELECT n AS fetched, n AS new, 0 AS skipped, 'cells-main' AS consumer_id, last_event_id,
  last_event_at FROM total
UNION ALL SELECT n, 0, n, 'cells-main', last_event_id, last_event_at FROM total"""

SQL["fold_and_backfill"] = (
    f"WITH {ACCEPTED},"
    " absent AS (SELECT * FROM valid WHERE merchant_id NOT IN (SELECT merchant_id FROM registered)),"
    f"{cells('a', 'accepted', 'day')},{cells('b', 'absent', 'day')}" + merged("a", "b")
)

SQL["nightly_snapshots"] = f"""WITH {ACCEPTED}, s AS ({snapshots("accepted", "daily", "day")})
SELECT * REPLACE (TIMESTAMP '2024-01-16 00:05' AS created_at) FROM s
WHERE period_start = DATE '2024-01-15'"""

SQL["served_leaderboard"] = f"""WITH {ACCEPTED}
SELECT '2024-01' AS period, TIMESTAMP '2024-01-01' AS period_start,
  TIMESTAMP '2024-02-01' AS period_end,
  row_number() OVER (ORDER BY volume_cents DESC, merchant_id) AS rank, merchant_id, volume_cents,
  transaction_count, 'board' AS source
FROM (
  SELECT merchant_id, CAST(sum(amount_cents) AS BIGINT) AS volume_cents,
    count(*) AS transaction_count
  FROM accepted
  WHERE event_type = 'PAYMENT_CONFIRMED' AND event_ts >= '2024-01-01' AND event_ts < '2024-02-01'
  GROUP BY merchant_id)
ORDER BY volume_cents DESC, merchant_id LIMIT 10"""

SQL["retained_minutes"] = (
    f"WITH {ACCEPTED},{cells('c', 'accepted', 'minute')}"
    " SELECT * FROM c WHERE bucket >= TIMESTAMP '2024-01-20'"
)

SQL["stream_dedup_horizon"] = f"""WITH {PAYMENTS}
SELECT idempotency_key, event_type FROM payments QUALIFY {FIRST}"""

SQL["stored_metrics"] = metrics_record(
    ACCEPTED + "," + cells("cells_hour", "accepted", "hour"), "hour", "2024-01-08", "2024-01-15"
)
SQL["stored_sparkline"] = f"WITH {ACCEPTED},{cells('cells_minute', 'accepted', 'minute')}" + bucket_sums(
    "merchant_id,", "cells_minute", DAY_BEFORE
)
SQL["stored_late_events"] = f"""WITH {ACCEPTED}
SELECT {uuid_of("idempotency_key")} AS event_id, merchant_id, event_ts,
  (epoch_us(occurred_at) - epoch_us(client_timestamp)) / 1e6 AS client_delay_s
FROM accepted"""
SQL["consumer_status"] = f"""WITH {ACCEPTED},
last AS (SELECT {LAST} AS last_event_id, max(occurred_at) AS last_event_at FROM accepted)
SELECT 'cells-main' AS consumer_id, last_event_id, last_event_at, round_even(
    (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_event_at)) / 1e6, 1) AS lag_seconds,
  CASE WHEN last_event_at < TIMESTAMP '2024-01-31' - INTERVAL 30 SECOND THEN 'degraded' ELSE 'ok' END AS status
FROM last
UNION ALL SELECT 'idle', NULL, NULL, NULL, 'unknown'"""
SQL["stored_recent_events"] = f"""WITH {ACCEPTED}
SELECT {uuid_of("idempotency_key")} AS event_id, merchant_id, event_type, amount_cents, occurred_at
FROM accepted ORDER BY occurred_at DESC, event_id DESC LIMIT 20"""
SQL["stored_history"] = SQL["leaderboard_history"]
SQL["merchants_source"] = f"""WITH {VALID},{REGISTERED}
SELECT merchant_id, count(*) AS events FROM valid
WHERE merchant_id IN (SELECT merchant_id FROM registered) GROUP BY merchant_id"""
SQL["stamped_ingest"] = f"""WITH {VALID},{REGISTERED},
firsts AS (
  SELECT * FROM valid WHERE merchant_id IN (SELECT merchant_id FROM registered)
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY event_ts, id) = 1)
SELECT event_type, count(*) AS events, 1 AS stamps FROM firsts GROUP BY event_type"""
