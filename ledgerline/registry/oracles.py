"""SQL that computes the same results as the registered queries, for DuckDB.

Each statement restates its query over the raw test tables, in the plain relational form
(windows, self-joins, per-defect CASE expressions) rather than in the shape of the Spark plan.
"""

from __future__ import annotations


def _ts(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def _day(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d') AS {name}"


def _real(expression: str, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name or expression}"


def _ratio(top: str, bottom: str, name: str) -> str:
    return _real(f"CAST({top} AS DOUBLE) / nullif({bottom}, 0)", name)


def _uuid(expression: str) -> str:
    digest = f"md5(CAST({expression} AS VARCHAR))"
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {at}, {size})" for at, size in parts)


_BASE = f"""
ev AS (
    SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
ord AS (
    SELECT event_id AS number,
           {_uuid("event_id")} AS event_id,
           'ORD-' || user_id || '-' || (k % 10) AS order_id,
           CASE event_type WHEN 'signup' THEN 'order_created' WHEN 'purchase' THEN 'order_paid'
                           WHEN 'click' THEN 'order_cancelled' ELSE 'payment_failed' END AS event_type,
           'USR-' || user_id AS user_id,
           CASE WHEN event_type = 'signup' THEN 'PRD-' || k END AS product_id,
           CASE WHEN event_type = 'signup' THEN CAST(k % 5 + 1 AS BIGINT) END AS quantity,
           CASE WHEN event_type <> 'click' THEN CAST(value AS DECIMAL(18,2)) END AS amount,
           CASE WHEN event_type <> 'click'
                THEN CASE WHEN user_id % 2 = 0 THEN 'TWD' ELSE 'USD' END END AS currency,
           CASE WHEN event_type = 'signup'
                THEN CASE k % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' ELSE 'android' END END AS channel,
           ts AS event_time,
           CAST(ts AS DATE) AS event_date,
           'orders.v1' AS kafka_topic,
           CAST(user_id % 6 AS BIGINT) AS kafka_partition,
           event_id AS kafka_offset,
           ts + INTERVAL 1 SECOND AS persisted_at
    FROM ev WHERE event_type <> 'view'
),
acc AS (
    SELECT event_id AS number,
           {_uuid("event_id")} AS event_id,
           ts AS event_time,
           'svc-' || (user_id % 9) AS service,
           '/e' || (k % 3) AS endpoint,
           CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 201 WHEN 'signup' THEN 302
                           WHEN 'purchase' THEN 404 ELSE 503 END AS status_code,
           CAST(floor(value * 10) AS BIGINT) AS response_time_ms,
           'application-logs.v1' AS kafka_topic,
           CAST(user_id % 6 AS BIGINT) AS kafka_partition,
           event_id AS kafka_offset,
           ts + INTERVAL 1 SECOND AS updated_at
    FROM ev
),
markers AS (
    SELECT 'order-consumer-v1' AS consumer_group, event_id, kafka_topic, kafka_partition,
           kafka_offset, persisted_at AS processed_at FROM ord
    UNION ALL
    SELECT 'log-consumer-v1', event_id, kafka_topic, kafka_partition, kafka_offset, updated_at
    FROM acc
)"""

_MINUTES = """
minutes AS (
    SELECT date_trunc('minute', event_time) AS metric_minute,
           CAST(event_time AS DATE) AS metric_date,
           service, endpoint,
           count(*) AS request_count,
           count(*) FILTER (status_code BETWEEN 100 AND 399) AS success_count,
           count(*) FILTER (status_code BETWEEN 400 AND 499) AS client_error_count,
           count(*) FILTER (status_code BETWEEN 500 AND 599) AS server_error_count,
           CAST(sum(response_time_ms) AS BIGINT) AS response_time_sum_ms,
           max(response_time_ms) AS max_response_time_ms,
           max(updated_at) AS updated_at
    FROM acc GROUP BY ALL
)"""

_SEQUENCE = """
seq AS (
    SELECT *,
           row_number() OVER stream AS event_sequence_number,
           lag(event_type) OVER stream AS previous_event_type,
           lead(event_type) OVER stream AS next_event_type,
           lag(event_time) OVER stream AS previous_event_time,
           first_value(event_time) OVER whole AS first_event_time,
           last_value(event_time) OVER whole AS latest_event_time
    FROM ord
    WINDOW stream AS (PARTITION BY order_id
                      ORDER BY kafka_topic, kafka_partition, kafka_offset, event_id),
           whole AS (PARTITION BY order_id
                     ORDER BY kafka_topic, kafka_partition, kafka_offset, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)"""


def _first(column: str, kind: str | None = None, descending: bool = False) -> str:
    order = "event_sequence_number DESC" if descending else "event_sequence_number"
    scope = f" FILTER (event_type = '{kind}')" if kind else ""
    return f"(array_agg({column} ORDER BY {order}){scope})[1]"


_STATE = f"""
latest AS (
    SELECT DISTINCT ON (order_id) order_id, event_time AS latest_event_at,
           event_type AS latest_event_type,
           CASE event_type WHEN 'order_created' THEN 'created' WHEN 'order_paid' THEN 'paid'
                           WHEN 'order_cancelled' THEN 'cancelled'
                           WHEN 'payment_failed' THEN 'payment_failed' END AS latest_order_state
    FROM seq ORDER BY order_id, event_sequence_number DESC, event_id DESC
),
picked AS (
    SELECT order_id,
           min(event_time) AS earliest_observed_event_time,
           count(*) AS order_event_count,
           {_first("user_id")} AS user_id,
           {_first("product_id", "order_created")} AS product_id,
           {_first("quantity", "order_created")} AS quantity,
           {_first("channel", "order_created")} AS channel,
           {_first("currency", "order_created")} AS currency,
           {_first("amount", "order_created")} AS original_order_amount,
           {_first("event_time", "order_created")} AS order_created_at,
           {_first("event_time", "order_paid")} AS first_paid_at,
           {_first("event_time", "order_paid", True)} AS latest_paid_at,
           {_first("amount", "order_paid", True)} AS latest_paid_amount,
           {_first("currency", "order_paid", True)} AS latest_paid_currency,
           {_first("event_time", "payment_failed", True)} AS latest_payment_failed_at,
           {_first("event_time", "order_cancelled")} AS cancelled_at,
           count(*) FILTER (event_type IN ('order_paid', 'payment_failed')) AS payment_attempt_count,
           count(*) FILTER (event_type = 'payment_failed') AS payment_failure_count,
           bool_or(event_type = 'order_paid') AS is_paid,
           bool_or(event_type = 'order_cancelled') AS is_cancelled
    FROM seq GROUP BY order_id
),
state AS (SELECT * FROM picked JOIN latest USING (order_id))"""

_SALES = """
sales AS (
    SELECT event_date, currency, channel,
           count(DISTINCT order_id) FILTER (event_type = 'order_created') AS created_order_count,
           coalesce(sum(amount) FILTER (event_type = 'order_created'), 0) AS created_order_amount,
           count(DISTINCT order_id) FILTER (event_type = 'order_paid') AS paid_order_count,
           coalesce(sum(amount) FILTER (event_type = 'order_paid'), 0) AS paid_amount,
           count(DISTINCT order_id) FILTER (event_type = 'order_cancelled') AS cancelled_order_count,
           count(DISTINCT order_id) FILTER (event_type = 'payment_failed')
               AS payment_failed_order_count,
           coalesce(sum(amount) FILTER (event_type = 'payment_failed'), 0) AS payment_failed_amount,
           count(*) FILTER (event_type IN ('order_paid', 'payment_failed')) AS payment_attempt_count,
           count(*) FILTER (event_type = 'order_paid') AS payment_success_count
    FROM (SELECT seq.event_date, seq.order_id, seq.event_type, seq.amount, state.channel,
                 CASE WHEN seq.event_type = 'order_cancelled' THEN state.currency
                      ELSE seq.currency END AS currency
          FROM seq LEFT JOIN state USING (order_id))
    GROUP BY ALL
)"""

_HEALTH = """
health AS (
    SELECT metric_minute, metric_date, service,
           CAST(sum(request_count) AS BIGINT) AS request_count,
           CAST(sum(success_count) AS BIGINT) AS success_count,
           CAST(sum(client_error_count) AS BIGINT) AS client_error_count,
           CAST(sum(server_error_count) AS BIGINT) AS server_error_count,
           CAST(sum(client_error_count + server_error_count) AS BIGINT) AS error_count,
           sum(response_time_sum_ms) AS response_time_sum_ms,
           max(max_response_time_ms) AS max_response_time_ms,
           count(DISTINCT endpoint) AS endpoint_count
    FROM minutes GROUP BY ALL
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join([_BASE, *parts])


# --- models -----------------------------------------------------------------------------

_ORDER_COLUMNS = f"""event_id, order_id, event_type, user_id, product_id, quantity,
    {_real("amount")}, currency, channel, {_ts("event_time")}, {_day("event_date")},
    kafka_topic, kafka_partition, kafka_offset, {_ts("persisted_at")}"""
_SEQUENCE_COLUMNS = f"""{_ORDER_COLUMNS}, event_sequence_number, previous_event_type,
    next_event_type, {_ts("previous_event_time")},
    {_real("(epoch_us(event_time) - epoch_us(previous_event_time)) / 1000000.0",
           "seconds_since_previous_event")},
    {_ts("first_event_time")}, {_ts("latest_event_time")}"""
_FACT_COLUMNS = f"""order_id, user_id, product_id, quantity, currency, channel,
    {_ts("order_created_at")}, {_ts("first_paid_at")}, {_ts("latest_paid_at")},
    {_ts("latest_payment_failed_at")}, {_ts("cancelled_at")}, {_ts("latest_event_at")},
    latest_event_type, latest_order_state, {_real("original_order_amount")},
    {_real("latest_paid_amount")}, latest_paid_currency, payment_attempt_count,
    payment_failure_count, order_event_count, is_paid, is_cancelled"""
_SALES_COLUMNS = f"""{_day("event_date")}, currency, channel, created_order_count,
    {_real("created_order_amount")}, paid_order_count, {_real("paid_amount")},
    cancelled_order_count, payment_failed_order_count, {_real("payment_failed_amount")},
    payment_attempt_count,
    {_ratio("payment_success_count", "payment_attempt_count", "payment_success_rate")}"""
_COUNTERS = """request_count, success_count, client_error_count, server_error_count,
    response_time_sum_ms, max_response_time_ms"""
_STG_MINUTE_COLUMNS = f"""{_ts("metric_minute")}, {_day("metric_date")}, service, endpoint,
    {_COUNTERS}, {_ratio("response_time_sum_ms", "request_count", "average_response_time_ms")},
    {_ts("updated_at")}"""
_HEALTH_COLUMNS = f"""{_ts("metric_minute")}, {_day("metric_date")}, service, request_count,
    success_count, client_error_count, server_error_count, error_count,
    {_ratio("success_count", "request_count", "success_rate")},
    {_ratio("error_count", "request_count", "error_rate")},
    {_ratio("response_time_sum_ms", "request_count", "weighted_average_response_time_ms")},
    max_response_time_ms, endpoint_count"""

_EVENT_FACT = f"{_with(_SEQUENCE)} SELECT {_SEQUENCE_COLUMNS} FROM seq"
_ORDER_FACT = f"{_with(_SEQUENCE, _STATE)} SELECT {_FACT_COLUMNS} FROM state"
_DAILY = f"{_with(_SEQUENCE, _STATE, _SALES)} SELECT {_SALES_COLUMNS} FROM sales"
_MINUTE_TABLE = (
    f"{_with(_MINUTES)} SELECT {_ts('metric_minute')}, service, endpoint, {_COUNTERS}, "
    f"{_ts('updated_at')} FROM minutes"
)

_MODELS = {
    "stg_order_events": f"{_with()} SELECT {_ORDER_COLUMNS} FROM ord",
    "stg_processed_events": (
        f"{_with()} SELECT consumer_group, event_id, kafka_topic, kafka_partition, kafka_offset, "
        f"{_ts('processed_at')} FROM markers"
    ),
    "stg_log_metrics_minute": f"{_with(_MINUTES)} SELECT {_STG_MINUTE_COLUMNS} FROM minutes",
    "int_order_event_sequence": _EVENT_FACT,
    "fct_order_events": _EVENT_FACT,
    "fct_order_events_small_segments": _EVENT_FACT,
    "int_order_latest_state": (
        f"{_with(_SEQUENCE, _STATE)} SELECT {_FACT_COLUMNS}, "
        f"{_ts('earliest_observed_event_time')} FROM state"
    ),
    "fct_orders": _ORDER_FACT,
    "mart_daily_sales": _DAILY,
    "mart_daily_sales_from_orders": _DAILY,
    "log_metrics_minute": _MINUTE_TABLE,
    "minute_merge": _MINUTE_TABLE,
    "int_service_minute_metrics": (
        f"{_with(_MINUTES)} SELECT {_STG_MINUTE_COLUMNS}, "
        f"{_ratio('success_count', 'request_count', 'success_rate')}, "
        f"{_ratio('client_error_count', 'request_count', 'client_error_rate')}, "
        f"{_ratio('server_error_count', 'request_count', 'server_error_rate')}, "
        f"{_ratio('client_error_count + server_error_count', 'request_count', 'error_rate')} "
        "FROM minutes"
    ),
    "mart_service_health": (
        f"{_with(_MINUTES, _HEALTH)} SELECT {_HEALTH_COLUMNS} FROM health"
    ),
    "refreshed_service_health": (
        f"{_with(_MINUTES, _HEALTH)} SELECT {_HEALTH_COLUMNS} FROM health"
    ),
    "incremental_daily_sales": _DAILY,
    "merged_orders": _ORDER_FACT,
    "merged_order_events": _EVENT_FACT,
    "bounded_read": (
        f"{_with(_MINUTES, _HEALTH)} SELECT {_HEALTH_COLUMNS} FROM health "
        "WHERE metric_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"
    ),
    "late_rows": (
        f"{_with()} SELECT {_day('event_date')}, count(*) AS late_row_count FROM ord "
        "WHERE event_date < DATE '2024-01-24' GROUP BY ord.event_date"
    ),
}

# --- ingestion --------------------------------------------------------------------------

_ORDER_VERDICTS = f"""
judged AS (
    SELECT *, number % 23 AS defect,
           CASE WHEN number % 23 = 10 THEN {_uuid("number + 1")} ELSE event_id END AS sent_id,
           CASE WHEN number % 23 IN (6, 7) THEN 'JSONDecodeError'
                WHEN number % 23 IN (0, 1, 2, 3, 4, 5, 8, 9) THEN 'ValidationError'
                WHEN number % 23 = 16 THEN 'StorageConstraintError' END AS error_type,
           CASE number % 23
               WHEN 0 THEN 'payload.order_id: must be non-empty text'
               WHEN 1 THEN CASE WHEN event_type = 'order_cancelled'
                                THEN 'payload.amount: unknown field'
                                ELSE 'payload.amount: must be a number above 0' END
               WHEN 2 THEN CASE WHEN event_type = 'order_cancelled'
                                THEN 'payload.currency: unknown field'
                                ELSE 'payload.currency: must be one of TWD, USD' END
               WHEN 3 THEN CASE WHEN event_type = 'order_created'
                                THEN 'payload.channel: must be one of web, ios, android'
                                ELSE 'payload.channel: unknown field' END
               WHEN 4 THEN 'event_type: must be a supported type'
               WHEN 5 THEN 'payload: must be an object'
               WHEN 6 THEN 'payload is not valid JSON'
               WHEN 7 THEN 'payload is not valid UTF-8'
               WHEN 8 THEN 'event_time: must be a timestamp with an offset'
               WHEN 9 THEN 'debug: unknown field'
               WHEN 16 THEN 'order_id: longer than 64 characters' END AS error_message
    FROM ord
),
accepted AS (
    SELECT * FROM judged WHERE error_type IS NULL
    QUALIFY row_number() OVER (PARTITION BY sent_id
                               ORDER BY kafka_topic, kafka_partition, kafka_offset) = 1
)"""
_ACCESS_VERDICTS = """
sent AS (
    SELECT *, number % 19 AS defect, 0 AS copy FROM acc
    UNION ALL
    SELECT * REPLACE (kafka_offset + 1000000000 AS kafka_offset), number % 19, 1 FROM acc
    WHERE number % 19 IN (8, 9)
),
judged AS (
    SELECT *,
           CASE WHEN defect IN (0, 1, 2, 3) THEN 'ValidationError'
                WHEN defect IN (4, 5) THEN 'UnsupportedEventType'
                WHEN defect = 7 THEN 'JSONDecodeError' END AS error_type,
           CASE defect
               WHEN 0 THEN 'payload.request_id: must be non-empty text'
               WHEN 1 THEN 'payload.http_method: must be one of '
                           || 'GET, POST, PUT, PATCH, DELETE, HEAD, OPTIONS'
               WHEN 2 THEN 'payload.status_code: must be a whole number from 100 to 599'
               WHEN 3 THEN 'payload.endpoint: must start with /'
               WHEN 4 THEN 'event_type: not accepted by this consumer'
               WHEN 5 THEN 'event_type: not accepted by this consumer'
               WHEN 7 THEN 'payload is not valid JSON' END AS error_message
    FROM sent
)"""
_COORDINATE = 'kafka_topic AS topic, kafka_partition AS "partition", kafka_offset AS "offset"'
_LETTER_PLACE = (
    "kafka_topic AS original_topic, kafka_partition AS original_partition, "
    "kafka_offset AS original_offset"
)
_CLOCK_TEXT = "2026-08-06 00:00:00.000000"
_INGEST_MINUTES = f"""
    SELECT {_ts("metric_minute")}, service, endpoint, {_COUNTERS} FROM minutes"""
_ACCEPTED_ORDERS = f"""sent_id AS event_id, order_id, event_type, user_id, product_id, quantity,
    {_real("amount")}, currency, channel, {_ts("event_time")}, kafka_topic, kafka_partition,
    kafka_offset"""
_ACCEPTED_MINUTES = _MINUTES.replace(
    "FROM acc", "FROM judged WHERE error_type IS NULL AND copy = 0"
)

_INGESTION = {
    "ingest_order_errors": (
        f"{_with(_ORDER_VERDICTS)} SELECT {_COORDINATE}, error_type, error_message FROM judged"
    ),
    "ingest_access_errors": (
        f"{_with(_ACCESS_VERDICTS)} SELECT {_COORDINATE}, error_type, error_message FROM judged"
    ),
    "ingest_valid_orders": (
        f"{_with(_ORDER_VERDICTS)} SELECT {_ACCEPTED_ORDERS}, '{_CLOCK_TEXT}' AS created_at "
        "FROM accepted"
    ),
    "stream_valid_orders": f"{_with(_ORDER_VERDICTS)} SELECT {_ACCEPTED_ORDERS} FROM accepted",
    "ingest_log_metrics_minute": f"{_with(_ACCESS_VERDICTS, _ACCEPTED_MINUTES)} {_INGEST_MINUTES}",
    "stream_log_metrics_minute": f"{_with(_ACCESS_VERDICTS, _ACCEPTED_MINUTES)} {_INGEST_MINUTES}",
    "ingest_order_dead_letters": (
        f"{_with(_ORDER_VERDICTS)} SELECT "
        "CASE WHEN defect IN (6, 7) THEN kafka_topic || ':' || kafka_partition || ':' || kafka_offset "
        "ELSE sent_id END AS dlq_key, error_type, "
        f"{_LETTER_PLACE}, 'order-consumer-v1' AS consumer_group, order_id AS original_key, "
        "CASE defect WHEN 6 THEN 'utf-8' WHEN 7 THEN 'base64' ELSE 'json' END "
        "AS original_payload_encoding, CASE WHEN defect = 7 THEN '//4=' END AS base64_payload "
        "FROM judged WHERE error_type IS NOT NULL"
    ),
    "ingest_access_dead_letters": (
        f"{_with(_ACCESS_VERDICTS)} SELECT "
        "CASE WHEN defect = 7 THEN kafka_topic || ':' || kafka_partition || ':' || kafka_offset "
        "ELSE event_id END AS dlq_key, "
        "coalesce(error_type, 'DuplicateEventConflict') AS error_type, "
        f"{_LETTER_PLACE}, 'log-consumer-v1' AS consumer_group, service AS original_key, "
        "CASE WHEN defect = 7 THEN 'utf-8' ELSE 'json' END AS original_payload_encoding "
        "FROM judged WHERE error_type IS NOT NULL OR (defect = 9 AND copy = 1)"
    ),
    "stream_access_dead_letters": (
        f"{_with(_ACCESS_VERDICTS)} SELECT "
        "CASE WHEN defect = 7 THEN kafka_topic || ':' || kafka_partition || ':' || kafka_offset "
        "ELSE event_id END AS dlq_key, "
        "coalesce(error_type, 'DuplicateEventConflict') AS error_type, "
        f"{_LETTER_PLACE}, 'log-consumer-v1' AS consumer_group, service AS original_key, "
        "CASE WHEN defect = 7 THEN 'utf-8' ELSE 'json' END AS original_payload_encoding "
        "FROM judged WHERE error_type IS NOT NULL OR (defect = 9 AND copy = 1)"
    ),
    "dead_letter_messages": (
        f"{_with(_ORDER_VERDICTS)} SELECT "
        "CASE WHEN defect IN (6, 7) THEN kafka_topic || ':' || kafka_partition || ':' || kafka_offset "
        'ELSE sent_id END AS "key", error_type, \'2026-08-06T00:00:00.000000Z\' AS failed_at, '
        "kafka_offset AS original_offset, "
        "CASE WHEN defect NOT IN (6, 7) THEN 'checkout' END AS payload_source "
        "FROM judged WHERE error_type IS NOT NULL"
    ),
    "ingest_access_outcomes": (
        f"{_with(_ACCESS_VERDICTS)} SELECT "
        "CASE WHEN error_type IS NOT NULL OR (defect = 9 AND copy = 1) THEN 'dead-lettered' "
        "WHEN copy = 1 THEN 'duplicate' ELSE 'processed' END AS outcome, "
        "count(*) AS record_count FROM judged GROUP BY 1"
    ),
    "routed_messages": (
        f"{_with()} SELECT order_id AS \"key\", event_id AS \"value\", 'orders.v1' AS topic FROM ord "
        "UNION ALL SELECT service, event_id, 'application-logs.v1' FROM acc"
    ),
    "pending_events": (
        f"{_with()} SELECT consumer_group, event_id, kafka_topic AS topic, "
        f"kafka_partition AS partition_id, kafka_offset AS offset_id, {_ts('processed_at')} "
        "FROM markers WHERE processed_at >= TIMESTAMP '2024-01-25'"
    ),
    "first_user_events": (
        f"SELECT user_id, event_type, {_ts('ts')}, event_id, {_real('value')} FROM "
        "(SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn "
        "FROM events) WHERE rn = 1"
    ),
}


# --- quality ----------------------------------------------------------------------------


def _count_check(table: str, check: str, source: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{check}' AS check_name, "
        f"count(*) FILTER ({condition}) AS violation_count FROM {source}"
    )


def _key_check(table: str, check: str, source: str, keys: str, having: str, where="true") -> str:
    return (
        f"SELECT '{table}' AS table_name, '{check}' AS check_name, count(*) AS violation_count "
        f"FROM (SELECT {keys} FROM {source} WHERE {where} GROUP BY {keys} HAVING {having})"
    )


def _missing(table: str, source: str, columns: str) -> list[str]:
    return [_count_check(table, f"{c} not null", source, f"{c} IS NULL") for c in columns.split()]


def _negative(table: str, source: str, columns: str) -> list[str]:
    return [_count_check(table, f"{c} non-negative", source, f"{c} < 0") for c in columns.split()]


def _accepted(table: str, source: str, column: str, values: str) -> list[str]:
    return [_count_check(table, f"{column} accepted", source, f"{column} NOT IN ({values})")]


def _summary(checks: list[str]) -> str:
    return (
        "SELECT *, CASE WHEN violation_count = 0 THEN 'pass' ELSE 'fail' END AS status FROM ("
        + " UNION ALL ".join(checks)
        + ")"
    )


_EVENT_TYPES = "'order_created', 'order_paid', 'order_cancelled', 'payment_failed'"
_STATES = "'created', 'paid', 'cancelled', 'payment_failed'"
_MONIES = "'TWD', 'USD'"
_CHANNEL_NAMES = "'web', 'ios', 'android'"
_IS_CREATED = "event_type = 'order_created'"
_IS_PRICED = "event_type IN ('order_created', 'order_paid', 'payment_failed')"
_COUNTER_NAMES = (
    "request_count success_count client_error_count server_error_count "
    "response_time_sum_ms max_response_time_ms"
)
_PLACE = "kafka_topic, kafka_partition, kafka_offset"

_VALID_ORDER_CHECKS = [
    *_missing(
        "valid_orders",
        "(SELECT *, persisted_at AS created_at FROM ord)",
        "event_id order_id event_type user_id event_time kafka_topic kafka_partition "
        "kafka_offset created_at",
    ),
    *_negative("valid_orders", "ord", "kafka_partition kafka_offset"),
    *_accepted("valid_orders", "ord", "event_type", _EVENT_TYPES),
    *_accepted("valid_orders", "ord", "currency", _MONIES),
    *_accepted("valid_orders", "ord", "channel", _CHANNEL_NAMES),
    *[
        _count_check("valid_orders", f"{c} present when due", "ord", f"{due} AND {c} IS NULL")
        for c, due in (
            ("product_id", _IS_CREATED),
            ("quantity", _IS_CREATED),
            ("channel", _IS_CREATED),
            ("amount", _IS_PRICED),
            ("currency", _IS_PRICED),
        )
    ],
    _count_check("valid_orders", "quantity positive", "ord", "quantity <= 0"),
    _count_check("valid_orders", "amount positive", "ord", "amount <= 0"),
    _key_check("valid_orders", "event_id unique", "ord", "event_id", "count(*) > 1"),
    _key_check("valid_orders", "coordinate unique", "ord", _PLACE, "count(*) > 1"),
]
_MARKER_SOURCE = (
    "(SELECT *, kafka_topic AS topic, kafka_partition AS partition_id, "
    "kafka_offset AS offset_id FROM markers)"
)
_MARKER_CHECKS = [
    *_missing(
        "processed_events",
        _MARKER_SOURCE,
        "consumer_group event_id topic partition_id offset_id processed_at",
    ),
    *_negative("processed_events", _MARKER_SOURCE, "partition_id offset_id"),
    _key_check(
        "processed_events", "marker unique", "markers", "consumer_group, event_id", "count(*) > 1"
    ),
]
_MINUTE_CHECKS = [
    *_missing(
        "log_metrics_minute",
        "minutes",
        f"metric_minute service endpoint {_COUNTER_NAMES} updated_at",
    ),
    *_negative("log_metrics_minute", "minutes", _COUNTER_NAMES),
    _count_check(
        "log_metrics_minute",
        "counts add up",
        "minutes",
        "success_count + client_error_count + server_error_count <> request_count",
    ),
    _key_check(
        "log_metrics_minute",
        "key unique",
        "minutes",
        "metric_minute, service, endpoint",
        "count(*) > 1",
    ),
]
_ORDER_CHECKS = [
    _key_check(
        "stg_order_events",
        "order in one partition",
        "ord",
        "order_id",
        "count(DISTINCT (kafka_topic, kafka_partition)) > 1",
    ),
    _key_check(
        "stg_order_events", "order of one user", "ord", "order_id", "count(DISTINCT user_id) > 1"
    ),
    _key_check(
        "stg_order_events",
        "order in one currency",
        "ord",
        "order_id",
        "count(DISTINCT currency) > 1",
        "currency IS NOT NULL",
    ),
    _key_check("stg_order_events", "coordinate unique", "ord", _PLACE, "count(*) > 1"),
]
_MART_CHECKS = [
    *_missing("fct_order_events", "seq", "event_id order_id event_type user_id"),
    *_accepted("fct_order_events", "seq", "event_type", _EVENT_TYPES),
    _key_check("fct_order_events", "event_id unique", "seq", "event_id", "count(*) > 1"),
    *_missing("fct_orders", "state", "order_id user_id"),
    *_accepted("fct_orders", "state", "latest_order_state", _STATES),
    *_negative("fct_orders", "state", "payment_attempt_count payment_failure_count"),
    _count_check("fct_orders", "order_event_count positive", "state", "order_event_count <= 0"),
    _key_check("fct_orders", "order_id unique", "state", "order_id", "count(*) > 1"),
    *_missing("mart_daily_sales", "sales", "event_date"),
    *_accepted("mart_daily_sales", "sales", "currency", _MONIES),
    *_accepted("mart_daily_sales", "sales", "channel", _CHANNEL_NAMES),
    *_negative(
        "mart_daily_sales",
        "sales",
        "created_order_count created_order_amount paid_order_count paid_amount "
        "cancelled_order_count payment_failed_order_count payment_failed_amount "
        "payment_attempt_count",
    ),
    _key_check(
        "mart_daily_sales", "key unique", "sales", "event_date, currency, channel", "count(*) > 1"
    ),
    *_missing("mart_service_health", "health", "metric_minute metric_date service"),
    _count_check(
        "mart_service_health",
        "counts add up",
        "health",
        "success_count + client_error_count + server_error_count <> request_count",
    ),
    *_negative(
        "mart_service_health",
        "health",
        "request_count success_count client_error_count server_error_count error_count "
        "max_response_time_ms",
    ),
    _count_check("mart_service_health", "endpoint_count positive", "health", "endpoint_count <= 0"),
    _key_check(
        "mart_service_health", "key unique", "health", "metric_minute, service", "count(*) > 1"
    ),
]

_ESTIMATES = """
est AS (
    SELECT o_orderkey AS query_id,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'mart_daily_sales'
               WHEN '2' THEN 'mart_service_health' WHEN '3' THEN 'fct_order_events'
               WHEN '4' THEN 'fct_orders' ELSE 'adhoc_report' END AS model,
           o_custkey % 11 <> 0 AS valid,
           CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice * 2500) AS BIGINT)
               * CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END END AS bytes,
           o_custkey % 3 <> 0 AS filtered,
           o_orderkey % 12 AS requested,
           CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN 7 ELSE 31 END AS maximum,
           o_custkey % 4 = 0 AS waived,
           o_custkey % 4 = 0 AND o_orderkey % 5 <> 0 AS has_owner,
           o_custkey % 4 = 0 AND o_orderkey % 7 <> 0 AS has_reason,
           o_orderkey % 9 AS expiry,
           CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 10 <> 0 THEN 900000000 END AS approved
    FROM orders
)"""
_RESULTS = """
res AS (
    SELECT 'test.' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey
               AS unique_id,
           CASE WHEN l_quantity > 48 THEN 'fail' WHEN l_quantity > 40 THEN 'warn'
                WHEN l_quantity > 38 THEN NULL ELSE 'pass' END AS status,
           'order.' || l_orderkey AS asset_id
    FROM lineitem
),
rolled AS (
    SELECT asset_id, count(*) FILTER (status = 'fail') AS fail_count,
           count(*) FILTER (status = 'warn') AS warn_count,
           count(*) FILTER (status = 'pass') AS pass_count,
           count(*) FILTER (status IS NULL) AS other_count
    FROM res GROUP BY asset_id
),
quality AS (
    SELECT 'order.' || o_orderkey AS asset_id,
           coalesce(fail_count, 0) AS fail_count, coalesce(warn_count, 0) AS warn_count,
           coalesce(pass_count, 0) AS pass_count, coalesce(other_count, 0) AS other_count,
           CASE WHEN fail_count > 0 THEN 'fail' WHEN warn_count > 0 THEN 'warn'
                WHEN pass_count > 0 THEN 'pass' ELSE 'unknown' END AS quality_status
    FROM orders LEFT JOIN rolled ON rolled.asset_id = 'order.' || o_orderkey
)"""

_FRESHNESS_TABLES = (("valid_orders", "ord", "persisted_at"), ("log_metrics_minute", "acc", "updated_at"))
_FRESHNESS_CLOCKS = ("2024-01-31 00:10:00", "2024-01-31 01:00:00", "2026-08-06 00:00:00")


def _freshness(name: str, source: str, column: str, clock: str) -> str:
    age = f"epoch_us(TIMESTAMP '{clock}') - epoch_us(max({column}))"
    newest = f"strftime(max({column}), '%Y-%m-%d %H:%M:%S.%f')"
    return (
        f"SELECT '{name}' AS table_name, '{clock}' AS clock, {newest} AS max_loaded_at, "
        f"CASE WHEN max({column}) IS NULL OR {age} > 7200000000 THEN 'error' "
        f"WHEN {age} > 1800000000 THEN 'warn' ELSE 'pass' END AS status FROM {source}"
    )


_QUALITY = {
    "source_quality": _with(_MINUTES)
    + _summary([*_VALID_ORDER_CHECKS, *_MARKER_CHECKS, *_MINUTE_CHECKS, *_ORDER_CHECKS]),
    "mart_quality": _with(_MINUTES, _SEQUENCE, _STATE, _SALES, _HEALTH) + _summary(_MART_CHECKS),
    "check_not_null": "SELECT 'order.' || o_orderkey AS asset_id FROM orders WHERE o_orderkey % 3 = 2",
    "check_unique": "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1",
    "check_accepted_values": (
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag "
        "FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag NOT IN ('A', 'N')"
    ),
    "check_conditional_not_null": (
        "SELECT o_orderkey AS query_id FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 10 = 0"
    ),
    "check_positive_when_present": "SELECT c_custkey FROM customer WHERE c_acctbal <= 0",
    "check_non_negative": "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0",
    "check_unique_combination": (
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem "
        "GROUP BY lineitem.l_orderkey, lineitem.l_linenumber HAVING count(*) > 1"
    ),
    "check_single_value_per_group": (
        "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1"
    ),
    "check_single_place_per_user": (
        "SELECT order_id FROM (SELECT event_id % 2000 AS order_id, (event_id // 1500) % 6 AS place "
        "FROM events WHERE event_type <> 'view') GROUP BY 1 HAVING count(DISTINCT place) > 1"
    ),
    "check_count_consistency": (
        "SELECT * FROM (SELECT l_partkey, count(*) AS request_count, "
        "count(*) FILTER (l_returnflag = 'A') AS success_count, "
        "count(*) FILTER (l_returnflag = 'N') AS client_error_count, "
        "CAST(0 AS BIGINT) AS server_error_count FROM lineitem GROUP BY 1) "
        "WHERE success_count + client_error_count + server_error_count <> request_count"
    ),
    "check_freshness": _with()
    + " UNION ALL ".join(
        _freshness(*table, clock) for table in _FRESHNESS_TABLES for clock in _FRESHNESS_CLOCKS
    ),
    "contract_nulls": (
        f"{_with()} SELECT unnest(['user_id', 'event_time']) AS column_name, "
        "count(*) AS null_count FROM ord WHERE event_type = 'payment_failed'"
    ),
    "result_rollup": f"WITH {_RESULTS} SELECT * FROM quality",
    "gate": (
        f"WITH {_RESULTS} SELECT asset_id, "
        "bool_and(coalesce(status IN ('passed', 'pass', 'warn'), false)) AS passed "
        "FROM res GROUP BY 1"
    ),
    "changed_keys": (
        "SELECT user_id, event_type, CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 1 "
        "ELSE -1 END) AS BIGINT) AS rows_lost FROM events GROUP BY 1, 2 HAVING rows_lost <> 0"
    ),
    "staleness": (
        "SELECT user_id, CAST(TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR > "
        "max(ts) FILTER (event_type = 'purchase') AS VARCHAR) AS is_stale FROM events GROUP BY 1"
    ),
}

# --- offsets, lag, run evidence ---------------------------------------------------------

_RUNS = """
deliv AS (
    SELECT DISTINCT (event_id // 1500) % 6 AS part, event_id AS off FROM events
    WHERE event_type <> 'view'
),
runs AS (
    SELECT part, min(off) AS start_offset, max(off) + 1 AS end_offset
    FROM (SELECT part, off, off - row_number() OVER (PARTITION BY part ORDER BY off) AS island
          FROM deliv)
    GROUP BY part, island
)"""
_LAG = """
ends AS (
    SELECT kafka_topic, kafka_partition, max(kafka_offset) + 1 AS log_end FROM markers GROUP BY ALL
),
commits AS (
    SELECT consumer_group, kafka_topic, kafka_partition,
           CASE WHEN kafka_topic = 'orders.v1' AND kafka_partition = 0 THEN -1001
                WHEN kafka_topic = 'orders.v1' AND kafka_partition = 1 THEN max(kafka_offset) + 6
                ELSE max(kafka_offset) FILTER (processed_at < TIMESTAMP '2024-01-20') + 1
           END AS committed
    FROM markers GROUP BY consumer_group, kafka_topic, kafka_partition
),
seen AS (SELECT DISTINCT consumer_group, kafka_topic FROM markers),
subs AS (
    SELECT *, true AS established FROM seen
    UNION ALL SELECT 'audit-consumer', kafka_topic, false FROM seen
),
plag AS (
    SELECT s.consumer_group, e.kafka_topic AS topic, e.kafka_partition AS part,
           CASE WHEN s.established AND c.committed >= 0 THEN c.committed END AS current_offset,
           CASE WHEN s.established THEN e.log_end END AS log_end_offset,
           CASE WHEN s.established AND c.committed >= 0 AND e.log_end >= c.committed
                THEN e.log_end - c.committed END AS lag,
           CASE WHEN NOT s.established THEN 'group_not_established'
                WHEN c.committed IS NULL OR c.committed < 0 THEN 'offset_not_available'
                WHEN e.log_end < c.committed THEN 'invalid_negative_lag'
                ELSE 'measured' END AS status
    FROM subs s JOIN ends e USING (kafka_topic)
    LEFT JOIN commits c ON c.consumer_group = s.consumer_group
        AND c.kafka_topic = e.kafka_topic AND c.kafka_partition = e.kafka_partition
),
glag AS (
    SELECT consumer_group, topic,
           CASE WHEN count(lag) = count(*) THEN CAST(sum(lag) AS BIGINT) END AS total_lag,
           CASE WHEN bool_and(status = 'group_not_established') THEN 'group_not_established'
                WHEN count(lag) = count(*) THEN 'measured' ELSE 'partial' END AS status
    FROM plag GROUP BY ALL
)"""
_DAILY_LAG = """
per_day AS (
    SELECT CAST(updated_at AS DATE) AS day, kafka_partition AS part, max(kafka_offset) + 1 AS day_end
    FROM acc GROUP BY ALL
),
daily AS (
    SELECT day, part, max(day_end) OVER (PARTITION BY part ORDER BY day) AS log_end,
           lag(day_end) OVER (PARTITION BY part ORDER BY day) AS committed
    FROM per_day
),
snapshots AS (
    SELECT CAST(day AS TIMESTAMP) AS observed_at,
           CASE WHEN NOT bool_or(committed IS NULL AND log_end <> 0)
                THEN CAST(sum(coalesce(log_end - committed, 0)) AS BIGINT) END AS benchmark_lag
    FROM daily GROUP BY day
)"""
_ATTEMPTS = """
att AS (
    SELECT value, ts,
           CASE WHEN event_type = 'view' THEN 'log' ELSE 'order' END AS family,
           CASE WHEN k < 5 THEN 'invalid' WHEN k < 10 THEN 'stale' WHEN k < 20 THEN 'duplicate'
                ELSE 'normal' END AS injection_kind,
           CASE WHEN k < 5 THEN CASE k % 3 WHEN 0 THEN 'missing_field' WHEN 1 THEN 'negative_amount'
                                           ELSE 'unknown_type' END END AS invalid_kind,
           CASE WHEN k % 50 = 49 THEN 'failed' WHEN k % 50 <> 48 THEN 'delivered' END AS outcome
    FROM ev
)"""


def _at_rank(p: str) -> str:
    return f"max(v) FILTER (rn = CAST(ceil(CAST({p} AS DOUBLE) * n) AS BIGINT))"


def _ranked(source: str, key: str | None, value: str, where: str = "true") -> str:
    partition = f"PARTITION BY {key} " if key else ""
    shown = f"{key}, " if key else ""
    return (
        f"ranked AS (SELECT {shown}{value} AS v, "
        f"row_number() OVER ({partition}ORDER BY {value}) AS rn, "
        f"count(*) OVER ({partition}) AS n FROM {source} WHERE {where})"
    )


_INSIDE = (
    "EXISTS (SELECT 1 FROM runs r WHERE '{topic}' = 'orders.v1' AND r.part = kafka_partition "
    "AND kafka_offset >= r.start_offset AND kafka_offset < r.end_offset)"
)
_ORDER_INSIDE = _INSIDE.format(topic="orders.v1")

_EVIDENCE = {
    "offset_intervals": (
        f"WITH {_RUNS} SELECT 'orders.v1' AS topic, CAST(part AS BIGINT) AS \"partition\", "
        "start_offset, end_offset AS end_offset_exclusive FROM runs"
    ),
    "interval_coverage": (
        f"WITH {_RUNS} SELECT CAST(sum(end_offset - start_offset) AS BIGINT) AS covered_offsets, "
        "(SELECT count(*) FROM deliv) AS delivered_count, "
        "CAST(sum(end_offset - start_offset) AS BIGINT) = (SELECT count(*) FROM deliv) "
        "AS is_complete FROM runs"
    ),
    "consumed_count": (
        f"{_with(_LAG, _RUNS)} SELECT CAST(sum(CASE WHEN committed >= 0 "
        "THEN greatest(least(committed, end_offset) - start_offset, 0) ELSE 0 END) AS BIGINT) "
        "AS consumed_count FROM runs LEFT JOIN commits "
        "ON kafka_topic = 'orders.v1' AND kafka_partition = part"
    ),
    "orders_in_intervals": (
        f"{_with(_RUNS)} SELECT event_id, kafka_partition, kafka_offset FROM ord "
        f"WHERE {_ORDER_INSIDE}"
    ),
    "run_counts": (
        f"{_with(_MINUTES, _ORDER_VERDICTS, _RUNS)} "
        "SELECT 'processed_events_count' AS measure, count(*) AS row_count FROM markers "
        f"WHERE kafka_topic = 'orders.v1' AND {_ORDER_INSIDE} "
        "UNION ALL SELECT 'log_processed_events_count', 0 "
        f"UNION ALL SELECT 'valid_orders_count', count(*) FROM ord WHERE {_ORDER_INSIDE} "
        "UNION ALL SELECT 'dead_letter_count', count(*) FROM judged "
        f"WHERE error_type IS NOT NULL AND {_ORDER_INSIDE} "
        "UNION ALL SELECT 'log_metric_rows_total', count(*) FROM minutes"
    ),
    "partition_lag": (
        f"{_with(_LAG)} SELECT consumer_group, topic, part AS \"partition\", current_offset, "
        "log_end_offset, lag, status FROM plag"
    ),
    "group_lag": f"{_with(_LAG)} SELECT * FROM glag",
    "combined_lag": (
        f"{_with(_LAG)} SELECT topic, CASE WHEN count(total_lag) = count(*) "
        "THEN CAST(sum(total_lag) AS BIGINT) END AS combined_total_lag FROM glag GROUP BY 1 "
        "UNION ALL SELECT consumer_group, CAST(sum(total_lag) AS BIGINT) FROM glag "
        "WHERE consumer_group = 'log-consumer-v1' GROUP BY 1"
    ),
    "benchmark_lag": (
        f"{_with(_DAILY_LAG)} SELECT {_ts('observed_at')}, benchmark_lag FROM snapshots"
    ),
    "observed_lag": (
        f"{_with(_DAILY_LAG)} SELECT max(benchmark_lag) AS max_lag, "
        "(SELECT benchmark_lag FROM snapshots ORDER BY observed_at DESC LIMIT 1) AS final_lag "
        "FROM snapshots"
    ),
    "lag_report": (
        f"{_with(_DAILY_LAG)} SELECT strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') "
        "AS observed_at, 'log-consumer-v1' AS consumer_group, 'application-logs.v1' AS topic, "
        'part AS "partition", committed AS committed_offset, log_end AS log_end_offset, '
        "log_end - committed AS lag, 'measured' AS status FROM daily"
    ),
    "test_result_report": (
        f"WITH {_RESULTS} SELECT unique_id, coalesce(status, 'unknown') AS status FROM res"
    ),
    "latency_percentiles": (
        _with(_ATTEMPTS, _ranked("att", "injection_kind", "value", "outcome = 'delivered'"))
        + " SELECT injection_kind, count(*) AS sample_count, "
        + _real("avg(v)", "average")
        + f", {_real(_at_rank('0.5'), 'p50')}, {_real(_at_rank('0.95'), 'p95')}, "
        + f"{_real(_at_rank('0.99'), 'p99')}, {_real(_at_rank('1.0'), 'p100')} "
        + "FROM ranked GROUP BY injection_kind"
    ),
    "latency_percentiles_overall": (
        f"{_with(_ATTEMPTS, _ranked('att', None, 'value'))} SELECT count(*) AS sample_count, "
        f"{_real('avg(v)', 'average')}, {_real(_at_rank('0.01'), 'p1')}, "
        f"{_real(_at_rank('0.5'), 'p50')}, {_real(_at_rank('0.95'), 'p95')}, "
        f"{_real(_at_rank('0.99'), 'p99')} FROM ranked"
    ),
    "price_percentiles": (
        f"WITH {_ranked('lineitem', 'l_returnflag', 'l_extendedprice')} "
        + " UNION ALL ".join(
            f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS percentile, "
            f"{_real(_at_rank(p), 'value')} FROM ranked GROUP BY 1"
            for p in ("0.001", "0.25", "0.5", "0.75", "0.999")
        )
    ),
    "delivery_counters": (
        f"{_with(_ATTEMPTS)} SELECT count(*) AS attempted, "
        "count(*) FILTER (outcome = 'delivered') AS delivered, "
        "count(*) FILTER (outcome = 'failed') AS failed, "
        "count(*) FILTER (outcome IS NULL) AS pending, "
        "count(*) FILTER (family = 'order') AS order_events_attempted, "
        "count(*) FILTER (family = 'log') AS log_events_attempted, "
        "count(*) FILTER (injection_kind = 'invalid') AS invalid_events_injected, "
        "count(*) FILTER (injection_kind = 'stale') AS stale_events_injected, "
        "count(*) FILTER (injection_kind = 'duplicate') AS duplicate_events_injected, "
        "count(*) FILTER (injection_kind = 'duplicate' AND outcome = 'delivered') "
        "AS duplicate_events_delivered FROM att"
    ),
    "invalid_by_type": (
        f"{_with(_ATTEMPTS)} SELECT invalid_kind, count(*) AS attempted FROM att "
        "WHERE invalid_kind IS NOT NULL GROUP BY 1"
    ),
    "delivery_rate": (
        f"{_with(_ATTEMPTS)} SELECT count(*) FILTER (outcome = 'delivered') AS delivered, "
        + _real(
            "count(*) FILTER (outcome = 'delivered') / "
            "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0)",
            "events_per_second",
        )
        + " FROM att"
    ),
}

# --- catalog ----------------------------------------------------------------------------


def _catalog(name: str, where: str) -> str:
    return f"""
{name}_ev AS (SELECT * FROM ev WHERE {where}),
{name}_col AS (
    SELECT DISTINCT ON (user_id, 'c' || (k % 40) || suffix)
           'model_' || user_id AS model, 'c' || (k % 40) || suffix AS col,
           CASE WHEN event_type = 'signup' THEN 'numeric' ELSE 'bigint' END AS data_type,
           value > 40 AS required, 'seen as ' || event_type AS description
    FROM (SELECT *, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '_count' WHEN 2 THEN '_rate'
                               WHEN 3 THEN '_ms' ELSE '_id' END AS suffix FROM {name}_ev)
    ORDER BY user_id, 'c' || (k % 40) || suffix, ts DESC, event_id DESC
),
{name}_mod AS (
    SELECT DISTINCT ON (user_id) 'model_' || user_id AS model,
           'Grain: one row per key' || (k % 4) AS grain, k % 5 <> 0 AS enforced,
           CASE WHEN k % 2 = 0 THEN 'table' ELSE 'view' END AS materialized,
           CASE WHEN k % 3 <> 0 THEN 'key' || (k % 3) END AS unique_key,
           event_type AS owner, (k % 6) || '0 minutes' AS sla,
           'unique:c' || (k % 3) AS key_test, 'not_null:c' || (k % 7) AS null_test
    FROM {name}_ev ORDER BY user_id, ts DESC, event_id DESC
)"""


def _changed(change: str, column: str) -> str:
    shown = [f"coalesce(CAST({side}.{column} AS VARCHAR), 'none')" for side in ("o", "n")]
    return (
        f"SELECT o.model, NULL AS \"column\", '{change}' AS change_type, "
        f"'previous=' || {shown[0]} || '|current=' || {shown[1]} AS evidence "
        f"FROM old_mod o JOIN new_mod n USING (model) "
        f"WHERE o.{column} IS DISTINCT FROM n.{column}"
    )


_FINDINGS = (
    _catalog("old", "ts < TIMESTAMP '2024-01-21'")
    + ","
    + _catalog("new", "ts >= TIMESTAMP '2024-01-11'")
    + f""",
shared AS (SELECT model FROM old_mod JOIN new_mod USING (model)),
gone AS (
    SELECT o.* FROM old_col o SEMI JOIN shared USING (model) ANTI JOIN new_col USING (model, col)
),
come AS (
    SELECT n.* FROM new_col n SEMI JOIN shared USING (model) ANTI JOIN old_col USING (model, col)
),
renamed AS (
    SELECT model, any_value(gone.col) AS was, any_value(come.col) AS becomes
    FROM gone JOIN come USING (model) GROUP BY model
    HAVING count(*) = 1 AND any_value(gone.data_type) = any_value(come.data_type)
),
raw_findings AS (
    SELECT model, NULL AS "column", 'published_model_removed' AS change_type,
           'model exists before only' AS evidence FROM old_mod ANTI JOIN new_mod USING (model)
    UNION ALL
    SELECT o.model, NULL, 'contract_removed', 'contract was enforced and is not now'
    FROM old_mod o JOIN new_mod n USING (model) WHERE o.enforced AND NOT n.enforced
    UNION ALL {_changed("grain_changed", "grain")}
    UNION ALL {_changed("business_key_changed", "key_test")}
    UNION ALL
    SELECT o.model, NULL, 'required_test_removed',
           concat_ws('|', CASE WHEN o.null_test <> n.null_test THEN o.null_test END,
                          CASE WHEN o.key_test <> n.key_test THEN o.key_test END)
    FROM old_mod o JOIN new_mod n USING (model)
    WHERE o.null_test <> n.null_test OR o.key_test <> n.key_test
    UNION ALL {_changed("materialization_changed", "materialized")}
    UNION ALL {_changed("incremental_key_changed", "unique_key")}
    UNION ALL {_changed("owner_changed", "owner")}
    UNION ALL {_changed("slo_changed", "sla")}
    UNION ALL
    SELECT model, was || ' -> ' || becomes, 'published_column_rename',
           'one column removed and one of the same type added' FROM renamed
    UNION ALL
    SELECT model, col, 'published_column_removed', 'column exists before only'
    FROM gone ANTI JOIN renamed USING (model)
    UNION ALL
    SELECT model, col, CASE WHEN required THEN 'required_column_added'
                            ELSE 'nullable_column_added' END, 'column exists now only'
    FROM come ANTI JOIN renamed USING (model)
    UNION ALL
    SELECT o.model, col, 'incompatible_data_type_change',
           'previous=' || o.data_type || '|current=' || n.data_type
    FROM old_col o JOIN new_col n USING (model, col) WHERE o.data_type <> n.data_type
    UNION ALL
    SELECT o.model, col, 'nullable_to_required', 'values are required now'
    FROM old_col o JOIN new_col n USING (model, col) WHERE NOT o.required AND n.required
    UNION ALL
    SELECT o.model, col, 'metric_description_changed', 'text changed; review the meaning'
    FROM old_col o JOIN new_col n USING (model, col)
    WHERE o.description <> n.description
      AND (suffix(col, '_count') OR suffix(col, '_amount') OR suffix(col, '_rate')
           OR suffix(col, '_ms'))
),
findings AS (
    SELECT *, CASE WHEN change_type IN ('required_column_added', 'metric_description_changed',
                        'materialization_changed', 'incremental_key_changed', 'owner_changed',
                        'slo_changed') THEN 'manual_review'
                   WHEN change_type = 'nullable_column_added' THEN 'info'
                   ELSE 'blocking' END AS severity
    FROM raw_findings
)"""
)
_EDGES = """
placed AS (
    SELECT 'customer.' || o_custkey AS customer, 'order.' || o_orderkey AS ord FROM orders
),
held AS (
    SELECT DISTINCT 'order.' || l_orderkey AS ord, 'part.' || l_partkey AS part FROM lineitem
),
supplied AS (
    SELECT DISTINCT 'part.' || l_partkey AS part, 'supplier.' || l_suppkey AS supplier FROM lineitem
)"""
_ASSETS = """
assets AS (
    SELECT 'customer.' || c_custkey AS asset_id, 'source' AS layer FROM customer
    UNION ALL SELECT 'order.' || o_orderkey, 'staging' FROM orders
    UNION ALL SELECT 'part.' || p_partkey, 'intermediate' FROM part
    UNION ALL SELECT 'supplier.' || s_suppkey, 'marts' FROM supplier
),
edges AS (
    SELECT customer AS upstream, ord AS downstream FROM placed
    UNION ALL SELECT * FROM held UNION ALL SELECT * FROM supplied
)"""
_DOWN = """
walk AS (
    SELECT upstream AS start, downstream AS node, 1 AS depth FROM edges
    WHERE upstream IN (SELECT asset_id FROM assets)
    UNION SELECT start, downstream, depth + 1 FROM walk JOIN edges ON upstream = node
)"""
_UP = """
walk AS (
    SELECT downstream AS start, upstream AS node, 1 AS depth FROM edges
    WHERE downstream LIKE 'part.%'
    UNION SELECT start, upstream, depth + 1 FROM walk JOIN edges ON downstream = node
)"""

_CATALOG = {
    "contract_findings": (
        f"{_with(_FINDINGS)} SELECT model, \"column\", change_type, severity, "
        "CASE severity WHEN 'blocking' THEN 'breaking' WHEN 'info' THEN 'non_breaking' "
        "ELSE 'potentially_breaking' END AS classification, evidence FROM findings"
    ),
    "contract_status": (
        f"{_with(_FINDINGS)} SELECT count(*) FILTER (severity = 'blocking') AS blocking_count, "
        "count(*) FILTER (severity = 'manual_review') AS manual_review_count, "
        "count(*) FILTER (severity = 'info') AS info_count, "
        "CASE WHEN blocking_count > 0 THEN 'blocked' ELSE 'passed' END AS status FROM findings"
    ),
    "contract_history": (
        f"{_with(_FINDINGS)} SELECT 'new' AS snapshot, "
        "count(*) FILTER (severity = 'blocking') AS blocking_count, "
        "count(*) FILTER (severity = 'manual_review') AS manual_review_count, "
        "count(*) FILTER (severity = 'info') AS info_count, "
        "CASE WHEN blocking_count > 0 THEN 'blocked' ELSE 'passed' END AS status FROM findings "
        "UNION ALL SELECT 'old', 0, 0, 0, 'previous_state_unavailable'"
    ),
    "lineage_edges": (
        f"WITH {_EDGES}, {_ASSETS} SELECT upstream, downstream FROM edges "
        "WHERE upstream IN (SELECT asset_id FROM assets)"
    ),
    "lineage_unknown_endpoints": (
        f"WITH {_EDGES}, {_ASSETS} SELECT DISTINCT asset_id FROM "
        "(SELECT upstream AS asset_id FROM edges UNION SELECT downstream FROM edges) "
        "WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE layer <> 'marts')"
    ),
    "lineage_reach": f"""WITH RECURSIVE {_EDGES}, {_ASSETS}, {_DOWN}
SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM walk
WHERE start LIKE 'customer.%' GROUP BY start, node""",
    "lineage_upstream": f"""WITH RECURSIVE {_EDGES}, {_ASSETS}, {_UP}
SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY start, node""",
    "lineage_walked_edges": f"""WITH {_EDGES}
SELECT ord AS upstream, part AS downstream FROM held
UNION
SELECT customer, ord FROM placed WHERE ord IN (SELECT ord FROM held)""",
    "finding_paths": f"""{_with(_FINDINGS, _EDGES)},
found AS (
    SELECT 'order.' || substr(model, 7) AS model, "column", change_type FROM findings
    WHERE severity = 'blocking'
),
paths AS (
    SELECT ord AS model, ord || '|' || part AS path FROM held
    UNION ALL SELECT ord, ord || '|' || part || '|' || supplier FROM held JOIN supplied USING (part)
)
SELECT model, "column", change_type, path FROM found JOIN paths USING (model)""",
    "lineage_impact": f"""WITH RECURSIVE {_EDGES}, {_ASSETS}, {_DOWN}
SELECT start, asset_id, layer, CAST(min(depth) AS BIGINT) AS depth, layer = 'marts' AS is_published
FROM walk JOIN assets ON node = asset_id WHERE start LIKE 'order.%'
GROUP BY start, asset_id, layer""",
    "impact_paths": f"""WITH {_EDGES},
starts AS (SELECT 'order.' || o_orderkey AS start FROM orders)
SELECT start, start || '|' || part AS path FROM starts JOIN held ON ord = start
UNION ALL
SELECT start, start || '|' || part || '|' || supplier FROM starts JOIN held ON ord = start
JOIN supplied USING (part)""",
    "impact_paths_to_published": f"""WITH {_EDGES},
steps AS (SELECT DISTINCT customer AS start, ord, part FROM placed JOIN held USING (ord)),
parts AS (SELECT start, part, min(ord) AS ord FROM steps GROUP BY start, part),
reached AS (
    SELECT start, supplier, min(part) AS part FROM parts JOIN supplied USING (part)
    GROUP BY start, supplier
)
SELECT start, start || '|' || ord || '|' || part || '|' || supplier AS path
FROM reached JOIN parts USING (start, part)""",
    "query_costs": f"""WITH {_ESTIMATES},
priced AS (
    SELECT *, CASE model WHEN 'mart_daily_sales' THEN 268435456 WHEN 'mart_service_health'
                   THEN 134217728 WHEN 'fct_orders' THEN 134217728 ELSE 536870912 END AS warning,
           CASE model WHEN 'mart_daily_sales' THEN 'medium' WHEN 'mart_service_health' THEN 'low'
                      WHEN 'fct_order_events' THEN 'high' WHEN 'fct_orders' THEN 'low_lookup'
                      ELSE 'default' END AS cost_class
    FROM est
),
judged AS (
    SELECT *, 2 * warning AS blocking,
           waived AND (NOT has_owner OR NOT has_reason OR expiry IN (0, 1) OR approved IS NULL)
               AS defective,
           coalesce(NOT defective AND bytes <= approved, false) AS within
    FROM priced
),
named AS (
    SELECT *, concat_ws('|',
        CASE WHEN NOT valid THEN 'fixture-validity' END,
        CASE WHEN bytes IS NULL THEN 'missing-estimate' END,
        CASE WHEN bytes < 0 THEN 'negative-estimate' END,
        CASE WHEN model <> 'fct_orders' AND NOT filtered THEN 'partition-filter' END,
        CASE WHEN requested <= 0 THEN 'scan-window-requested' END,
        CASE WHEN requested > maximum THEN 'scan-window-exceeded' END,
        CASE WHEN waived AND NOT has_owner THEN 'waiver-owner' END,
        CASE WHEN waived AND NOT has_reason THEN 'waiver-reason' END,
        CASE WHEN waived AND expiry = 0 THEN 'waiver-expiry' END,
        CASE WHEN waived AND expiry = 1 THEN 'waiver-expired' END,
        CASE WHEN waived AND approved IS NULL THEN 'waiver-threshold-missing' END,
        CASE WHEN bytes >= blocking AND NOT within THEN 'blocking-threshold' END,
        CASE WHEN bytes > approved THEN 'waiver-threshold' END) AS errors,
        CASE WHEN bytes >= warning AND bytes < blocking AND NOT within
             THEN 'warning-threshold' ELSE '' END AS warnings
    FROM judged
)
SELECT query_id, model,
       CASE WHEN NOT valid OR bytes IS NULL OR bytes < 0 THEN 'invalid' WHEN errors <> '' THEN 'block'
            WHEN warnings <> '' THEN 'warn' ELSE 'pass' END AS decision,
       bytes AS estimated_bytes, CAST(warning AS BIGINT) AS warning_threshold_bytes,
       CAST(blocking AS BIGINT) AS blocking_threshold_bytes, cost_class, errors, warnings,
       coalesce(within AND bytes >= blocking, false) AS waiver_applied
FROM named""",
    "loosened_thresholds": """
WITH both_sides AS (
    SELECT 'part.' || p_partkey AS model, CAST(floor(p_retailprice * 1000) AS BIGINT) AS old_bytes,
           old_bytes + (p_size - 25) * 1000 AS new_bytes,
           p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0
               AND CAST(floor(p_retailprice * 1010) AS BIGINT) >= new_bytes AS covered
    FROM part
)
SELECT model,
       CASE WHEN covered THEN 'blocking_threshold_loosened_with_waiver'
            ELSE 'blocking_threshold_loosened' END AS change_type,
       CASE WHEN covered THEN 'info' ELSE 'blocking' END AS severity,
       CASE WHEN covered THEN 'potentially_breaking' ELSE 'breaking' END AS classification,
       old_bytes AS previous_bytes, CAST(new_bytes AS BIGINT) AS current_bytes
FROM both_sides WHERE new_bytes > old_bytes""",
    "asset_table": f"""WITH {_RESULTS}
SELECT asset_id,
       CASE WHEN o_orderkey % 10 <> 0 THEN 'order ' || o_orderkey
            ELSE CAST(o_orderkey AS VARCHAR) END AS name,
       CASE WHEN o_orderkey % 6 = 0 THEN 'source' ELSE 'model' END AS resource_type,
       CASE WHEN o_orderkey % 6 = 0 THEN 'source' WHEN o_orderkey % 4 <> 0 THEN 'marts'
            ELSE 'unknown' END AS layer,
       CASE o_orderkey % 3 WHEN 0 THEN 'Grain: one row per order. Total below.'
                           WHEN 1 THEN 'Orders by priority.' ELSE '' END AS description,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Grain: one row per order' END AS grain,
       CASE WHEN o_orderstatus = 'F' THEN 'enforced' ELSE 'not_enforced' END AS contract_status,
       CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'pass'
                                               ELSE 'warn' END END AS freshness_status,
       quality_status, fail_count, warn_count, pass_count, other_count
FROM orders JOIN quality ON asset_id = 'order.' || o_orderkey""",
    "asset_columns": """
SELECT 'order.' || l_orderkey AS asset_id, 'line_' || l_linenumber AS "column",
       CASE WHEN l_linenumber > 2 THEN 'bigint' ELSE 'numeric' END AS data_type,
       NOT (max(l_quantity) > 25) AS nullable,
       CASE WHEN max(l_returnflag) <> 'A' THEN 'flag ' || max(l_returnflag) ELSE '' END AS description
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "scrubbed_pages": r"""
SELECT page_id,
       regexp_replace(regexp_replace(url, '(?i)(postgres(?:ql)?|https?)://[^\s"'']+', '[REDACTED]', 'g'),
                      '(?i)bearer\s+[a-z0-9._~+/-]+', '[REDACTED]', 'g') AS url,
       regexp_replace(regexp_replace(html, '(?i)(postgres(?:ql)?|https?)://[^\s"'']+', '[REDACTED]', 'g'),
                      '(?i)bearer\s+[a-z0-9._~+/-]+', '[REDACTED]', 'g') AS html
FROM pages""",
    "scrubbed_conversations": r"""
SELECT conv_id, turn,
       regexp_replace(regexp_replace('Bearer abc.DEF-1~ said: ' || text,
                          '(?i)(postgres(?:ql)?|https?)://[^\s"'']+', '[REDACTED]', 'g'),
                      '(?i)bearer\s+[a-z0-9._~+/-]+', '[REDACTED]', 'g') AS text,
       '[REDACTED]' AS access_token, '[REDACTED] ' || role AS origin
FROM conversations""",
}


def all_oracles() -> dict[str, str]:
    return {**_MODELS, **_INGESTION, **_QUALITY, **_EVIDENCE, **_CATALOG}
