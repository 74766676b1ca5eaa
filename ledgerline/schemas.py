"""Table schemas and mart contracts, stated as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(38, 18)

# Event types, enumerations and storage widths.
ORDER_EVENT_TYPES = ("order_created", "order_paid", "order_cancelled", "payment_failed")
ACCESS_EVENT_TYPE = "api_access_log"
ERROR_LOG_EVENT_TYPE = "application_error_log"
CURRENCIES = ("TWD", "USD")
CHANNELS = ("web", "ios", "android")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
ORDER_STATES = {
    "order_created": "created",
    "order_paid": "paid",
    "order_cancelled": "cancelled",
    "payment_failed": "payment_failed",
}

RAW_RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

VALID_ORDERS = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("order_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("product_id", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("kafka_topic", T.StringType(), False),
        T.StructField("kafka_partition", T.IntegerType(), False),
        T.StructField("kafka_offset", T.LongType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

PROCESSED_EVENTS = T.StructType(
    [
        T.StructField("consumer_group", T.StringType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition_id", T.IntegerType(), False),
        T.StructField("offset_id", T.LongType(), False),
        T.StructField("processed_at", T.TimestampType(), False),
    ]
)

LOG_METRICS_MINUTE = T.StructType(
    [
        T.StructField("metric_minute", T.TimestampType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("endpoint", T.StringType(), False),
        T.StructField("request_count", T.LongType(), False),
        T.StructField("success_count", T.LongType(), False),
        T.StructField("client_error_count", T.LongType(), False),
        T.StructField("server_error_count", T.LongType(), False),
        T.StructField("response_time_sum_ms", T.LongType(), False),
        T.StructField("max_response_time_ms", T.IntegerType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("dlq_key", T.StringType(), False),
        T.StructField("failed_at", T.TimestampType(), False),
        T.StructField("error_type", T.StringType(), False),
        T.StructField("error_message", T.StringType(), False),
        T.StructField("original_topic", T.StringType(), False),
        T.StructField("original_partition", T.IntegerType(), False),
        T.StructField("original_offset", T.LongType(), False),
        T.StructField("consumer_group", T.StringType(), False),
        T.StructField("original_key", T.StringType(), False),
        T.StructField("original_payload", T.StringType(), False),
        T.StructField("original_payload_encoding", T.StringType(), False),
    ]
)

LAG_REPORT = T.StructType(
    [
        T.StructField("observed_at", T.TimestampType()),
        T.StructField(
            "groups",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("consumer_group", T.StringType()),
                        T.StructField("topic", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("total_lag", T.LongType()),
                        T.StructField(
                            "rows",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("consumer_group", T.StringType()),
                                        T.StructField("topic", T.StringType()),
                                        T.StructField("partition", T.IntegerType()),
                                        T.StructField("current_offset", T.LongType()),
                                        T.StructField("log_end_offset", T.LongType()),
                                        T.StructField("lag", T.LongType()),
                                        T.StructField("status", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

TEST_RESULTS = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("unique_id", T.StringType()),
                        T.StructField("status", T.StringType()),
                    ]
                )
            ),
        )
    ]
)


@dataclass(frozen=True)
class Contract:
    """Published columns of a mart: order, types and which must never be NULL."""

    name: str
    schema: T.StructType
    partition_column: str | None
    unique_key: tuple[str, ...]
    lookback_days: int
    maximum_scan_days: int

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def required(self) -> list[str]:
        return [field.name for field in self.schema if not field.nullable]


def _contract(name, columns, **policy) -> Contract:
    fields = [T.StructField(column, kind, not required) for column, kind, required in columns]
    return Contract(name=name, schema=T.StructType(fields), **policy)


_TEXT, _INT, _BIG = T.StringType(), T.IntegerType(), T.LongType()
_TIME, _DATE, _BOOL = T.TimestampType(), T.DateType(), T.BooleanType()
_REQUIRED, _OPTIONAL = True, False

FCT_ORDER_EVENTS = _contract(
    "fct_order_events",
    [
        ("event_id", _TEXT, _REQUIRED),
        ("order_id", _TEXT, _REQUIRED),
        ("event_type", _TEXT, _REQUIRED),
        ("user_id", _TEXT, _REQUIRED),
        ("product_id", _TEXT, _OPTIONAL),
        ("quantity", _INT, _OPTIONAL),
        ("amount", MONEY, _OPTIONAL),
        ("currency", _TEXT, _OPTIONAL),
        ("channel", _TEXT, _OPTIONAL),
        ("event_time", _TIME, _REQUIRED),
        ("event_date", _DATE, _REQUIRED),
        ("kafka_topic", _TEXT, _REQUIRED),
        ("kafka_partition", _INT, _REQUIRED),
        ("kafka_offset", _BIG, _REQUIRED),
        ("persisted_at", _TIME, _REQUIRED),
        ("event_sequence_number", _BIG, _REQUIRED),
        ("previous_event_type", _TEXT, _OPTIONAL),
        ("next_event_type", _TEXT, _OPTIONAL),
        ("previous_event_time", _TIME, _OPTIONAL),
        ("seconds_since_previous_event", T.DecimalType(20, 6), _OPTIONAL),
        ("first_event_time", _TIME, _REQUIRED),
        ("latest_event_time", _TIME, _REQUIRED),
    ],
    partition_column="event_date",
    unique_key=("event_id",),
    lookback_days=7,
    maximum_scan_days=31,
)

FCT_ORDERS = _contract(
    "fct_orders",
    [
        ("order_id", _TEXT, _REQUIRED),
        ("user_id", _TEXT, _REQUIRED),
        ("product_id", _TEXT, _OPTIONAL),
        ("quantity", _INT, _OPTIONAL),
        ("currency", _TEXT, _OPTIONAL),
        ("channel", _TEXT, _OPTIONAL),
        ("order_created_at", _TIME, _OPTIONAL),
        ("first_paid_at", _TIME, _OPTIONAL),
        ("latest_paid_at", _TIME, _OPTIONAL),
        ("latest_payment_failed_at", _TIME, _OPTIONAL),
        ("cancelled_at", _TIME, _OPTIONAL),
        ("latest_event_at", _TIME, _REQUIRED),
        ("latest_event_type", _TEXT, _REQUIRED),
        ("latest_order_state", _TEXT, _REQUIRED),
        ("original_order_amount", MONEY, _OPTIONAL),
        ("latest_paid_amount", MONEY, _OPTIONAL),
        ("latest_paid_currency", _TEXT, _OPTIONAL),
        ("payment_attempt_count", _BIG, _REQUIRED),
        ("payment_failure_count", _BIG, _REQUIRED),
        ("order_event_count", _BIG, _REQUIRED),
        ("is_paid", _BOOL, _REQUIRED),
        ("is_cancelled", _BOOL, _REQUIRED),
    ],
    partition_column=None,
    unique_key=("order_id",),
    lookback_days=7,
    maximum_scan_days=31,
)

MART_DAILY_SALES = _contract(
    "mart_daily_sales",
    [
        ("event_date", _DATE, _REQUIRED),
        ("currency", _TEXT, _OPTIONAL),
        ("channel", _TEXT, _OPTIONAL),
        ("created_order_count", _BIG, _REQUIRED),
        ("created_order_amount", MONEY, _REQUIRED),
        ("paid_order_count", _BIG, _REQUIRED),
        ("paid_amount", MONEY, _REQUIRED),
        ("cancelled_order_count", _BIG, _REQUIRED),
        ("payment_failed_order_count", _BIG, _REQUIRED),
        ("payment_failed_amount", MONEY, _REQUIRED),
        ("payment_attempt_count", _BIG, _REQUIRED),
        ("payment_success_rate", RATE, _OPTIONAL),
    ],
    partition_column="event_date",
    unique_key=("event_date", "currency", "channel"),
    lookback_days=7,
    maximum_scan_days=31,
)

MART_SERVICE_HEALTH = _contract(
    "mart_service_health",
    [
        ("metric_minute", _TIME, _REQUIRED),
        ("metric_date", _DATE, _REQUIRED),
        ("service", _TEXT, _REQUIRED),
        ("request_count", _BIG, _REQUIRED),
        ("success_count", _BIG, _REQUIRED),
        ("client_error_count", _BIG, _REQUIRED),
        ("server_error_count", _BIG, _REQUIRED),
        ("error_count", _BIG, _REQUIRED),
        ("success_rate", RATE, _OPTIONAL),
        ("error_rate", RATE, _OPTIONAL),
        ("weighted_average_response_time_ms", RATE, _OPTIONAL),
        ("max_response_time_ms", _INT, _REQUIRED),
        ("endpoint_count", _BIG, _REQUIRED),
    ],
    partition_column="metric_date",
    unique_key=("metric_minute", "service"),
    lookback_days=2,
    maximum_scan_days=7,
)

CONTRACTS = {
    contract.name: contract
    for contract in (FCT_ORDER_EVENTS, FCT_ORDERS, MART_DAILY_SALES, MART_SERVICE_HEALTH)
}
