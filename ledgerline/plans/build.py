"""Build order of the models, their declared checks, and publication of the marts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.operators import quality
from ledgerline.operators.quality import Suite
from ledgerline.plans import health, orders, sales, staging
from ledgerline.plans.marts import read_mart_files, write_slices
from ledgerline.schemas import CHANNELS, CONTRACTS, CURRENCIES, ORDER_EVENT_TYPES, ORDER_STATES


@dataclass(frozen=True)
class Models:
    """Every model as a lazily composed DataFrame."""

    stg_order_events: DataFrame
    stg_processed_events: DataFrame
    stg_log_metrics_minute: DataFrame
    int_order_event_sequence: DataFrame
    int_order_latest_state: DataFrame
    int_service_minute_metrics: DataFrame
    fct_order_events: DataFrame
    fct_orders: DataFrame
    mart_daily_sales: DataFrame
    mart_service_health: DataFrame

    def register_views(self) -> None:
        """Make the models queryable by name in SQL."""
        for name, model in vars(self).items():
            model.createOrReplaceTempView(name)


def build(
    valid_orders: DataFrame, processed_events: DataFrame, log_metrics_minute: DataFrame
) -> Models:
    events = staging.order_events(valid_orders)
    minutes = staging.minute_metrics(log_metrics_minute)
    sequence = orders.order_event_sequence(events)
    service_minutes = health.service_minute_metrics(minutes)
    return Models(
        stg_order_events=events,
        stg_processed_events=staging.processed_events(processed_events),
        stg_log_metrics_minute=minutes,
        int_order_event_sequence=sequence,
        int_order_latest_state=orders.latest_order_state(events),
        int_service_minute_metrics=service_minutes,
        fct_order_events=orders.fct_order_events(events),
        fct_orders=orders.fct_orders(events),
        mart_daily_sales=sales.daily_sales(events),
        mart_service_health=health.service_health(service_minutes),
    )


MARTS = ("fct_order_events", "fct_orders", "mart_daily_sales", "mart_service_health")


def publish(models: Models, root: str) -> dict[str, str]:
    """Rebuild all marts under ``root``, which must not hold the sources being read.

    Daily sales is rolled up from the written order fact instead of being derived again.
    """
    spark = models.fct_orders.sparkSession
    for name in MARTS:
        table = getattr(models, name)
        if name == "mart_daily_sales":
            table = sales.daily_sales(
                models.stg_order_events, read_mart_files(spark, root, "fct_orders")
            )
        write_slices(table, root, CONTRACTS[name])
    return {name: f"{root}/{name}" for name in MARTS}


# --- declared checks --------------------------------------------------------------------
# The column names, conditions and accepted values that the checks declare.

COORDINATE = ("kafka_topic", "kafka_partition", "kafka_offset")
_CREATED = "event_type = 'order_created'"
_PRICED = "event_type in ('order_created', 'order_paid', 'payment_failed')"


def _missing(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{name} not null": quality.is_missing(name) for name in columns}


def _negative(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{name} non-negative": quality.is_negative(name) for name in columns}


def _accepted(column: str, values: Sequence[str], where: str | None = None) -> dict[str, Column]:
    return {f"{column} accepted": quality.not_accepted(column, values, where)}


def source_suites(
    valid_orders: DataFrame, processed_events: DataFrame, log_metrics: DataFrame
) -> list[Suite]:
    """Checks declared on the three stored tables."""
    due = {
        "product_id": _CREATED,
        "quantity": _CREATED,
        "channel": _CREATED,
        "amount": _PRICED,
        "currency": _PRICED,
    }
    orders_suite = Suite(
        "valid_orders",
        valid_orders,
        {
            **_missing((
                "event_id", "order_id", "event_type", "user_id",
                "event_time", "kafka_topic", "kafka_partition",
                "kafka_offset", "created_at",
            )),
            **_negative(("kafka_partition", "kafka_offset")),
            **_accepted("event_type", ORDER_EVENT_TYPES),
            **_accepted("currency", CURRENCIES, "currency is not null"),
            **_accepted("channel", CHANNELS, "channel is not null"),
            **{
                f"{name} present when due": quality.missing_when(name, condition)
                for name, condition in due.items()
            },
            "quantity positive": quality.not_positive("quantity"),
            "amount positive": quality.not_positive("amount"),
        },
        {
            "event_id unique": quality.unique_key("event_id"),
            "coordinate unique": quality.unique_keys(COORDINATE),
        },
    )
    marker_suite = Suite(
        "processed_events",
        processed_events,
        {
            **_missing((
                "consumer_group", "event_id", "topic", "partition_id",
                "offset_id", "processed_at",
            )),
            **_negative(("partition_id", "offset_id")),
        },
        {
            "marker unique": quality.unique_keys(("consumer_group", "event_id"))
        },
    )
    # Column names.
    counters = (
        "request_count", "success_count", "client_error_count",
        "server_error_count", "response_time_sum_ms", "max_response_time_ms",
    )
    minute_key = ["metric_minute", "service", "endpoint"]
    minute_suite = Suite(
        "log_metrics_minute",
        log_metrics,
        {
            **_missing((*minute_key, *counters, "updated_at")),
            **_negative(counters),
            "counts add up": quality.counts_differ(),
        },
        {"key unique": quality.unique_keys(minute_key)},
    )
    return [orders_suite, marker_suite, minute_suite]


def order_suite(stg_order_events: DataFrame) -> Suite:
    """Consistency of all events of one order."""
    return Suite(
        "stg_order_events",
        stg_order_events,
        key_checks={
            "order in one partition": quality.one_value(("kafka_topic", "kafka_partition"), "order_id"),
            "order of one user": quality.one_value(("user_id",), "order_id"),
            "order in one currency": quality.one_value(("currency",), "order_id"),
            "coordinate unique": quality.unique_keys(COORDINATE),
        },
    )


def mart_suites(
    fct_order_events: DataFrame,
    fct_orders: DataFrame,
    mart_daily_sales: DataFrame,
    mart_service_health: DataFrame,
) -> list[Suite]:
    """Checks declared on the published marts."""
    # Column names.
    sales_measures = (
        "created_order_count", "created_order_amount", "paid_order_count",
        "paid_amount", "cancelled_order_count", "payment_failed_order_count",
        "payment_failed_amount", "payment_attempt_count",
    )
    # Column names.
    service_measures = (
        "request_count", "success_count", "client_error_count",
        "server_error_count", "error_count", "max_response_time_ms",
    )
    return [
        Suite(
            "fct_order_events",
            fct_order_events,
            {
                **_missing(("event_id", "order_id", "event_type", "user_id")),
                **_accepted("event_type", ORDER_EVENT_TYPES),
            },
            {"event_id unique": quality.unique_key("event_id")},
        ),
        Suite(
            "fct_orders",
            fct_orders,
            {
                **_missing(("order_id", "user_id")),
                **_accepted("latest_order_state", tuple(ORDER_STATES.values())),
                **_negative(("payment_attempt_count", "payment_failure_count")),
                "order_event_count positive": quality.not_positive("order_event_count"),
            },
            {"order_id unique": quality.unique_key("order_id")},
        ),
        Suite(
            "mart_daily_sales",
            mart_daily_sales,
            {
                **_missing(("event_date",)),
                **_accepted("currency", CURRENCIES, "currency is not null"),
                **_accepted("channel", CHANNELS, "channel is not null"),
                **_negative(sales_measures),
            },
            {
                "key unique": quality.unique_keys(("event_date", "currency", "channel"))
            },
        ),
        Suite(
            "mart_service_health",
            mart_service_health,
            {
                **_missing(("metric_minute", "metric_date", "service")),
                "counts add up": quality.counts_differ(),
                **_negative(service_measures),
                "endpoint_count positive": quality.not_positive("endpoint_count"),
            },
            {
                "key unique": quality.unique_keys(("metric_minute", "service"))
            },
        ),
    ]
