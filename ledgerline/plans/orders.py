"""Order lifecycle models: event sequence facts and latest order state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sequencing import SEGMENT_OFFSETS, order_event_sequence
from ledgerline.schemas import FCT_ORDER_EVENTS, FCT_ORDERS, ORDER_STATES

STREAM_ORDER = ("kafka_topic", "kafka_partition", "kafka_offset", "event_id")


def is_type(*event_types: str) -> Column:
    return F.col("event_type").isin(*event_types)


def state_of(event_type: Column) -> Column:
    """Order state named by an event type; NULL for an unknown type."""
    state = F.lit(None).cast("string")
    for kind, name in ORDER_STATES.items():
        state = F.when(event_type == kind, F.lit(name)).otherwise(state)
    return state


def latest_order_state(events: DataFrame, order_by: Sequence[str] = STREAM_ORDER) -> DataFrame:
    """One row per order: first/last picks per event type, counts, flags and latest state.

    Works on staging events directly. Every pick is the minimum or maximum of a struct that
    starts with the stream order, so the whole model is one aggregate with map-side partial
    results: a hot order shrinks to one row per map task before the shuffle, and neither a
    window nor a self-join is needed.
    """

    def pick(function, *values: str, only: str | None = None) -> Column:
        candidate = F.struct(*order_by, *values)
        return function(candidate if only is None else F.when(is_type(only), candidate))

    picked = events.groupBy("order_id").agg(
        F.min("event_time").alias("earliest_observed_event_time"),
        F.count(F.lit(1)).alias("order_event_count"),
        pick(F.min, "user_id").alias("_first"),
        pick(
            F.min,
            "product_id",
            "quantity",
            "channel",
            "currency",
            "amount",
            "event_time",
            only="order_created",
        ).alias("_created"),
        pick(F.min, "event_time", only="order_paid").alias("_first_paid"),
        pick(F.max, "event_time", "amount", "currency", only="order_paid").alias("_last_paid"),
        pick(F.max, "event_time", only="payment_failed").alias("_last_failed"),
        pick(F.min, "event_time", only="order_cancelled").alias("_cancelled"),
        pick(F.max, "event_time", "event_type").alias("_latest"),
        F.count_if(is_type("order_paid", "payment_failed")).alias("payment_attempt_count"),
        F.count_if(is_type("payment_failed")).alias("payment_failure_count"),
        F.bool_or(is_type("order_paid")).alias("is_paid"),
        F.bool_or(is_type("order_cancelled")).alias("is_cancelled"),
    )
    return picked.select(
        "order_id",
        "earliest_observed_event_time",
        "order_event_count",
        F.col("_first.user_id").alias("user_id"),
        F.col("_created.product_id").alias("product_id"),
        F.col("_created.quantity").alias("quantity"),
        F.col("_created.channel").alias("channel"),
        F.col("_created.currency").alias("currency"),
        F.col("_created.amount").alias("original_order_amount"),
        F.col("_created.event_time").alias("order_created_at"),
        F.col("_first_paid.event_time").alias("first_paid_at"),
        F.col("_last_paid.event_time").alias("latest_paid_at"),
        F.col("_last_paid.amount").alias("latest_paid_amount"),
        F.col("_last_paid.currency").alias("latest_paid_currency"),
        F.col("_last_failed.event_time").alias("latest_payment_failed_at"),
        F.col("_cancelled.event_time").alias("cancelled_at"),
        "payment_attempt_count",
        "payment_failure_count",
        "is_paid",
        "is_cancelled",
        F.col("_latest.event_time").alias("latest_event_at"),
        F.col("_latest.event_type").alias("latest_event_type"),
        state_of(F.col("_latest.event_type")).alias("latest_order_state"),
    )


def fct_order_events(order_events: DataFrame, segment_offsets: int = SEGMENT_OFFSETS) -> DataFrame:
    """The published event fact: staging events with their stream sequence."""
    return order_event_sequence(order_events, segment_offsets).select(*FCT_ORDER_EVENTS.columns)


def fct_orders(order_events: DataFrame) -> DataFrame:
    """The published order fact: one row per order."""
    return latest_order_state(order_events).select(*FCT_ORDERS.columns)
