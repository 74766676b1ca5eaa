"""Staging models: typed projections of the three stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import safe_divide, utc_date
from ledgerline.schemas import MONEY


def order_events(valid_orders: DataFrame) -> DataFrame:
    """Order events with their UTC date; ``created_at`` becomes ``persisted_at``."""
    return valid_orders.select(
        F.col("event_id").cast("string"),
        F.col("order_id").cast("string"),
        F.col("event_type").cast("string"),
        F.col("user_id").cast("string"),
        F.col("product_id").cast("string"),
        F.col("quantity").cast("int"),
        F.col("amount").cast(MONEY),
        F.col("currency").cast("string"),
        F.col("channel").cast("string"),
        F.col("event_time").cast("timestamp"),
        utc_date("event_time").alias("event_date"),
        F.col("kafka_topic").cast("string"),
        F.col("kafka_partition").cast("int"),
        F.col("kafka_offset").cast("bigint"),
        F.col("created_at").cast("timestamp").alias("persisted_at"),
    )


def processed_events(markers: DataFrame) -> DataFrame:
    """Idempotency markers with the coordinate columns under their common names."""
    return markers.select(
        F.col("consumer_group").cast("string"),
        F.col("event_id").cast("string"),
        F.col("topic").cast("string").alias("kafka_topic"),
        F.col("partition_id").cast("int").alias("kafka_partition"),
        F.col("offset_id").cast("bigint").alias("kafka_offset"),
        F.col("processed_at").cast("timestamp"),
    )


def minute_metrics(log_metrics: DataFrame) -> DataFrame:
    """Endpoint minutes with their UTC date and guarded average latency."""
    return log_metrics.select(
        F.col("metric_minute").cast("timestamp"),
        utc_date("metric_minute").alias("metric_date"),
        F.col("service").cast("string"),
        F.col("endpoint").cast("string"),
        F.col("request_count").cast("bigint"),
        F.col("success_count").cast("bigint"),
        F.col("client_error_count").cast("bigint"),
        F.col("server_error_count").cast("bigint"),
        F.col("response_time_sum_ms").cast("bigint"),
        safe_divide("response_time_sum_ms", "request_count").alias("average_response_time_ms"),
        F.col("max_response_time_ms").cast("int"),
        F.col("updated_at").cast("timestamp"),
    )
