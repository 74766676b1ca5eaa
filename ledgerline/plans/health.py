"""Service health from per-minute endpoint metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import safe_divide, status_flags, utc_minute
from ledgerline.schemas import MART_SERVICE_HEALTH

MINUTE_KEY = ["metric_minute", "service", "endpoint"]
ADDITIVE = [
    "request_count",
    "success_count",
    "client_error_count",
    "server_error_count",
    "response_time_sum_ms",
]


def access_contributions(access_events: DataFrame) -> DataFrame:
    """One additive contribution per access-log event, keyed by its event-time minute."""
    return access_events.withColumns(
        {
            "metric_minute": utc_minute("event_time"),
            "request_count": F.lit(1),
            **status_flags("status_code"),
            "response_time_sum_ms": F.col("response_time_ms"),
            "max_response_time_ms": F.col("response_time_ms"),
        }
    )


def combine_minutes(contributions: DataFrame, *more: str) -> DataFrame:
    """Add contributions (or earlier sums) per key; sums and maxima are associative."""
    return contributions.groupBy(*MINUTE_KEY, *more).agg(
        *[F.sum(F.col(name).cast("bigint")).alias(name) for name in ADDITIVE],
        F.max("max_response_time_ms").cast("int").alias("max_response_time_ms"),
        F.max("updated_at").alias("updated_at"),
    )


def minute_metrics_from_access_events(access_events: DataFrame) -> DataFrame:
    """Batch form of the minute table: any event age is counted in its own minute."""
    return combine_minutes(access_contributions(access_events))


def service_minute_metrics(minute_metrics: DataFrame) -> DataFrame:
    """Endpoint minutes with guarded success and error rates."""
    errors = F.col("client_error_count") + F.col("server_error_count")
    return minute_metrics.withColumns(
        {
            "success_rate": safe_divide("success_count", "request_count"),
            "client_error_rate": safe_divide("client_error_count", "request_count"),
            "server_error_rate": safe_divide("server_error_count", "request_count"),
            "error_rate": safe_divide(errors, "request_count"),
        }
    )


def service_health(service_minutes: DataFrame) -> DataFrame:
    """Health per minute and service; rates and latency come from sums, never averages."""
    totals = service_minutes.groupBy("metric_minute", "metric_date", "service").agg(
        *[F.sum(name).cast("bigint").alias(name) for name in ADDITIVE],
        F.max("max_response_time_ms").cast("int").alias("max_response_time_ms"),
        F.countDistinct("endpoint").alias("endpoint_count"),
    )
    error_count = F.col("client_error_count") + F.col("server_error_count")
    return totals.withColumns(
        {
            "error_count": error_count,
            "success_rate": safe_divide("success_count", "request_count"),
            "error_rate": safe_divide(error_count, "request_count"),
            "weighted_average_response_time_ms": safe_divide(
                "response_time_sum_ms", "request_count"
            ),
        }
    ).select(*MART_SERVICE_HEALTH.columns)
