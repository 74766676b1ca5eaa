"""Counters over a table of delivery attempts.

Columns: family, injection_kind, invalid_kind (NULL unless invalid), outcome
('delivered', 'failed' or NULL while pending), latency_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivery_counters(attempts: DataFrame) -> DataFrame:
    """One row of counters over all attempts."""
    delivered = F.col("outcome") == "delivered"

    def kind(name: str):
        return F.col("injection_kind") == name

    return attempts.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(delivered).alias("delivered"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome").isNull()).alias("pending"),
        F.count_if(F.col("family") == "order").alias("order_events_attempted"),
        F.count_if(F.col("family") == "log").alias("log_events_attempted"),
        F.count_if(kind("invalid")).alias("invalid_events_injected"),
        F.count_if(kind("stale")).alias("stale_events_injected"),
        F.count_if(kind("duplicate")).alias("duplicate_events_injected"),
        F.count_if(kind("duplicate") & delivered).alias("duplicate_events_delivered"),
    )


def invalid_by_type(attempts: DataFrame) -> DataFrame:
    """Attempts per kind of deliberate defect."""
    return (
        attempts.filter(F.col("invalid_kind").isNotNull())
        .groupBy("invalid_kind")
        .agg(F.count(F.lit(1)).alias("attempted"))
    )
