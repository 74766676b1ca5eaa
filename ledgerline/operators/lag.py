"""Consumer lag over offset tables. An unknown lag stays NULL; it is never clamped to zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_lag(end_offsets: DataFrame, committed: DataFrame, groups: DataFrame) -> DataFrame:
    """Lag of every partition a group should read.

    ``groups``: consumer_group, topic, is_established. ``end_offsets``: topic, partition,
    log_end_offset. ``committed``: consumer_group, topic, partition, committed_offset.
    """
    expected = groups.join(end_offsets, "topic").join(
        committed, ["consumer_group", "topic", "partition"], "left"
    )
    known = F.when(F.col("committed_offset") >= 0, F.col("committed_offset"))
    difference = F.col("log_end_offset") - known
    established = F.col("is_established")
    status = (
        F.when(~established, F.lit("group_not_established"))
        .when(known.isNull(), F.lit("offset_not_available"))
        .when(difference < 0, F.lit("invalid_negative_lag"))
        .otherwise(F.lit("measured"))
    )
    return expected.select(
        "consumer_group",
        "topic",
        "partition",
        F.when(established, known).alias("current_offset"),
        F.when(established, F.col("log_end_offset")).alias("log_end_offset"),
        F.when(status == "measured", difference).alias("lag"),
        status.alias("status"),
    )


def _total_if_complete(value: str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def group_lag(partitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total lag per group and topic, only where every partition is measured."""
    keys = [*by, "consumer_group", "topic"]
    unestablished = F.bool_and(F.col("status") == "group_not_established")
    return partitions.groupBy(*keys).agg(
        _total_if_complete("lag").alias("total_lag"),
        F.when(unestablished, F.lit("group_not_established"))
        .when(F.count("lag") == F.count(F.lit(1)), F.lit("measured"))
        .otherwise(F.lit("partial"))
        .alias("status"),
    )


def combined_lag(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over groups; NULL when any group total is unknown."""
    return groups.groupBy(*by).agg(_total_if_complete("total_lag").alias("combined_total_lag"))


def benchmark_lag(partitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total lag in which an unknown lag counts as zero only for a provably empty partition."""
    unknown = F.col("lag").isNull() & ~F.coalesce(F.col("log_end_offset") == 0, F.lit(False))
    total = F.sum(F.coalesce("lag", F.lit(0)))
    return partitions.groupBy(*by).agg(
        F.when(~F.bool_or(unknown), total).alias("benchmark_lag")
    )


def observed_lag(snapshots: DataFrame) -> DataFrame:
    """One row: highest measured lag and the lag of the last snapshot (which may be NULL)."""
    return snapshots.agg(
        F.max("benchmark_lag").alias("max_lag"),
        F.max_by("benchmark_lag", "observed_at").alias("final_lag"),
    )
