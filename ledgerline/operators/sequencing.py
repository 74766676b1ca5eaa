"""Per-order stream sequence that stays parallel when one order is huge.

A plain window over ``order_id`` would put a hot order into a single task. Here the
window runs over (order, topic, partition, offset segment) instead. Segments are fixed
ranges of Kafka offsets, so they are contiguous in stream order and a segment never holds
more than ``segment_offsets`` coordinates. Orders that span several segments get the
missing context (rows before, neighbouring events, outer times) from one pre-aggregated
row per segment. The segment number depends on the row alone, so recomputed tasks agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import seconds_between

SEGMENT_OFFSETS = 1_000_000

_SEGMENT_KEY = ["order_id", "kafka_topic", "kafka_partition", "_segment"]
_SEGMENT_ORDER = ["kafka_offset", "event_id"]


def order_event_sequence(
    order_events: DataFrame, segment_offsets: int = SEGMENT_OFFSETS
) -> DataFrame:
    """Number each order's events by (topic, partition, offset, event_id) and add neighbours."""
    events = order_events.withColumn("_segment", F.expr(f"kafka_offset div {segment_offsets}"))
    carried = _segment_context(events)

    within = Window.partitionBy(*_SEGMENT_KEY).orderBy(*_SEGMENT_ORDER)
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = events.withColumns(
        {
            "_row": F.row_number().over(within).cast("bigint"),
            "_has_next": F.lead(F.lit(True), 1, False).over(within),
            "_previous_type": F.lag("event_type").over(within),
            "_previous_time": F.lag("event_time").over(within),
            "_next_type": F.lead("event_type").over(within),
            "_first_time": F.first("event_time").over(whole),
            "_last_time": F.last("event_time").over(whole),
        }
    )
    joined = local.join(carried, _SEGMENT_KEY, "left")
    spans = F.col("_rows_before").isNotNull()
    is_first = F.col("_row") == 1
    previous_time = F.when(is_first, F.col("_before_time")).otherwise(F.col("_previous_time"))
    return joined.select(
        *order_events.columns,
        (F.col("_row") + F.coalesce("_rows_before", F.lit(0))).alias("event_sequence_number"),
        F.when(is_first, F.col("_before_type"))
        .otherwise(F.col("_previous_type"))
        .alias("previous_event_type"),
        F.when(F.col("_has_next"), F.col("_next_type"))
        .otherwise(F.col("_after_type"))
        .alias("next_event_type"),
        previous_time.alias("previous_event_time"),
        F.when(spans, F.col("_order_first_time"))
        .otherwise(F.col("_first_time"))
        .alias("first_event_time"),
        F.when(spans, F.col("_order_last_time"))
        .otherwise(F.col("_last_time"))
        .alias("latest_event_time"),
        seconds_between(F.col("event_time"), previous_time).alias("seconds_since_previous_event"),
    )


def _segment_context(events: DataFrame) -> DataFrame:
    """One row per segment of every order that spans more than one segment."""
    end_event = F.struct(*_SEGMENT_ORDER, "event_type", "event_time")
    segments = events.groupBy(*_SEGMENT_KEY).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(end_event).alias("_head"),
        F.max(end_event).alias("_tail"),
    )
    per_order = Window.partitionBy("order_id")
    ordered = per_order.orderBy("kafka_topic", "kafka_partition", "_segment")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        segments.withColumns(
            {
                "_segments": F.count(F.lit(1)).over(whole),
                "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
                "_before": F.lag("_tail").over(ordered),
                "_after": F.lead("_head").over(ordered),
                "_first": F.first("_head").over(whole),
                "_last": F.last("_tail").over(whole),
            }
        )
        .filter("_segments > 1")
        .select(
            *_SEGMENT_KEY,
            "_rows_before",
            F.col("_before.event_type").alias("_before_type"),
            F.col("_before.event_time").alias("_before_time"),
            F.col("_after.event_type").alias("_after_type"),
            F.col("_first.event_time").alias("_order_first_time"),
            F.col("_last.event_time").alias("_order_last_time"),
        )
    )
