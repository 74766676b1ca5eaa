"""Offset intervals: coalescing, membership, coverage and consumed counts.

A topic partition can hold a large share of all records, so nothing here groups a whole
topic partition of rows. Offsets are cut into fixed segments; only one or two summary rows
per segment meet at the topic-partition level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_OFFSETS = 1_000_000

_PARTITION = ["topic", "partition"]


def coalesce_offsets(delivered: DataFrame, segment_offsets: int = SEGMENT_OFFSETS) -> DataFrame:
    """Maximal contiguous half-open ranges of the delivered offsets per topic partition."""
    segment = F.expr(f"offset div {segment_offsets}")
    distinct = (
        delivered.filter("topic IS NOT NULL AND partition IS NOT NULL AND offset IS NOT NULL")
        .select(*_PARTITION, segment.alias("_segment"), "offset")
        .distinct()
    )
    in_segment = Window.partitionBy(*_PARTITION, "_segment").orderBy("offset")
    runs = (
        distinct.withColumn("_run", F.col("offset") - F.row_number().over(in_segment))
        .groupBy(*_PARTITION, "_segment", "_run")
        .agg(
            F.min("offset").alias("start_offset"),
            (F.max("offset") + 1).alias("end_offset_exclusive"),
        )
    )
    touches_edge = (F.col("start_offset") % segment_offsets == 0) | (
        F.col("end_offset_exclusive") % segment_offsets == 0
    )
    columns = [*_PARTITION, "start_offset", "end_offset_exclusive"]
    inner = runs.filter(~touches_edge).select(*columns)
    edges = _join_touching(runs.filter(touches_edge).select(*columns))
    return inner.unionByName(edges)


def _join_touching(runs: DataFrame) -> DataFrame:
    """Merge runs that meet at a segment edge; at most two runs per segment arrive here."""
    ordered = Window.partitionBy(*_PARTITION).orderBy("start_offset")
    previous_end = F.lag("end_offset_exclusive").over(ordered)
    starts_island = F.coalesce(F.col("start_offset") != previous_end, F.lit(True))
    return (
        runs.withColumn("_starts", starts_island.cast("int"))
        .withColumn("_island", F.sum("_starts").over(ordered))
        .groupBy(*_PARTITION, "_island")
        .agg(
            F.min("start_offset").alias("start_offset"),
            F.max("end_offset_exclusive").alias("end_offset_exclusive"),
        )
        .drop("_island")
    )


def within_intervals(
    rows: DataFrame,
    intervals: DataFrame,
    *,
    topic: str = "kafka_topic",
    partition: str = "kafka_partition",
    offset: str = "kafka_offset",
    segment_offsets: int = SEGMENT_OFFSETS,
) -> DataFrame:
    """Rows whose coordinate lies in an interval of exactly its topic and partition.

    Rows and interval starts are sorted together inside (topic, partition, offset segment), and
    a row is inside if the furthest end of the intervals that started up to it lies beyond it.
    The work is linear in rows and intervals however fragmented the intervals are, and a busy
    partition is spread over its segments; intervals are cut at segment edges.
    """
    place = ["_topic", "_partition", "_segment"]
    begin, end = F.col("start_offset").cast("bigint"), F.col("end_offset_exclusive").cast("bigint")
    pieces = (
        intervals.filter("end_offset_exclusive > start_offset")
        .select(
            F.col("topic").alias("_topic"),
            F.col("partition").cast("bigint").alias("_partition"),
            begin.alias("_start"),
            end.alias("_stop"),
            F.explode(
                F.sequence(
                    F.expr(f"start_offset div {segment_offsets}"),
                    F.expr(f"(end_offset_exclusive - 1) div {segment_offsets}"),
                )
            ).alias("_segment"),
        )
        .select(
            *place,
            F.greatest("_start", F.col("_segment") * segment_offsets).alias("_at"),
            F.least("_stop", (F.col("_segment") + 1) * segment_offsets).alias("_end"),
        )
    )
    placed = rows.filter(
        F.col(topic).isNotNull() & F.col(partition).isNotNull() & F.col(offset).isNotNull()
    ).select(
        F.col(topic).alias("_topic"),
        F.col(partition).cast("bigint").alias("_partition"),
        F.expr(f"`{offset}` div {segment_offsets}").alias("_segment"),
        F.col(offset).cast("bigint").alias("_at"),
        F.struct(*rows.columns).alias("_row"),
    )
    # NULL sorts first, so an interval that starts at a row's offset comes before the row
    so_far = Window.partitionBy(*place).orderBy("_at", F.col("_row").isNotNull())
    reached = F.max("_end").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.unionByName(pieces, allowMissingColumns=True)
        .withColumn("_reached", reached)
        .filter(F.col("_row").isNotNull() & (F.col("_reached") > F.col("_at")))
        .select("_row.*")
    )


def consumed_count(intervals: DataFrame, committed: DataFrame) -> DataFrame:
    """One row: delivered records below the committed offset; no commit counts as zero."""
    current = committed.select(*_PARTITION, "current_offset")
    consumed = F.greatest(
        F.least("current_offset", "end_offset_exclusive") - F.col("start_offset"), F.lit(0)
    )
    per_interval = F.when(F.col("current_offset").isNotNull(), consumed).otherwise(F.lit(0))
    return intervals.join(current, _PARTITION, "left").agg(
        F.coalesce(F.sum(per_interval), F.lit(0)).cast("bigint").alias("consumed_count")
    )


def coverage(intervals: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: total interval length, number of distinct delivered offsets, and equality."""
    lengths = intervals.select(
        (F.col("end_offset_exclusive") - F.col("start_offset")).alias("_covered"),
        F.lit(0).cast("bigint").alias("_delivered"),
    )
    offsets = delivered.select(*_PARTITION, "offset").distinct().agg(
        F.lit(0).cast("bigint").alias("_covered"), F.count(F.lit(1)).alias("_delivered")
    )
    totals = lengths.unionByName(offsets).agg(
        F.sum("_covered").alias("covered_offsets"), F.sum("_delivered").alias("delivered_count")
    )
    return totals.withColumn("is_complete", F.col("covered_offsets") == F.col("delivered_count"))


def run_counts(
    processed_events: DataFrame,
    valid_orders: DataFrame,
    log_metrics: DataFrame,
    dead_letters: DataFrame,
    intervals: DataFrame,
    *,
    order_topic: str,
    log_group: str,
) -> DataFrame:
    """Named counts of one run: rows inside its intervals, and the whole minute table."""
    markers = within_intervals(
        processed_events.select("consumer_group", "topic", "partition_id", "offset_id"),
        intervals,
        topic="topic",
        partition="partition_id",
        offset="offset_id",
    )
    coordinates = ["kafka_topic", "kafka_partition", "kafka_offset"]
    orders = within_intervals(valid_orders.select(*coordinates), intervals.filter(F.col("topic") == order_topic))
    letters = within_intervals(
        dead_letters.select("original_topic", "original_partition", "original_offset"),
        intervals,
        topic="original_topic",
        partition="original_partition",
        offset="original_offset",
    )

    def labelled(rows: DataFrame, **counts: Column) -> DataFrame:
        totals = rows.agg(*[count.alias(name) for name, count in counts.items()])
        return totals.unpivot([], list(counts), "measure", "row_count")

    every = F.count(F.lit(1))
    return (
        labelled(
            markers,
            processed_events_count=every,
            log_processed_events_count=F.count_if(F.col("consumer_group") == log_group),
        )
        .unionByName(labelled(orders, valid_orders_count=every))
        .unionByName(labelled(letters, dead_letter_count=every))
        .unionByName(labelled(log_metrics, log_metric_rows_total=every))
    )
