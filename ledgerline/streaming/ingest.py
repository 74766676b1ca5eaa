"""Streaming ingestion: decode, quarantine, deduplicate forever, persist idempotently."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.validation import ACCESS_LOGS, ORDERS, Family, dead_letters, decode
from ledgerline.operators.dedup import conflicting_reuse, first_occurrences
from ledgerline.plans.health import MINUTE_KEY, access_contributions
from ledgerline.streaming.ledger import ACCESS_ROW, ORDER_ROW, PERIOD, Ledger

COORDINATE = ["topic", "partition", "offset"]
FLUSH_INTERVAL = "10 seconds"
CONFLICT_TYPE = "DuplicateEventConflict"
CONFLICT_MESSAGE = "event_id: seen before with other measurements"

# Only these are compared when an event id comes back.
METRIC_COLUMNS = [*MINUTE_KEY, "status_class", "response_time_ms"]


@dataclass(frozen=True)
class Job:
    """One consumer: the event family it accepts and the group its markers belong to."""

    family: Family
    consumer_group: str

    @property
    def row_schema(self):
        return ORDER_ROW if self.family is ORDERS else ACCESS_ROW

    @property
    def checks_conflicts(self) -> bool:
        return self.family is ACCESS_LOGS


@dataclass
class Resolved:
    """A batch split three ways; every record belongs to exactly one part."""

    accepted: DataFrame
    dead: DataFrame
    decoded: DataFrame = field(repr=False)


def with_metric_columns(valid: DataFrame) -> DataFrame:
    flags = access_contributions(valid)
    return flags.withColumn(
        "status_class",
        F.when(F.col("success_count") == 1, F.lit("success"))
        .when(F.col("client_error_count") == 1, F.lit("client"))
        .otherwise(F.lit("server")),
    ).select(*valid.columns, "metric_minute", "status_class")


def with_digest(valid: DataFrame, job: Job) -> DataFrame:
    """The compared measures as one text; NULL for consumers that compare none."""
    if not job.checks_conflicts:
        return valid.withColumn("digest", F.lit(None).cast("string"))
    measures = F.concat_ws("\x1f", *[F.col(name).cast("string") for name in METRIC_COLUMNS])
    return with_metric_columns(valid).withColumn("digest", F.md5(measures)).drop("metric_minute", "status_class")


def conflicts_in(valid: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Events that reuse an id with other measures than its marker, or than its first row here."""
    if seen is None:
        return conflicting_reuse(valid, ["event_id"], COORDINATE, ["digest"])
    known = seen.withColumnRenamed("digest", "_known")
    old = valid.join(known, "event_id").filter(F.col("_known") != F.col("digest")).drop("_known")
    new = valid.join(seen.select("event_id"), "event_id", "left_anti")
    return old.unionByName(conflicting_reuse(new, ["event_id"], COORDINATE, ["digest"]))


def resolve(decoded: DataFrame, job: Job, seen: DataFrame | None, now: Column) -> Resolved:
    """Split decoded records into newly accepted events and dead letters.

    ``seen`` holds (event_id, digest) of ids that other batches accepted. What is in neither
    part is a duplicate: an id seen before, or again in this batch, with the same measures.
    The first coordinate of an id wins.
    """
    valid = with_digest(decoded.filter(F.col("error_type").isNull()), job)
    dead = decoded.filter(F.col("error_type").isNotNull())
    rows = valid.select(
        F.lit(job.consumer_group).alias("consumer_group"),
        *[name for name in job.row_schema.fieldNames() if name in valid.columns],
        "digest",
    )
    accepted = first_occurrences(rows, ["consumer_group", "event_id"], COORDINATE)
    if seen is not None:
        accepted = accepted.join(seen.select("event_id"), "event_id", "left_anti")
    if job.checks_conflicts:
        conflicts = conflicts_in(valid, seen).withColumns(
            {"error_type": F.lit(CONFLICT_TYPE), "error_message": F.lit(CONFLICT_MESSAGE)}
        )
        dead = dead.unionByName(conflicts.select(*dead.columns))
    return Resolved(
        accepted=accepted.withColumn("processed_at", now),
        dead=dead_letters(dead, job.consumer_group, now),
        decoded=decoded,
    )


def outcome_counts(resolved: Resolved) -> DataFrame:
    """Rows (outcome, record_count); duplicates are the records in neither other part."""

    def part(rows: DataFrame, outcome: str, duplicate_share: int) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("_rows")).select(
            F.explode(
                F.array(
                    F.struct(F.lit(outcome).alias("outcome"), F.col("_rows").alias("n")),
                    F.struct(
                        F.lit("duplicate").alias("outcome"),
                        (F.col("_rows") * duplicate_share).alias("n"),
                    ),
                )
            ).alias("_part")
        )

    parts = (
        part(resolved.decoded, "duplicate", 0)
        .unionByName(part(resolved.accepted, "processed", -1))
        .unionByName(part(resolved.dead, "dead-lettered", -1))
    )
    return parts.groupBy(F.col("_part.outcome").alias("outcome")).agg(
        F.sum("_part.n").alias("record_count")
    )


def start(
    records: DataFrame,
    job: Job,
    ledger_root: str,
    checkpoint: str,
    *,
    available_now: bool = False,
    flush_interval: str = FLUSH_INTERVAL,
    period: int = PERIOD,
    dead_letter_sink: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Run a consumer over a stream of raw records until stopped (or until caught up).

    The query takes the ledger over with its first batch; a query that held it before fails
    with its next one. Each ``period`` batches the finished ones are folded into a segment.
    ``dead_letter_sink`` also gets each batch's dead letters after the ledger has them, for
    instance to send them to a topic; a replayed batch sends its letters again.
    """
    spark = records.sparkSession
    ledger = Ledger(spark, ledger_root, job.row_schema, period)
    writer_of: dict[str, str] = {}

    def process(batch: DataFrame, batch_id: int) -> None:
        if not writer_of:
            query_id = query_id_of(spark, checkpoint)
            writer_of.update(query_id=query_id, token=ledger.claim(query_id))
        persist_batch(batch, batch_id, job, ledger, **writer_of)
        if batch_id % period == 0 and batch_id:
            ledger.compact()
        if dead_letter_sink is not None:
            dead_letter_sink(ledger.dead_letters_of(writer_of["query_id"], batch_id))

    writer = records.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=flush_interval).start()


def persist_batch(
    batch: DataFrame, batch_id: int, job: Job, ledger: Ledger, query_id: str, token: str
) -> None:
    """Write one micro-batch. Both writes are overwrites keyed by the batch, so replays are safe.

    The writer must hold the ledger before and after: rows written after a takeover are not
    read, and the failure keeps the batch out of the checkpoint.
    """
    ledger.check_owner(token)
    decoded = decode(batch, job.family).persist()
    decoded.count()  # stages that run side by side would each decode what the others have not finished
    ids = decoded.filter(F.col("error_type").isNull()).select("event_id")
    seen = ledger.seen(ids, job.consumer_group, query_id, batch_id).persist()
    try:
        now = F.lit(datetime.now(UTC))
        resolved = resolve(decoded, job, seen, now)
        ledger.write_dead_letters(resolved.dead, query_id, batch_id)
        ledger.write_batch(resolved.accepted, query_id, batch_id, token)
    finally:
        decoded.unpersist()
        seen.unpersist()
    ledger.check_owner(token)


def query_id_of(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the streaming query, which survives restarts from the same checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def bounded_minutes(access_events: DataFrame, allowed_lateness: str) -> DataFrame:
    """Minute metrics with bounded state, in update mode.

    A different guarantee from the ledger: events later than the allowance are dropped, and
    an id is remembered only that long.
    """
    unique = access_events.withWatermark("event_time", allowed_lateness).dropDuplicatesWithinWatermark(
        ["event_id"]
    )
    flagged = access_contributions(unique.withColumn("updated_at", F.col("event_time")))
    return flagged.groupBy(
        F.window("event_time", "1 minute").alias("minute"), "service", "endpoint"
    ).agg(
        *[
            F.sum(F.col(name).cast("bigint")).alias(name)
            for name in (
                "request_count",
                "success_count",
                "client_error_count",
                "server_error_count",
                "response_time_sum_ms",
            )
        ],
        F.max("max_response_time_ms").alias("max_response_time_ms"),
    )
