"""One named query per operator; each reads whole test tables.

Results use portable types only (text for dates and times, doubles rounded to six places for
decimals and rates), so that two engines can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import exprs, scrub
from ledgerline.functions.validation import ACCESS_LOGS, ORDERS, decode
from ledgerline.operators import (
    assets,
    contract_diff,
    cost,
    dedup,
    delivery,
    intervals,
    lag,
    lineage,
    percentiles,
    quality,
)
from ledgerline.plans import build, health, incremental, marts, orders, sales, staging
from ledgerline.schemas import CONTRACTS
from ledgerline.session import configure, ensure_checkpoint_dir, stored
from ledgerline.sources import adapters, derived, raw_records, tables
from ledgerline.streaming import ingest
from ledgerline.streaming.ledger import Ledger, order_facts

Query = Callable[[SparkSession, str], DataFrame]

ORDER_JOB = ingest.Job(ORDERS, adapters.ORDER_GROUP)
ACCESS_JOB = ingest.Job(ACCESS_LOGS, adapters.ACCESS_GROUP)
CLOCK = "2026-08-06 00:00:00"
CUTOFF = "2024-01-25 00:00:00"
LAST_DAY = date(2024, 1, 31)
#: Records in a file of a streamed folder, and bytes of files in a micro-batch.
FILE_RECORDS = 500_000
BATCH_BYTES = 256 << 20
#: Micro-batches that a run is cut into at least, so that finished ones are folded on the way.
BATCHES = 3


def portable(frame: DataFrame) -> DataFrame:
    def convert(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.DecimalType, T.DoubleType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        return column.alias(field.name)

    return frame.select(*[convert(field) for field in frame.schema])


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark)}/ledgerline-{uuid.uuid4()}"


def _clock() -> Column:
    return F.lit(CLOCK).cast("timestamp")


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- models -----------------------------------------------------------------------------


def _orders(spark: SparkSession, directory: str) -> DataFrame:
    return staging.order_events(adapters.valid_orders(spark, directory))


def _minutes(spark: SparkSession, directory: str) -> DataFrame:
    access = adapters.access_events(spark, directory)
    return staging.minute_metrics(health.minute_metrics_from_access_events(access))


def stg_order_events(spark, directory):
    return _orders(spark, directory)


def stg_processed_events(spark, directory):
    return staging.processed_events(adapters.processed_events(spark, directory))


def stg_log_metrics_minute(spark, directory):
    return _minutes(spark, directory)


def int_order_event_sequence(spark, directory):
    return orders.order_event_sequence(_orders(spark, directory))


def fct_order_events(spark, directory):
    return orders.fct_order_events(_orders(spark, directory))


def fct_order_events_small_segments(spark, directory):
    """The same fact with tiny offset segments, so that every order spans several."""
    return orders.fct_order_events(_orders(spark, directory), segment_offsets=50)


def int_order_latest_state(spark, directory):
    return orders.latest_order_state(_orders(spark, directory))


def fct_orders(spark, directory):
    return orders.fct_orders(_orders(spark, directory))


def mart_daily_sales(spark, directory):
    return sales.daily_sales(_orders(spark, directory))


def mart_daily_sales_from_orders(spark, directory):
    """Daily sales with the creation facts taken from the order fact."""
    events = _orders(spark, directory)
    return sales.daily_sales(events, orders.fct_orders(events))


def log_metrics_minute(spark, directory):
    return health.minute_metrics_from_access_events(adapters.access_events(spark, directory))


def int_service_minute_metrics(spark, directory):
    return health.service_minute_metrics(_minutes(spark, directory))


def mart_service_health(spark, directory):
    return health.service_health(health.service_minute_metrics(_minutes(spark, directory)))


def minute_merge(spark, directory):
    """Two partial minute tables (by arrival half) merged additively."""
    access = adapters.access_events(spark, directory)
    early = F.col("event_time") < _time(CUTOFF)
    first = health.minute_metrics_from_access_events(access.filter(early | (F.col("number") % 2 == 0)))
    late = health.minute_metrics_from_access_events(
        access.filter(~early & (F.col("number") % 2 == 1))
    )
    return health.combine_minutes(first.unionByName(late))


# --- ingestion --------------------------------------------------------------------------


def _resolved(spark, directory, job) -> ingest.Resolved:
    """The records decoded once: resolving reads them up to five times, and each copy of the rules
    in a plan would be optimised and compiled by the driver."""
    source = (
        raw_records.order_records if job is ORDER_JOB else raw_records.access_records
    )
    decoded = stored(decode(source(spark, directory), job.family))
    return ingest.resolve(decoded, job, None, _clock())


def ingest_order_errors(spark, directory):
    """Verdict of every order record."""
    decoded = decode(raw_records.order_records(spark, directory), ORDERS)
    return decoded.select("topic", "partition", "offset", "error_type", "error_message")


def ingest_access_errors(spark, directory):
    decoded = decode(raw_records.access_records(spark, directory), ACCESS_LOGS)
    return decoded.select("topic", "partition", "offset", "error_type", "error_message")


def ingest_valid_orders(spark, directory):
    return order_facts(_resolved(spark, directory, ORDER_JOB).accepted)


def ingest_log_metrics_minute(spark, directory):
    accepted = _resolved(spark, directory, ACCESS_JOB).accepted
    return health.minute_metrics_from_access_events(
        accepted.withColumn("updated_at", F.col("processed_at"))
    ).drop("updated_at")


def ingest_order_dead_letters(spark, directory):
    return _resolved(spark, directory, ORDER_JOB).dead.select(
        "dlq_key",
        "error_type",
        "original_topic",
        "original_partition",
        "original_offset",
        "consumer_group",
        "original_key",
        "original_payload_encoding",
        F.when(F.col("original_payload_encoding") == "base64", F.col("original_payload")).alias(
            "base64_payload"
        ),
    )


def ingest_access_dead_letters(spark, directory):
    return _resolved(spark, directory, ACCESS_JOB).dead.select(
        "dlq_key",
        "error_type",
        "original_topic",
        "original_partition",
        "original_offset",
        "consumer_group",
        "original_key",
        "original_payload_encoding",
    )


def dead_letter_messages(spark, directory):
    """Kafka form of the dead letters, read back from their JSON."""
    messages = tables.dead_letter_messages(_resolved(spark, directory, ORDER_JOB).dead)
    return messages.select(
        "key",
        F.get_json_object("value", "$.error_type").alias("error_type"),
        F.get_json_object("value", "$.failed_at").alias("failed_at"),
        F.get_json_object("value", "$.original_offset").cast("bigint").alias("original_offset"),
        F.get_json_object("value", "$.original_payload.source").alias("payload_source"),
    )


def ingest_access_outcomes(spark, directory):
    """Count of records per outcome; every record has exactly one."""
    return ingest.outcome_counts(_resolved(spark, directory, ACCESS_JOB))


def routed_messages(spark, directory):
    """Kafka key and topic of every order and access event."""
    order_rows = adapters.valid_orders(spark, directory).select(
        "event_type", "order_id", F.lit(None).cast("string").alias("service"), F.col("event_id").alias("value")
    )
    access_rows = adapters.access_events(spark, directory).select(
        "event_type", F.lit(None).cast("string").alias("order_id"), "service", F.col("event_id").alias("value")
    )
    return tables.routed(order_rows.unionByName(access_rows))


def pending_events(spark, directory):
    """Markers of all events against those processed before the cutoff."""
    markers = adapters.processed_events(spark, directory)
    seen = markers.filter(F.col("processed_at") < _time(CUTOFF))
    return dedup.pending(markers, seen)


def first_user_events(spark, directory):
    """First event of every (user, event type) in time order."""
    events = adapters.table(spark, directory, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )
    return dedup.first_occurrences(events, ["user_id", "event_type"], ["ts", "event_id"])


def _run_stream(spark, directory, job, source, replay=False) -> Ledger:
    folder = _scratch(spark)
    # a topic delivers the records of a partition in order: of a reused id the first coordinate comes first
    records = source(spark, directory).repartitionByRange("partition", "offset")
    records.write.option("maxRecordsPerFile", FILE_RECORDS).parquet(f"{folder}/records")
    size = tables.arrive_in_order(spark, f"{folder}/records")
    # a batch costs seconds of its own and meets all markers, so batches are as large as the limit allows
    limit = max(1, min(BATCH_BYTES, -(-size // BATCHES)))
    stream = tables.record_file_stream(spark, f"{folder}/records", max_bytes_per_trigger=limit)
    attempts = ["first", "second"] if replay else ["first"]
    for attempt in attempts:
        # A new checkpoint delivers every record again; the ledger must not change.
        query = ingest.start(
            stream, job, f"{folder}/ledger", f"{folder}/checkpoint-{attempt}", available_now=True, period=2
        )
        query.awaitTermination()
    return Ledger(spark, f"{folder}/ledger", job.row_schema, period=2)


def stream_valid_orders(spark, directory):
    """Order table of a streaming run that was replayed in full."""
    ledger = _run_stream(spark, directory, ORDER_JOB, raw_records.order_records, replay=True)
    return ledger.valid_orders().drop("created_at")


def stream_log_metrics_minute(spark, directory):
    """Minute table of a streaming run that folds its finished batches on the way."""
    ledger = _run_stream(spark, directory, ACCESS_JOB, raw_records.access_records)
    return ledger.log_metrics_minute().drop("updated_at")


def stream_access_dead_letters(spark, directory):
    """Dead letters of a run in which repeated ids come back only after all first ones are stored."""
    folder = _scratch(spark)
    records = raw_records.access_records(spark, directory)
    comes_back = F.col("offset") >= raw_records.COPY_OFFSET
    ledger = Ledger(spark, f"{folder}/ledger", ACCESS_JOB.row_schema, period=1)
    for chosen in (~comes_back, comes_back):
        writer = records.filter(chosen).write.mode("append").option("maxRecordsPerFile", FILE_RECORDS)
        writer.parquet(f"{folder}/records")
        stream = tables.record_file_stream(spark, f"{folder}/records", max_bytes_per_trigger=BATCH_BYTES)
        query = ingest.start(
            stream, ACCESS_JOB, ledger.root, f"{folder}/checkpoint", available_now=True, period=1
        )
        query.awaitTermination()
    return ledger.dead_letters().select(
        "dlq_key", "error_type", "original_topic", "original_partition", "original_offset",
        "consumer_group", "original_key", "original_payload_encoding",
    )


# --- quality ----------------------------------------------------------------------------


def source_quality(spark, directory):
    suites = build.source_suites(
        adapters.valid_orders(spark, directory),
        adapters.processed_events(spark, directory),
        log_metrics_minute(spark, directory),
    )
    return quality.summarise([*suites, build.order_suite(_orders(spark, directory))])


def mart_quality(spark, directory):
    events = _orders(spark, directory)
    suites = build.mart_suites(
        orders.fct_order_events(events),
        orders.fct_orders(events),
        sales.daily_sales(events),
        mart_service_health(spark, directory),
    )
    return quality.summarise(suites)


def check_not_null(spark, directory):
    nodes = derived.order_nodes(spark, directory)
    return quality.not_null(nodes, "description").select("asset_id")


def check_unique(spark, directory):
    return quality.unique(adapters.table(spark, directory, "orders"), "o_custkey")


def check_accepted_values(spark, directory):
    items = adapters.table(spark, directory, "lineitem")
    return quality.accepted_values(
        items, "l_returnflag", ["A", "N"], "l_linestatus = 'F'"
    ).select("l_orderkey", "l_linenumber", "l_returnflag")


def check_conditional_not_null(spark, directory):
    estimates = derived.query_estimates(spark, directory)
    return quality.conditional_not_null(
        estimates, "waiver_approved_bytes", "has_waiver"
    ).select("query_id")


def check_positive_when_present(spark, directory):
    customers = adapters.table(spark, directory, "customer")
    return quality.positive_when_present(customers, "c_acctbal").select("c_custkey")


def check_non_negative(spark, directory):
    suppliers = adapters.table(spark, directory, "supplier")
    return quality.non_negative(suppliers, "s_acctbal").select("s_suppkey")


def check_unique_combination(spark, directory):
    items = adapters.table(spark, directory, "lineitem")
    return quality.unique_combination(items, ["l_orderkey", "l_linenumber"])


def check_single_value_per_group(spark, directory):
    items = adapters.table(spark, directory, "lineitem")
    return quality.single_value_per_group(items, "l_returnflag", "l_orderkey")


def check_single_place_per_user(spark, directory):
    """The two-column form: users seen in more than one (topic, partition) place."""
    events = derived.delivered_offsets(spark, directory).select(
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        (F.col("offset") % 2000).alias("order_id"),
    )
    return quality.single_partition_per_order(events)


def check_count_consistency(spark, directory):
    """Consistency of counts of line items per part, with returned items left out."""
    items = adapters.table(spark, directory, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("l_returnflag") == "A").alias("success_count"),
        F.count_if(F.col("l_returnflag") == "N").alias("client_error_count"),
        F.lit(0).cast("bigint").alias("server_error_count"),
    )
    return quality.count_consistency(items)


def check_freshness(spark, directory):
    parts = []
    loaded = {
        "valid_orders": (adapters.valid_orders(spark, directory), "created_at"),
        "log_metrics_minute": (log_metrics_minute(spark, directory), "updated_at"),
    }
    for name, (rows, column) in loaded.items():
        for clock in ("2024-01-31 00:10:00", "2024-01-31 01:00:00", CLOCK):
            parts.append(
                quality.freshness(rows, column, _time(clock)).select(
                    F.lit(name).alias("table_name"), F.lit(clock).alias("clock"), "*"
                )
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def contract_nulls(spark, directory):
    """NULLs in required columns when failed payments lose their user and time."""
    fact = orders.fct_order_events(_orders(spark, directory))
    broken = fact.select(
        *[
            F.when(F.col("event_type") != "payment_failed", F.col(name)).alias(name)
            if name in ("user_id", "event_time")
            else F.col(name)
            for name in fact.columns
        ]
    )
    return quality.required_nulls(broken, CONTRACTS["fct_order_events"])


def result_rollup(spark, directory):
    results = derived.item_results(spark, directory)
    parents = results.select("unique_id", "asset_id").distinct()
    return quality.result_rollup(
        results.select("unique_id", "status"), parents, derived.order_nodes(spark, directory)
    )


def gate(spark, directory):
    results = derived.item_results(spark, directory)
    return quality.gate(results, ["asset_id"])


def changed_keys(spark, directory):
    """Event types per user before and after the cutoff."""
    events = adapters.table(spark, directory, "events")
    early = F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{CUTOFF}'")
    return quality.changed_keys(
        events.filter(early), events.filter(~early), ["user_id", "event_type"]
    )


def staleness(spark, directory):
    """Staleness of each user's latest purchase (NULL without one)."""
    latest = (
        adapters.table(spark, directory, "events")
        .groupBy("user_id")
        .agg(
            F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
            .cast("timestamp")
            .alias("last_seen")
        )
    )
    return latest.select(
        "user_id",
        exprs.is_stale("last_seen", _time("2024-01-31 00:00:00")).cast("string").alias("is_stale"),
    )


# --- offsets, lag, run evidence ---------------------------------------------------------


def _run_intervals(spark, directory) -> DataFrame:
    return intervals.coalesce_offsets(
        derived.delivered_offsets(spark, directory), segment_offsets=1000
    )


def offset_intervals(spark, directory):
    return _run_intervals(spark, directory)


def interval_coverage(spark, directory):
    return intervals.coverage(
        _run_intervals(spark, directory), derived.delivered_offsets(spark, directory)
    )


def consumed_count(spark, directory):
    committed = derived.committed_offsets(spark, directory).select(
        "topic",
        "partition",
        F.when(F.col("committed_offset") >= 0, F.col("committed_offset")).alias("current_offset"),
    )
    return intervals.consumed_count(_run_intervals(spark, directory), committed)


def orders_in_intervals(spark, directory):
    """Stored orders whose coordinate lies in a delivered interval of their partition."""
    return intervals.within_intervals(
        adapters.valid_orders(spark, directory),
        _run_intervals(spark, directory),
        segment_offsets=1000,
    ).select("event_id", "kafka_partition", "kafka_offset")


def run_counts(spark, directory):
    return intervals.run_counts(
        adapters.processed_events(spark, directory),
        adapters.valid_orders(spark, directory),
        log_metrics_minute(spark, directory),
        _resolved(spark, directory, ORDER_JOB).dead,
        _run_intervals(spark, directory),
        order_topic=adapters.ORDER_TOPIC,
        log_group=adapters.ACCESS_GROUP,
    )


def _partition_lag(spark, directory) -> DataFrame:
    return lag.partition_lag(
        derived.end_offsets(spark, directory),
        derived.committed_offsets(spark, directory),
        derived.consumer_groups(spark, directory),
    )


def partition_lag(spark, directory):
    return _partition_lag(spark, directory)


def group_lag(spark, directory):
    return lag.group_lag(_partition_lag(spark, directory))


def combined_lag(spark, directory):
    """Per topic, the total over its groups (NULL as soon as one is unknown)."""
    groups = lag.group_lag(_partition_lag(spark, directory))
    return lag.combined_lag(groups, ["topic"]).unionByName(
        lag.combined_lag(
            groups.filter(F.col("consumer_group") == adapters.ACCESS_GROUP), ["consumer_group"]
        ).withColumnRenamed("consumer_group", "topic")
    )


def benchmark_lag(spark, directory):
    return lag.benchmark_lag(derived.daily_lag(spark, directory), ["observed_at"])


def observed_lag(spark, directory):
    return lag.observed_lag(benchmark_lag(spark, directory))


def lag_report(spark, directory):
    """Daily lag written as nested JSON reports, one per line, and read back as rows."""
    row = F.struct(
        "consumer_group", "topic", "partition", "current_offset", "log_end_offset", "lag",
        F.lit("measured").alias("status"),
    )
    # A group's rows are its topic partitions, a small fixed number.
    reports = (
        derived.daily_lag(spark, directory)
        .groupBy("observed_at", "consumer_group", "topic")
        .agg(F.collect_list(row).alias("rows"))
        .select(
            "observed_at",
            F.array(
                F.struct("consumer_group", "topic", F.lit("measured").alias("status"), "rows")
            ).alias("groups"),
        )
    )
    path = f"{_scratch(spark)}/lag"
    reports.write.json(path)
    return tables.lag_report(spark, path, one_per_line=True)


def test_result_report(spark, directory):
    """Test results written as JSON reports, one per line, and read back as rows."""
    results = derived.item_results(spark, directory)
    reports = results.select(F.array(F.struct("unique_id", "status")).alias("results"))
    path = f"{_scratch(spark)}/results"
    reports.write.json(path)
    return tables.result_report(spark, path, one_per_line=True)


def latency_percentiles(spark, directory):
    attempts = derived.delivery_attempts(spark, directory).filter(F.col("outcome") == "delivered")
    return percentiles.sample_summary(
        attempts, "latency_ms", [0.5, 0.95, 0.99, 1.0], ["injection_kind"]
    )


def latency_percentiles_overall(spark, directory):
    attempts = derived.delivery_attempts(spark, directory)
    return percentiles.sample_summary(attempts, "latency_ms", [0.01, 0.5, 0.95, 0.99])


def price_percentiles(spark, directory):
    """Percentiles of a wide-ranging measure over the largest table, by return flag."""
    items = adapters.table(spark, directory, "lineitem")
    return percentiles.nearest_rank_percentiles(
        items, "l_extendedprice", [0.001, 0.25, 0.5, 0.75, 0.999], ["l_returnflag"]
    )


def delivery_counters(spark, directory):
    return delivery.delivery_counters(derived.delivery_attempts(spark, directory))


def invalid_by_type(spark, directory):
    return delivery.invalid_by_type(derived.delivery_attempts(spark, directory))


def delivery_rate(spark, directory):
    attempts = derived.delivery_attempts(spark, directory)
    totals = attempts.agg(
        F.count_if(F.col("outcome") == "delivered").alias("delivered"),
        exprs.seconds_between(F.max("attempted_at"), F.min("attempted_at")).alias("elapsed"),
    )
    return totals.select(
        "delivered", exprs.floored_rate("delivered", "elapsed").alias("events_per_second")
    )


# --- incremental maintenance ------------------------------------------------------------


def _published(spark, directory, before: str | None = None) -> tuple[str, DataFrame]:
    """Marts built from the events stored before a time, in a new folder; and all order events.

    Every mart and the refresh read the order events, so they are derived from their source once.
    """
    valid = stored(adapters.valid_orders(spark, directory), dictionaries=False)
    events = valid if before is None else valid.filter(F.col("created_at") < _time(before))
    models = build.build(
        events, adapters.processed_events(spark, directory), log_metrics_minute(spark, directory)
    )
    root = f"{_scratch(spark)}/marts"
    build.publish(models, root)
    return root, staging.order_events(valid)


def refreshed_service_health(spark, directory):
    """Service health built up to the cutoff, then derived again for the days of later minutes."""
    access = adapters.access_events(spark, directory)
    cutoff = F.col("event_time") < _time("2024-01-29 12:00:00")

    def minutes(rows: DataFrame) -> DataFrame:
        return staging.minute_metrics(health.minute_metrics_from_access_events(rows))

    root = f"{_scratch(spark)}/marts"
    early = health.service_health(health.service_minute_metrics(minutes(access.filter(cutoff))))
    marts.write_slices(early, root, CONTRACTS["mart_service_health"])
    incremental.refresh_health(minutes(access), minutes(access.filter(~cutoff)), root)
    return marts.read_mart_files(spark, root, "mart_service_health")


def _refreshed(spark, directory) -> str:
    """Marts built up to the cutoff, then brought up to date with the events that came later."""
    root, events = _published(spark, directory, before=CUTOFF)
    arrived = events.filter(F.col("persisted_at") >= _time(CUTOFF))
    incremental.refresh_sales(spark, events, arrived, root)
    return root


def incremental_daily_sales(spark, directory):
    """Daily sales after the refresh from arrived events."""
    return marts.read_mart_files(spark, _refreshed(spark, directory), "mart_daily_sales")


def merged_orders(spark, directory):
    """Order fact built up to the cutoff, then merged with the orders touched since."""
    root, events = _published(spark, directory, before=CUTOFF)
    touched = events.filter(F.col("persisted_at") >= _time(CUTOFF)).select("order_id").distinct()
    updates = stored(orders.fct_orders(events.join(touched, "order_id", "left_semi")))
    incremental.merge_into_mart(spark, updates, root, "fct_orders", ["order_event_count"])
    return marts.read_mart_files(spark, root, "fct_orders")


def merged_order_events(spark, directory):
    """Event fact after the refresh from arrived events, read after the old versions are gone."""
    root = _refreshed(spark, directory)
    marts.vacuum(spark, root, "fct_order_events")
    return marts.read_mart_files(spark, root, "fct_order_events")


def bounded_read(spark, directory):
    """A week of the published service health."""
    root, _ = _published(spark, directory)
    return incremental.read_mart(
        spark, root, "mart_service_health", date(2024, 1, 8), date(2024, 1, 14)
    )


def late_rows(spark, directory):
    """Days outside the daily-sales lookback that still received events."""
    return incremental.late_rows(
        _orders(spark, directory), CONTRACTS["mart_daily_sales"], LAST_DAY
    )


# --- catalog ----------------------------------------------------------------------------


def _diff(spark, directory) -> DataFrame:
    return contract_diff.compare_contracts(
        derived.catalog_models(spark, directory, "old"),
        derived.catalog_models(spark, directory, "new"),
        derived.catalog_columns(spark, directory, "old"),
        derived.catalog_columns(spark, directory, "new"),
    )


def contract_findings(spark, directory):
    return _diff(spark, directory)


def contract_status(spark, directory):
    return contract_diff.diff_status(_diff(spark, directory))


def contract_history(spark, directory):
    """Status of each snapshot against the one before it; the first has none."""
    first = contract_diff.compare_contracts(
        None,
        derived.catalog_models(spark, directory, "old"),
        None,
        derived.catalog_columns(spark, directory, "old"),
    )
    return (
        contract_diff.diff_status(first, has_previous=False)
        .withColumn("snapshot", F.lit("old"))
        .unionByName(
            contract_diff.diff_status(_diff(spark, directory)).withColumn("snapshot", F.lit("new"))
        )
    )


def lineage_edges(spark, directory):
    """Edges from declared upstream lists; unknown upstreams are left out."""
    declared = derived.lineage_edges(spark, directory).select(
        F.col("downstream").alias("asset_id"), F.array("upstream").alias("upstream")
    )
    return lineage.build_edges(declared, derived.lineage_assets(spark, directory))


def lineage_unknown_endpoints(spark, directory):
    known = derived.lineage_assets(spark, directory).filter("layer <> 'marts'")
    return lineage.unknown_endpoints(derived.lineage_edges(spark, directory), known)


def _starts(spark, directory, layer):
    """Every asset of a layer as a numbered start of a walk."""
    assets = derived.numbered_assets(spark, directory).filter(F.col("layer") == layer)
    return assets.select(F.col("asset_id").alias("start"))


def _named(walked: DataFrame, *nodes: str) -> DataFrame:
    """Numbered nodes as the texts they stand for."""
    return walked.withColumns({name: derived.node_text(F.col(name)) for name in nodes})


def lineage_reach(spark, directory):
    """Everything below every customer."""
    edges = derived.numbered_edges(spark, directory)
    return _named(lineage.reach(edges, _starts(spark, directory, "source")), "start", "node")


def lineage_upstream(spark, directory):
    """Everything above every part."""
    edges = derived.numbered_edges(spark, directory)
    found = lineage.reach(edges, _starts(spark, directory, "intermediate"), downstream=False)
    return _named(found, "start", "node")


def lineage_walked_edges(spark, directory):
    """Edges met on the way from every part up to its orders and customers."""
    edges = derived.numbered_edges(spark, directory)
    starts = _starts(spark, directory, "intermediate")
    reached = lineage.reach(edges, starts, downstream=False)
    return _named(lineage.walked_edges(edges, starts, reached, downstream=False), "upstream", "downstream")


def finding_paths(spark, directory):
    """Blocking findings with the paths below the order that shares the model's number."""
    findings = _diff(spark, directory).filter("severity = 'blocking'").select(
        F.concat(F.lit("order."), F.substring_index("model", "_", -1)).alias("model"),
        "column",
        "change_type",
    )
    return lineage.finding_paths(findings, derived.lineage_edges(spark, directory))


def lineage_impact(spark, directory):
    """Parts and suppliers that every order touches."""
    found = lineage.impact(
        derived.numbered_edges(spark, directory),
        derived.numbered_assets(spark, directory),
        _starts(spark, directory, "staging"),
    )
    return _named(found, "asset_id", "start")


def impact_paths(spark, directory):
    """Paths from every order to its parts and their suppliers."""
    edges = derived.numbered_edges(spark, directory)
    starts = _starts(spark, directory, "staging")
    return _named(lineage.impact_paths(edges, starts, text=derived.node_text), "start")


def impact_paths_to_published(spark, directory):
    """Paths from every customer to the suppliers it reaches, rebuilt for these pairs alone."""
    edges = derived.numbered_edges(spark, directory)
    steps = lineage.impact_steps(
        edges, _starts(spark, directory, "source"), text=derived.node_text, mark_inner=True
    )
    published = derived.numbered_assets(spark, directory).filter("layer = 'marts'")
    asked = published.select(F.col("asset_id").alias("node"))
    return _named(lineage.paths_of(stored(steps.filter("is_tree")), asked, text=derived.node_text), "start")


def query_costs(spark, directory):
    return cost.evaluate_costs(
        derived.query_estimates(spark, directory), cost.default_policy(spark), _clock()
    )


def loosened_thresholds(spark, directory):
    return cost.loosened_thresholds(
        derived.part_thresholds(spark, directory, "old"),
        derived.part_thresholds(spark, directory, "new"),
        derived.part_waivers(spark, directory),
        _clock(),
    )


def asset_table(spark, directory):
    results = derived.item_results(spark, directory)
    return assets.assemble_assets(
        derived.order_nodes(spark, directory),
        derived.order_freshness(spark, directory),
        results.select("unique_id", "status"),
        results.select("unique_id", "asset_id").distinct(),
    )


def asset_columns(spark, directory):
    return assets.asset_columns(
        derived.item_columns(spark, directory), derived.observed_columns(spark, directory)
    )


def scrubbed_pages(spark, directory):
    """Page texts with credentials and connection strings masked."""
    pages = adapters.table(spark, directory, "pages")
    return pages.select(
        "page_id", scrub.scrub_text("url").alias("url"), scrub.scrub_text("html").alias("html")
    )


def scrubbed_conversations(spark, directory):
    """Conversation turns as maps; secret-like keys lose their value."""
    turns = adapters.table(spark, directory, "conversations").select(
        "conv_id",
        "turn",
        F.create_map(
            F.lit("text"),
            F.concat(F.lit("Bearer abc.DEF-1~ said: "), "text"),
            F.lit("access_Token"),
            F.col("role"),
            F.lit("origin"),
            F.concat(F.lit("POSTGRESQL://u:p@host/db "), "role"),
        ).alias("fields"),
    )
    cleaned = turns.withColumn("fields", scrub.scrub_map("fields"))
    return cleaned.select(
        "conv_id",
        "turn",
        F.col("fields")["text"].alias("text"),
        F.col("fields")["access_Token"].alias("access_token"),
        F.col("fields")["origin"].alias("origin"),
    )


_QUERIES = [
    stg_order_events,
    stg_processed_events,
    stg_log_metrics_minute,
    int_order_event_sequence,
    fct_order_events,
    fct_order_events_small_segments,
    int_order_latest_state,
    fct_orders,
    mart_daily_sales,
    mart_daily_sales_from_orders,
    log_metrics_minute,
    int_service_minute_metrics,
    mart_service_health,
    minute_merge,
    ingest_order_errors,
    ingest_access_errors,
    ingest_valid_orders,
    ingest_log_metrics_minute,
    ingest_order_dead_letters,
    ingest_access_dead_letters,
    dead_letter_messages,
    ingest_access_outcomes,
    routed_messages,
    pending_events,
    first_user_events,
    stream_valid_orders,
    stream_log_metrics_minute,
    stream_access_dead_letters,
    source_quality,
    mart_quality,
    check_not_null,
    check_unique,
    check_accepted_values,
    check_conditional_not_null,
    check_positive_when_present,
    check_non_negative,
    check_unique_combination,
    check_single_value_per_group,
    check_single_place_per_user,
    check_count_consistency,
    check_freshness,
    contract_nulls,
    result_rollup,
    gate,
    changed_keys,
    staleness,
    offset_intervals,
    interval_coverage,
    consumed_count,
    orders_in_intervals,
    run_counts,
    partition_lag,
    group_lag,
    combined_lag,
    benchmark_lag,
    observed_lag,
    lag_report,
    test_result_report,
    latency_percentiles,
    latency_percentiles_overall,
    price_percentiles,
    delivery_counters,
    invalid_by_type,
    delivery_rate,
    refreshed_service_health,
    incremental_daily_sales,
    merged_orders,
    merged_order_events,
    bounded_read,
    late_rows,
    contract_findings,
    contract_status,
    contract_history,
    lineage_edges,
    lineage_unknown_endpoints,
    lineage_reach,
    lineage_upstream,
    lineage_walked_edges,
    lineage_impact,
    impact_paths,
    impact_paths_to_published,
    finding_paths,
    query_costs,
    loosened_thresholds,
    asset_table,
    asset_columns,
    scrubbed_pages,
    scrubbed_conversations,
]


def _entry(query: Query) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return portable(query(configure(spark), directory))

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Query]:
    return {query.__name__: _entry(query) for query in _QUERIES}
