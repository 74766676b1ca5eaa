"""Operational and catalog inputs derived from the test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.sources.adapters import (
    ACCESS_GROUP,
    ACCESS_TOPIC,
    ORDER_GROUP,
    ORDER_TOPIC,
    processed_events,
    table,
)


def text(*parts) -> Column:
    """Concatenate literals (plain str starting with '=') and columns as text."""
    return F.concat(
        *[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else F.col(p).cast("string")
          if isinstance(p, str) else p.cast("string") for p in parts]
    )


# --- offsets ----------------------------------------------------------------------------


def delivered_offsets(spark: SparkSession, directory: str) -> DataFrame:
    """Offsets of all events except views, in blocks of 1,500 dealt to six partitions."""
    events = table(spark, directory, "events")
    return events.filter(F.col("event_type") != "view").select(
        F.lit(ORDER_TOPIC).alias("topic"),
        F.expr("CAST((event_id DIV 1500) % 6 AS INT)").alias("partition"),
        F.col("event_id").alias("offset"),
    )


def end_offsets(spark: SparkSession, directory: str) -> DataFrame:
    """Log end per topic partition of all stored events."""
    return (
        processed_events(spark, directory)
        .groupBy("topic", F.col("partition_id").alias("partition"))
        .agg((F.max("offset_id") + 1).alias("log_end_offset"))
    )


def committed_offsets(spark: SparkSession, directory: str) -> DataFrame:
    """Committed offsets as of 20 January, with a gap and an impossible value.

    Order partition 0 has no commit and order partition 1 is committed beyond its log end.
    """
    markers = processed_events(spark, directory)
    last = F.max(
        F.when(F.col("processed_at") < F.lit("2024-01-20").cast("timestamp"), F.col("offset_id"))
    )
    is_order = F.col("topic") == ORDER_TOPIC
    return (
        markers.groupBy("consumer_group", "topic", F.col("partition_id").alias("partition"))
        .agg((last + 1).alias("_committed"), (F.max("offset_id") + 6).alias("_beyond"))
        .select(
            "consumer_group",
            "topic",
            "partition",
            F.when(is_order & (F.col("partition") == 0), F.lit(-1001))
            .when(is_order & (F.col("partition") == 1), F.col("_beyond"))
            .otherwise(F.col("_committed"))
            .alias("committed_offset"),
        )
    )


def consumer_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Groups seen in the markers, and an audit group per topic that never started."""
    seen = processed_events(spark, directory).select("consumer_group", "topic").distinct()
    never = seen.select(F.lit("audit-consumer").alias("consumer_group"), "topic")
    return seen.withColumn("is_established", F.lit(True)).unionByName(
        never.withColumn("is_established", F.lit(False))
    )


def daily_lag(spark: SparkSession, directory: str) -> DataFrame:
    """Lag of the log group per day: log end that day against the log end one day before.

    Only the daily maxima (days x partitions rows) reach the window.
    """
    by_day = (
        processed_events(spark, directory)
        .filter(F.col("consumer_group") == ACCESS_GROUP)
        .groupBy(F.to_date("processed_at").alias("day"), F.col("partition_id").alias("partition"))
        .agg((F.max("offset_id") + 1).alias("day_end"))
    )
    history = Window.partitionBy("partition").orderBy("day")
    return by_day.select(
        F.col("day").cast("timestamp").alias("observed_at"),
        F.lit(ACCESS_GROUP).alias("consumer_group"),
        F.lit(ACCESS_TOPIC).alias("topic"),
        "partition",
        F.max("day_end").over(history).alias("log_end_offset"),
        F.lag("day_end").over(history).alias("current_offset"),
    ).select("*", (F.col("log_end_offset") - F.col("current_offset")).alias("lag"))


def delivery_attempts(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as one delivery attempt."""
    k = F.get_json_object("props", "$.k").cast("int")
    injection = (
        F.when(k < 5, F.lit("invalid"))
        .when(k < 10, F.lit("stale"))
        .when(k < 20, F.lit("duplicate"))
        .otherwise(F.lit("normal"))
    )
    defects = F.array(F.lit("missing_field"), F.lit("negative_amount"), F.lit("unknown_type"))
    return table(spark, directory, "events").select(
        F.col("event_id").alias("token"),
        F.when(F.col("event_type") == "view", F.lit("log")).otherwise(F.lit("order")).alias("family"),
        injection.alias("injection_kind"),
        F.when(k < 5, F.element_at(defects, k % 3 + 1)).alias("invalid_kind"),
        F.when(k % 50 == 49, F.lit("failed"))
        .when(k % 50 != 48, F.lit("delivered"))
        .alias("outcome"),
        F.col("value").alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("attempted_at"),
    )


# --- catalogs ---------------------------------------------------------------------------


def _snapshot_events(spark: SparkSession, directory: str, snapshot: str) -> DataFrame:
    """Events of a catalog snapshot: 'old' up to 20 January, 'new' from 11 January."""
    events = table(spark, directory, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    if snapshot == "old":
        return events.filter("ts < TIMESTAMP_NTZ '2024-01-21'")
    return events.filter("ts >= TIMESTAMP_NTZ '2024-01-11'")


def catalog_columns(spark: SparkSession, directory: str, snapshot: str) -> DataFrame:
    """Model ``model_<user>`` has a column per number seen; its latest event defines it."""
    events = _snapshot_events(spark, directory, snapshot)
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in ("", "_count", "_rate", "_ms", "_id")]), F.col("k") % 5 + 1
    )
    latest = F.max(F.struct("ts", "event_id", "event_type", "value"))
    return (
        events.groupBy(
            text("=model_", "user_id").alias("model"),
            F.concat(F.lit("c"), (F.col("k") % 40).cast("string"), suffix).alias("column"),
        )
        .agg(latest.alias("_latest"))
        .select(
            "model",
            "column",
            F.when(F.col("_latest.event_type").isin("view", "click"), F.lit("BIGINT"))
            .when(F.col("_latest.event_type") == "signup", F.lit("numeric"))
            .otherwise(F.lit("bigint"))
            .alias("data_type"),
            (F.col("_latest.value") > 40).alias("required"),
            text("=seen as ", "_latest.event_type").alias("description"),
        )
    )


def catalog_models(spark: SparkSession, directory: str, snapshot: str) -> DataFrame:
    """Model attributes from the latest event of each user in the snapshot."""
    events = _snapshot_events(spark, directory, snapshot)
    latest = F.max(F.struct("ts", "event_id", "event_type", "k")).alias("_latest")
    kind, k = F.col("_latest.event_type"), F.col("_latest.k")
    tests = F.array(
        F.concat(F.lit("unique:c"), (k % 3).cast("string")),
        F.concat(F.lit("not_null:c"), (k % 7).cast("string")),
        F.lit("accepted_values:c1"),
    )
    return (
        events.groupBy(text("=model_", "user_id").alias("model"))
        .agg(latest)
        .select(
            "model",
            F.concat(F.lit("Grain: one row per key"), (k % 4).cast("string"), F.lit(". Note "), kind)
            .alias("grain"),
            (k % 5 != 0).alias("contract_enforced"),
            F.when(k % 2 == 0, F.lit("table")).otherwise(F.lit("view")).alias("materialized"),
            F.when(k % 3 != 0, F.concat(F.lit("key"), (k % 3).cast("string"))).alias("unique_key"),
            kind.alias("owner"),
            F.concat((k % 6).cast("string"), F.lit("0 minutes")).alias("sla"),
            tests.alias("tests"),
        )
    )


#: Kinds of lineage nodes; a node's number holds its kind above bit 60 and its key below.
NODE_KINDS = ("customer", "order", "part", "supplier")
_KEY_LIMIT = 1 << 59


def node_number(kind: str, key: str) -> Column:
    """A lineage node as one number, smaller to keep and to send than its text."""
    fits = F.col(key).between(-_KEY_LIMIT, _KEY_LIMIT - 1)
    number = F.col(key).cast("bigint") + F.lit(NODE_KINDS.index(kind) << 60).cast("bigint")
    return F.when(~fits, F.raise_error(F.lit(f"a {kind} key is beyond 59 bits"))).otherwise(number)


def node_text(number: Column) -> Column:
    """The id of a numbered lineage node: ``kind.key``."""
    kind = F.shiftright(number + _KEY_LIMIT, 60)
    prefixes = F.array(*[F.lit(f"{name}.") for name in NODE_KINDS])
    return F.concat(F.element_at(prefixes, (kind + 1).cast("int")), (number - F.shiftleft(kind, 60)).cast("string"))


def numbered_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Customer to order to part to supplier edges of the whole tables, as node numbers."""
    orders = table(spark, directory, "orders")
    items = table(spark, directory, "lineitem")

    def edges(rows: DataFrame, upstream: tuple[str, str], downstream: tuple[str, str]) -> DataFrame:
        return rows.select(upstream[1], downstream[1]).distinct().select(
            node_number(*upstream).alias("upstream"), node_number(*downstream).alias("downstream")
        )

    placed = edges(orders, ("customer", "o_custkey"), ("order", "o_orderkey"))
    held = edges(items, ("order", "l_orderkey"), ("part", "l_partkey"))
    supplied = edges(items, ("part", "l_partkey"), ("supplier", "l_suppkey"))
    return placed.unionByName(held).unionByName(supplied)


def lineage_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Customer to order to part to supplier edges of the whole tables."""
    edges = numbered_edges(spark, directory)
    return edges.select(node_text(F.col("upstream")).alias("upstream"), node_text(F.col("downstream")).alias("downstream"))


def numbered_assets(spark: SparkSession, directory: str) -> DataFrame:
    """Every customer, order, part and supplier as a numbered asset; suppliers form the mart layer."""

    def assets(name: str, key: str, kind: str, layer: str) -> DataFrame:
        return table(spark, directory, name).select(
            node_number(kind, key).alias("asset_id"), F.lit(layer).alias("layer")
        )

    return (
        assets("customer", "c_custkey", "customer", "source")
        .unionByName(assets("orders", "o_orderkey", "order", "staging"))
        .unionByName(assets("part", "p_partkey", "part", "intermediate"))
        .unionByName(assets("supplier", "s_suppkey", "supplier", "marts"))
    )


def lineage_assets(spark: SparkSession, directory: str) -> DataFrame:
    """Every customer, order, part and supplier as an asset; suppliers form the mart layer."""
    assets = numbered_assets(spark, directory)
    return assets.select(node_text(F.col("asset_id")).alias("asset_id"), "layer")


def query_estimates(spark: SparkSession, directory: str) -> DataFrame:
    """Every order as one query estimate."""
    orders = table(spark, directory, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    models = F.array(
        *[
            F.lit(name)
            for name in (
                "mart_daily_sales",
                "mart_service_health",
                "fct_order_events",
                "fct_orders",
                "adhoc_report",
            )
        ]
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    waived = customer % 4 == 0
    return orders.select(
        key.alias("query_id"),
        F.element_at(models, level).alias("model"),
        (customer % 11 != 0).alias("valid"),
        F.when(
            key % 13 != 0,
            F.floor(F.col("o_totalprice") * 2500) * F.when(key % 17 == 0, -1).otherwise(1),
        ).alias("total_bytes_processed"),
        (customer % 3 != 0).alias("partition_filter_present"),
        (key % 12).cast("int").alias("requested_scan_window_days"),
        F.when(level == 2, F.lit(7)).otherwise(F.lit(31)).alias("maximum_scan_window_days"),
        waived.alias("has_waiver"),
        F.when(waived & (key % 5 != 0), F.lit("data team")).alias("waiver_owner"),
        F.when(waived, F.when(key % 7 == 0, F.lit("  ")).otherwise(F.lit("migration"))).alias(
            "waiver_reason"
        ),
        F.when(
            waived,
            F.when(key % 9 == 0, F.lit("2026-01-01T00:00:00"))
            .when(key % 9 == 1, F.lit("2020-01-01T00:00:00Z"))
            .otherwise(F.lit("2030-01-01T00:00:00Z")),
        ).alias("waiver_expires_at"),
        F.when(waived & (key % 10 != 0), F.lit(900_000_000).cast("bigint")).alias(
            "waiver_approved_bytes"
        ),
    )


def part_thresholds(spark: SparkSession, directory: str, snapshot: str) -> DataFrame:
    """A blocking threshold per part from its price; the new one also adds its size."""
    price = F.floor(F.col("p_retailprice") * 1000).cast("bigint")
    value = price if snapshot == "old" else price + (F.col("p_size") - 25) * 1000
    return table(spark, directory, "part").select(
        text("=part.", "p_partkey").alias("model"), value.alias("blocking_threshold_bytes")
    )


def part_waivers(spark: SparkSession, directory: str) -> DataFrame:
    """A waiver for every part whose size is even."""
    key = F.col("p_partkey")
    return (
        table(spark, directory, "part")
        .filter(F.col("p_size") % 2 == 0)
        .select(
            text("=part.", "p_partkey").alias("model"),
            F.col("p_brand").alias("waiver_owner"),
            F.when(key % 5 != 0, F.col("p_type")).alias("waiver_reason"),
            F.when(key % 7 == 0, F.lit("2020-01-01T00:00:00Z"))
            .otherwise(F.lit("2030-01-01T00:00:00Z"))
            .alias("waiver_expires_at"),
            F.floor(F.col("p_retailprice") * 1010).cast("bigint").alias("waiver_approved_bytes"),
        )
    )


def order_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """Every order as an asset node."""
    key = F.col("o_orderkey")
    return table(spark, directory, "orders").select(
        text("=order.", "o_orderkey").alias("asset_id"),
        F.when(key % 10 != 0, text("=order ", "o_orderkey")).alias("name"),
        F.when(key % 6 == 0, F.lit("source")).otherwise(F.lit("model")).alias("resource_type"),
        F.when(key % 4 != 0, F.lit("marts")).alias("layer"),
        F.when(key % 3 == 0, F.lit("Grain: one row per order. Total below."))
        .when(key % 3 == 1, F.lit("Orders by priority."))
        .alias("description"),
        (F.col("o_orderstatus") == "F").alias("contract_enforced"),
    )


def order_freshness(spark: SparkSession, directory: str) -> DataFrame:
    """A freshness status for every finished order."""
    return (
        table(spark, directory, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(
            text("=order.", "o_orderkey").alias("asset_id"),
            F.when(F.col("o_custkey") % 2 == 0, F.lit("pass")).otherwise(F.lit("warn")).alias("status"),
        )
    )


def item_results(spark: SparkSession, directory: str) -> DataFrame:
    """A test result per line item, with its order as the tested asset."""
    status = (
        F.when(F.col("l_quantity") > 48, F.lit("fail"))
        .when(F.col("l_quantity") > 40, F.lit("warn"))
        .when(F.col("l_quantity") > 38, F.lit(None))
        .otherwise(F.lit("pass"))
    )
    return table(spark, directory, "lineitem").select(
        text("=test.", "l_orderkey", "=.", "l_linenumber", "=.", "l_partkey", "=.", "l_suppkey").alias(
            "unique_id"
        ),
        status.alias("status"),
        text("=order.", "l_orderkey").alias("asset_id"),
    )


def item_columns(spark: SparkSession, directory: str) -> DataFrame:
    """A declared column per line item number of an order."""
    return (
        table(spark, directory, "lineitem")
        .groupBy(text("=order.", "l_orderkey").alias("asset_id"), text("=line_", "l_linenumber").alias("column"))
        .agg(F.max("l_quantity").alias("_q"), F.max("l_returnflag").alias("_flag"))
        .select(
            "asset_id",
            "column",
            F.lit("numeric").alias("data_type"),
            (F.col("_q") > 25).alias("required"),
            F.when(F.col("_flag") != "A", text("=flag ", "_flag")).alias("description"),
        )
    )


def observed_columns(spark: SparkSession, directory: str) -> DataFrame:
    """Observed types: none for the first line, blank for the second, bigint for the rest."""
    return (
        table(spark, directory, "lineitem")
        .filter("l_linenumber > 1")
        .select(
            text("=order.", "l_orderkey").alias("asset_id"),
            text("=line_", "l_linenumber").alias("column"),
            F.when(F.col("l_linenumber") == 2, F.lit("")).otherwise(F.lit("bigint")).alias("data_type"),
        )
        .distinct()
    )
