"""Views of the synthetic ``events`` table in the shape of the engine's own inputs.

The mapping is arbitrary but fixed, covers every row, and is restated in SQL by the
correctness checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import ACCESS_EVENT_TYPE, MONEY

ORDER_TOPIC = "orders.v1"
ACCESS_TOPIC = "application-logs.v1"
ORDER_GROUP = "order-consumer-v1"
ACCESS_GROUP = "log-consumer-v1"

ORDER_TYPE_OF = {
    "signup": "order_created",
    "purchase": "order_paid",
    "click": "order_cancelled",
    "error": "payment_failed",
}
STATUS_OF = {"view": 200, "click": 201, "signup": 302, "purchase": 404, "error": 503}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _lookup(column: Column, mapping: dict) -> Column:
    result = F.lit(None)
    for key, value in mapping.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def _events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").withColumns(
        {
            "event_time": F.col("ts").cast("timestamp"),
            "k": F.get_json_object("props", "$.k").cast("int"),
        }
    )


def uuid_text(number: Column) -> Column:
    """Canonical UUID-shaped text derived from a number."""
    digest = F.md5(number.cast("string"))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])


def order_fields(spark: SparkSession, directory: str) -> DataFrame:
    """Every non-view event as an order event, with the source number kept as ``number``."""
    kind = _lookup(F.col("event_type"), ORDER_TYPE_OF)
    created = F.col("event_type") == "signup"
    priced = F.col("event_type") != "click"
    channel = F.element_at(
        F.array(F.lit("web"), F.lit("ios"), F.lit("android")), F.col("k") % 3 + 1
    )
    return (
        _events(spark, directory)
        .filter(F.col("event_type") != "view")
        .select(
            F.col("event_id").alias("number"),
            uuid_text(F.col("event_id")).alias("event_id"),
            F.concat_ws(
                "-", F.lit("ORD"), F.col("user_id").cast("string"), (F.col("k") % 10).cast("string")
            ).alias("order_id"),
            kind.alias("event_type"),
            F.concat(F.lit("USR-"), F.col("user_id").cast("string")).alias("user_id"),
            F.when(created, F.concat(F.lit("PRD-"), F.col("k").cast("string"))).alias("product_id"),
            F.when(created, F.col("k") % 5 + 1).cast("int").alias("quantity"),
            F.when(priced, F.col("value").cast(MONEY)).alias("amount"),
            F.when(
                priced, F.when(F.col("user_id") % 2 == 0, F.lit("TWD")).otherwise(F.lit("USD"))
            ).alias("currency"),
            F.when(created, channel).alias("channel"),
            "event_time",
            F.lit(ORDER_TOPIC).alias("kafka_topic"),
            (F.col("user_id") % 6).cast("int").alias("kafka_partition"),
            F.col("event_id").alias("kafka_offset"),
            (F.col("event_time") + F.expr("INTERVAL 1 SECOND")).alias("created_at"),
        )
    )


def valid_orders(spark: SparkSession, directory: str) -> DataFrame:
    return order_fields(spark, directory).drop("number")


def access_events(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as one access-log request."""
    return _events(spark, directory).select(
        F.col("event_id").alias("number"),
        uuid_text(F.col("event_id")).alias("event_id"),
        F.lit(ACCESS_EVENT_TYPE).alias("event_type"),
        "event_time",
        F.concat(F.lit("svc-"), (F.col("user_id") % 9).cast("string")).alias("service"),
        F.concat(F.lit("/e"), (F.col("k") % 3).cast("string")).alias("endpoint"),
        _lookup(F.col("event_type"), STATUS_OF).cast("int").alias("status_code"),
        F.floor(F.col("value") * 10).cast("int").alias("response_time_ms"),
        F.lit(ACCESS_TOPIC).alias("kafka_topic"),
        (F.col("user_id") % 6).cast("int").alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
        (F.col("event_time") + F.expr("INTERVAL 1 SECOND")).alias("updated_at"),
    )


def processed_events(spark: SparkSession, directory: str) -> DataFrame:
    """One idempotency marker per stored order and access event."""

    def markers(events: DataFrame, group: str, processed_at: str) -> DataFrame:
        return events.select(
            F.lit(group).alias("consumer_group"),
            "event_id",
            F.col("kafka_topic").alias("topic"),
            F.col("kafka_partition").alias("partition_id"),
            F.col("kafka_offset").alias("offset_id"),
            F.col(processed_at).alias("processed_at"),
        )

    return markers(valid_orders(spark, directory), ORDER_GROUP, "created_at").unionByName(
        markers(access_events(spark, directory), ACCESS_GROUP, "updated_at")
    )
