"""Raw JSON records rendered from every row of the ``events`` table, some with defects.

The defect of a record follows from its number, so the expected outcome of every record can
be restated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.adapters import ACCESS_TOPIC, ORDER_TOPIC, access_events, order_fields, uuid_text

# A record whose number leaves this remainder carries the named defect.
ORDER_CYCLE = 23
ORDER_DEFECTS = {
    "missing_order_id": 0,
    "negative_amount": 1,
    "unsupported_currency": 2,
    "unsupported_channel": 3,
    "unknown_type": 4,
    "payload_is_list": 5,
    "truncated_json": 6,
    "invalid_utf8": 7,
    "naive_time": 8,
    "unknown_field": 9,
    "reused_event_id": 10,
    "plain_uuid": 13,
    "other_offset": 14,
    "padded_order_id": 15,
    "oversized_order_id": 16,
}
ACCESS_CYCLE = 19
ACCESS_DEFECTS = {
    "missing_request_id": 0,
    "unsupported_method": 1,
    "status_out_of_range": 2,
    "endpoint_without_slash": 3,
    "order_type": 4,
    "error_log_type": 5,
    "absent_type": 6,
    "truncated_json": 7,
    "sent_twice": 8,
    "reused_with_other_data": 9,
}
COPY_OFFSET = 1_000_000_000


def _iso(timestamp: Column, shift_hours: int = 0, suffix: str = "Z") -> Column:
    moved = timestamp + F.expr(f"INTERVAL {shift_hours} HOURS")
    return F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(suffix))


def _records(rendered: DataFrame, key: str, body: Column, topic: str) -> DataFrame:
    """Raw records, spread over tasks as the partitions of a topic would be."""
    return rendered.select(
        F.col(key).cast("binary").alias("key"),
        body.alias("value"),
        F.lit(topic).alias("topic"),
        F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"),
        F.col("event_time").alias("timestamp"),
    ).repartition("partition", "offset")


def order_records(spark: SparkSession, directory: str) -> DataFrame:
    """One raw record per order event; about half of the remainders carry a defect."""
    events = order_fields(spark, directory)
    remainder = F.col("number") % ORDER_CYCLE

    def has(defect: str) -> Column:
        return remainder == ORDER_DEFECTS[defect]

    is_payment = F.col("event_type").isin("order_paid", "payment_failed")
    failed = F.col("event_type") == "payment_failed"
    order_id = (
        F.when(has("missing_order_id"), F.lit(None))
        .when(has("padded_order_id"), F.concat(F.lit(" \t"), "order_id", F.lit("\n ")))
        .when(has("oversized_order_id"), F.rpad("order_id", 65, "x"))
        .otherwise(F.col("order_id"))
    )
    payload = F.struct(
        order_id.alias("order_id"),
        "user_id",
        "product_id",
        "quantity",
        F.when(has("negative_amount"), F.lit("-1.00"))
        .otherwise(F.col("amount").cast("string"))
        .alias("amount"),
        F.when(has("unsupported_currency"), F.lit("EUR"))
        .otherwise(F.col("currency"))
        .alias("currency"),
        F.when(has("unsupported_channel"), F.lit("store"))
        .otherwise(F.col("channel"))
        .alias("channel"),
        F.when(is_payment, F.concat(F.lit("PAY-"), F.col("number").cast("string"))).alias(
            "payment_id"
        ),
        F.when(F.col("event_type") == "order_paid", F.lit("card")).alias("payment_method"),
        F.when(F.col("event_type") == "order_cancelled", F.lit("changed mind")).alias(
            "cancellation_reason"
        ),
        F.when(failed, F.lit("DECLINED")).alias("failure_code"),
        F.when(failed, F.lit("card declined")).alias("failure_reason"),
    )
    event_id = (
        F.when(has("reused_event_id"), uuid_text(F.col("number") + 1))
        .when(has("plain_uuid"), F.upper(F.replace("event_id", F.lit("-"), F.lit(""))))
        .otherwise(F.col("event_id"))
    )
    event_time = (
        F.when(has("naive_time"), _iso(F.col("event_time"), suffix=""))
        .when(has("other_offset"), _iso(F.col("event_time"), 8, "+08:00"))
        .otherwise(_iso(F.col("event_time")))
    )
    envelope = F.struct(
        event_id.alias("event_id"),
        F.when(has("unknown_type"), F.lit("order_shipped"))
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        F.lit(1).alias("event_version"),
        event_time.alias("event_time"),
        F.lit("checkout").alias("source"),
        payload.alias("payload"),
        F.when(has("unknown_field"), F.lit("yes")).alias("debug"),
    )
    rendered = events.select("*", F.to_json(envelope).alias("text"))
    cut_at = F.length("text") - F.when(has("truncated_json"), 1).otherwise(0)
    listed = F.concat(F.substring_index("text", '"payload":', 1), F.lit('"payload":[1]}'))
    body = (
        F.when(has("invalid_utf8"), F.lit(b"\xff\xfe"))
        .when(has("payload_is_list"), listed.cast("binary"))
        .otherwise(F.substring("text", F.lit(1), cut_at).cast("binary"))
    )
    return _records(rendered, "order_id", body, ORDER_TOPIC)


def access_records(spark: SparkSession, directory: str) -> DataFrame:
    """One raw record per event, and a second one for the two kinds that come back."""
    remainder = F.col("number") % ACCESS_CYCLE

    def has(defect: str) -> Column:
        return remainder == ACCESS_DEFECTS[defect]

    repeats = F.when(has("sent_twice") | has("reused_with_other_data"), 1).otherwise(0)
    events = access_events(spark, directory).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), repeats))
    )
    is_copy = F.col("copy") == 1
    payload = F.struct(
        F.when(~has("missing_request_id"), F.concat(F.lit("REQ-"), F.col("number").cast("string")))
        .alias("request_id"),
        "service",
        F.when(has("endpoint_without_slash"), F.ltrim("endpoint", F.lit("/")))
        .otherwise(F.col("endpoint"))
        .alias("endpoint"),
        F.when(has("unsupported_method"), F.lit("TRACE")).otherwise(F.lit("GET")).alias("http_method"),
        F.when(has("status_out_of_range"), F.lit(700))
        .otherwise(F.col("status_code"))
        .alias("status_code"),
        F.when(is_copy & has("reused_with_other_data"), F.col("response_time_ms") + 1)
        .otherwise(F.col("response_time_ms"))
        .alias("response_time_ms"),
        F.lit("10.0.0.1").alias("client_ip"),
    )
    envelope = F.struct(
        "event_id",
        F.when(has("order_type"), F.lit("order_created"))
        .when(has("error_log_type"), F.lit("application_error_log"))
        .when(~has("absent_type"), F.col("event_type"))
        .alias("event_type"),
        _iso(F.col("event_time")).alias("event_time"),
        F.lit("gateway").alias("source"),
        payload.alias("payload"),
    )
    placed = events.select(
        "service",
        "number",
        "kafka_partition",
        (F.col("kafka_offset") + F.col("copy") * F.lit(COPY_OFFSET)).alias("kafka_offset"),
        "event_time",
        F.to_json(envelope).alias("text"),
    )
    cut_at = F.length("text") - F.when(has("truncated_json"), 1).otherwise(0)
    body = F.substring("text", F.lit(1), cut_at).cast("binary")
    return _records(placed, "service", body, ACCESS_TOPIC)
