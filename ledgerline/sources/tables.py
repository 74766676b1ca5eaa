"""Readers and writers: Kafka and file streams, Parquet and JDBC tables, JSON evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.validation import ACCESS_EVENT_TYPE, ERROR_LOG_EVENT_TYPE
from ledgerline.schemas import LAG_REPORT, RAW_RECORD, TEST_RESULTS
from ledgerline.sources.adapters import ACCESS_TOPIC, ORDER_TOPIC


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int | None = None
) -> DataFrame:
    """Raw records of one topic from its earliest offset (needs the Kafka connector jar).

    Offsets are kept in the query's checkpoint; nothing is committed to the broker.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(*RAW_RECORD.fieldNames())


def record_file_stream(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Raw records from Parquet files of the same shape, as a stream.

    A limit of files or of bytes bounds the micro-batches, not what is read in all.
    """
    reader = spark.readStream.schema(RAW_RECORD)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.parquet(path)


def arrive_in_order(spark: SparkSession, path: str) -> int:
    """Let a file stream deliver the files of a folder in the order of their names; returns their bytes.

    A file stream goes by the time of last change, and tasks that write side by side end in any order.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [file for file in store.listStatus(folder) if file.getPath().getName().startswith("part-")]
    files.sort(key=lambda file: file.getPath().getName())
    newest = max((file.getModificationTime() for file in files), default=0)
    for place, file in enumerate(files, 1 - len(files)):
        store.setTimes(file.getPath(), newest + place, -1)
    return sum(file.getLen() for file in files)


def parquet_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table under its declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    *,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A relational source table, read in parallel slices of one column (needs the driver jar)."""
    return spark.read.jdbc(
        url,
        name,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )


def routed(events: DataFrame, event_json: str = "value") -> DataFrame:
    """Kafka key and topic of outgoing events: orders by order id, logs by service."""
    is_log = F.col("event_type").isin(ACCESS_EVENT_TYPE, ERROR_LOG_EVENT_TYPE)
    return events.select(
        F.when(is_log, F.col("service")).otherwise(F.col("order_id")).alias("key"),
        F.col(event_json).alias("value"),
        F.when(is_log, F.lit(ACCESS_TOPIC)).otherwise(F.lit(ORDER_TOPIC)).alias("topic"),
    )


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as Kafka key and compact JSON value, with JSON payloads left as JSON."""
    payload = F.when(
        F.col("original_payload_encoding") == "json", F.try_parse_json("original_payload")
    ).otherwise(F.col("original_payload").cast("variant"))
    body = F.struct(
        F.date_format("failed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("failed_at"),
        "error_type",
        "error_message",
        "original_topic",
        "original_partition",
        "original_offset",
        "consumer_group",
        "original_key",
        payload.alias("original_payload"),
        "original_payload_encoding",
    )
    return letters.select(F.col("dlq_key").alias("key"), F.to_json(body).alias("value"))


def write_to_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Send key/value rows to a topic (needs the Kafka connector jar)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def lag_report(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Rows of lag report files: one row per snapshot, group and partition.

    A file holds one indented report, or with ``one_per_line`` a report per line, which
    Spark can split between tasks.
    """
    report = spark.read.schema(LAG_REPORT).json(path, multiLine=not one_per_line)
    groups = report.select("observed_at", F.explode("groups").alias("group"))
    return groups.select("observed_at", F.explode("group.rows").alias("row")).select(
        "observed_at",
        "row.consumer_group",
        "row.topic",
        "row.partition",
        F.col("row.current_offset").alias("committed_offset"),
        "row.log_end_offset",
        "row.lag",
        "row.status",
    )


def result_report(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """Rows (unique_id, status) of test-result or freshness files."""
    report = spark.read.schema(TEST_RESULTS).json(path, multiLine=not one_per_line)
    return report.select(F.explode("results").alias("result")).select(
        "result.unique_id", F.coalesce("result.status", F.lit("unknown")).alias("status")
    )


def write_table(
    table: DataFrame,
    path: str,
    *,
    partition_column: str | None = None,
    dynamic: bool = False,
) -> None:
    """Rebuild a table, or with ``dynamic`` only the partitions present in ``table``.

    The rebalance hint lets AQE cut one very large partition value into several files of
    even size and merge small ones, so one busy day does not become one task.
    """
    if partition_column is None:
        table.hint("rebalance").write.mode("overwrite").parquet(path)
        return
    (
        table.hint("rebalance", partition_column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .partitionBy(partition_column)
        .parquet(path)
    )
