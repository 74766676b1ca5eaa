"""Options of the connectors whose jars are not here, and the declared table reader."""

import pytest
from pyspark.sql import types as T

from ledgerline.schemas import RAW_RECORD
from ledgerline.sources import tables


class Recorder:
    """Stands for a reader or writer and keeps what is asked of it."""

    def __init__(self):
        self.asked = {}

    @property
    def readStream(self):  # noqa: N802
        return self

    read = write = readStream

    def format(self, name):
        self.asked["format"] = name
        return self

    def option(self, name, value):
        self.asked[name] = value
        return self

    def load(self):
        return self

    def select(self, *columns):
        self.asked["columns"] = columns
        return self

    def jdbc(self, url, table, **options):
        self.asked |= {"url": url, "table": table, **options}
        return self

    def save(self):
        self.asked["saved"] = True


@pytest.mark.parametrize("bound, extra", [(None, {}), (500, {"maxOffsetsPerTrigger": 500})])
def test_topic_is_read_from_its_earliest_offset(bound, extra):
    reader = tables.kafka_stream(Recorder(), "host:1", "orders", bound)
    assert reader.asked == {
        "format": "kafka",
        "kafka.bootstrap.servers": "host:1",
        "subscribe": "orders",
        "startingOffsets": "earliest",
        "columns": tuple(RAW_RECORD.fieldNames()),
        **extra,
    }


def test_messages_are_written_to_one_topic():
    writer = Recorder()
    tables.write_to_kafka(writer, "host:1", "dead")
    assert writer.asked == {"format": "kafka", "kafka.bootstrap.servers": "host:1", "topic": "dead", "saved": True}


def test_relational_table_is_read_in_slices():
    reader = tables.jdbc_table(
        Recorder(), "jdbc:x", "order_events", partition_column="event_offset", lower=0, upper=90, partitions=9
    )
    assert reader.asked == {
        "url": "jdbc:x",
        "table": "order_events",
        "column": "event_offset",
        "lowerBound": 0,
        "upperBound": 90,
        "numPartitions": 9,
        "properties": {},
    }


def test_stored_table_keeps_its_declared_schema(spark, tmp_path):
    spark.range(3).selectExpr("id", "id * 2 AS other").write.parquet(str(tmp_path / "t"))
    declared = T.StructType([T.StructField("id", T.LongType()), T.StructField("later", T.StringType())])
    table = tables.parquet_table(spark, str(tmp_path / "t"), declared)
    assert table.schema == declared
    assert sorted(table.collect()) == [(0, None), (1, None), (2, None)]
