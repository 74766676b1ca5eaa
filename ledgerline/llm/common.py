"""Helpers shared by the text operators.

Operators read only the columns they name, so extra columns of the input never clash with their own.
Intermediate results that several jobs read are written once to the shared folder named by
``spark.checkpoint.dir``: they outlive lost executors and cut the lineage.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.session import ensure_checkpoint_dir

#: Stands for a null document id where ids are compared: no document is smaller because of it.
NULL_ID = (1 << 63) - 1

#: ASCII bytes that separate words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stored(frame: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write ``frame`` to the shared folder once and return the written table."""
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    writer = frame.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def doc_key(column: str = "doc_id"):
    """The id used in comparisons; null ids share one key behind all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def _importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is shipped as usual (``--py-files`` or installed); the extra entry is
    then a folder that does not exist there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def map_arrow(frame: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with functions of this package."""
    _importable(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def apply_arrow(grouped, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``applyInArrow`` with functions of this package; the groups must be bounded."""
    _importable(SparkSession.active())
    return grouped.applyInArrow(function, schema)


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict[str, list]]], schema: str
) -> DataFrame:
    """Apply ``function`` to Arrow batches; it yields columns as lists or Arrow arrays.

    Batches hold at most 10,000 rows and 64 MB by Spark's defaults, so memory does not depend on
    the size of a partition.
    """
    empty = frame.sparkSession.createDataFrame([], schema).schema
    arrow = arrow_schema(empty)

    def run(batches):
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[field.name], field.type) for field in arrow], schema=arrow
                )

    return map_arrow(frame, run, empty)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """Texts one by one; null is the empty text."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""


def slices(count: int, size: int) -> Iterator[slice]:
    for start in range(0, count, size):
        yield slice(start, start + size)
