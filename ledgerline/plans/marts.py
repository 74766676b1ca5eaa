"""Published marts as slices in versions, with one manifest per version that readers follow.

A slice is a day of a partitioned mart, or a bucket of the unique key's hash. A change writes only
the slices that it touches, into a new folder

    <root>/<mart>/files/version=<n>/<slice column>=<value>

and then one manifest file, which names the version of every slice. Readers take the newest
manifest, so they see all of a change or nothing of it: a crash before the manifest leaves files that
nobody reads, and the next change overwrites them. A slice that loses all its rows is not named any
more. Older versions stay until ``vacuum``. A mart takes one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.quality import enforce_contract
from ledgerline.schemas import CONTRACTS, Contract
from ledgerline.sources.tables import write_table

#: Slices of a mart without a day column.
KEY_BUCKETS = 64
_VERSION = T.StructField("version", T.LongType())
_FILE_VERSION = T.StructField("file_version", T.LongType())


def slice_field(contract: Contract) -> T.StructField:
    if contract.partition_column is None:
        return T.StructField("key_bucket", T.IntegerType())
    return contract.schema[contract.partition_column]


def with_slice(table: DataFrame, contract: Contract) -> DataFrame:
    if contract.partition_column is not None:
        return table
    bucket = F.pmod(F.xxhash64(*contract.unique_key), F.lit(KEY_BUCKETS)).cast("int")
    return table.withColumn("key_bucket", bucket)


def _read(spark: SparkSession, path: str, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType(fields)
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _manifests(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    fields = [slice_field(contract), _FILE_VERSION, _VERSION]
    return _read(spark, f"{root}/{contract.name}/manifest", fields)


def _files(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    place = slice_field(contract)
    fields = [*(f for f in contract.schema.fields if f.name != place.name), _VERSION, place]
    return _read(spark, f"{root}/{contract.name}/files", fields)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def current_version(spark: SparkSession, root: str, contract: Contract) -> int:
    """The newest published version; 0 before the first."""
    newest = _manifests(spark, root, contract).agg(F.max("version")).first()[0]
    return newest or 0


def manifest(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    """(slice, file_version) of the newest version."""
    version = current_version(spark, root, contract)
    newest = _manifests(spark, root, contract).filter(F.col("version") == version).drop("version")
    return newest.filter(F.col("file_version").isNotNull())


def read_slices(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    """The current rows with their slice column; filters on it prune the folders."""
    live = manifest(spark, root, contract).withColumnRenamed("file_version", "version")
    rows = _files(spark, root, contract).join(live, ["version", slice_field(contract).name], "left_semi")
    return rows.drop("version")


def read_mart_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    contract = CONTRACTS[name]
    return read_slices(spark, root, contract).select(*contract.columns)


def write_slices(
    table: DataFrame, root: str, contract: Contract, touched: DataFrame | None = None
) -> None:
    """Publish ``table`` as the new content of the ``touched`` slices, or as the whole mart."""
    spark, place = table.sparkSession, slice_field(contract).name
    version = current_version(spark, root, contract) + 1
    folder = f"{root}/{contract.name}/files/version={version}"
    rows = with_slice(enforce_contract(table, contract), contract)
    write_table(rows, folder, partition_column=place)
    written = _files(spark, root, contract).filter(F.col("version") == version)
    entries = written.select(place).distinct().withColumn("file_version", F.lit(version).cast("long"))
    if touched is not None:
        kept = manifest(spark, root, contract).join(touched.select(place).distinct(), place, "left_anti")
        entries = kept.unionByName(entries)
    # one row without a slice, so that a mart that lost all its rows has a manifest too
    nothing = T.StructType([slice_field(contract), _FILE_VERSION])
    entries = entries.unionByName(spark.createDataFrame([(None, None)], _nullable(nothing)))
    target = f"{root}/{contract.name}/manifest/version={version}"
    entries.coalesce(1).write.mode("overwrite").parquet(target)


def vacuum(spark: SparkSession, root: str, name: str) -> None:
    """Empty the folders of versions that the current manifest does not name."""
    contract = CONTRACTS[name]
    version = current_version(spark, root, contract)
    live = manifest(spark, root, contract).select(F.col("file_version").alias("version")).distinct()
    held = _files(spark, root, contract).select("version").distinct()
    for row in held.join(live, "version", "left_anti").collect():
        _empty(spark, f"{root}/{name}/files/version={row.version}")
    older = _manifests(spark, root, contract).filter(F.col("version") < version)
    for row in older.select("version").distinct().collect():
        _empty(spark, f"{root}/{name}/manifest/version={row.version}")


def _empty(spark: SparkSession, path: str) -> None:
    nothing = spark.createDataFrame([], "value int, part int")
    nothing.write.mode("overwrite").partitionBy("part").parquet(path)
