"""Session settings the pipelines rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"

# Runtime settings. UTC is a correctness requirement (dates and minutes are UTC);
# the rest let AQE coalesce, split skewed partitions and pick join strategies from
# measured sizes instead of estimates.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot does not compile methods above 8,000 bytes; the record decoder's fused method
    # is larger and runs faster as separate projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Shuffle files go when the write that made them ends; else they stay until the driver collects its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only where none is named.

    A cluster names its shared folder in ``spark.checkpoint.dir``. The fallback exists for
    single-machine runs such as tests; on a cluster without the setting it refuses, since a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR_KEY, None)
    current = context.getCheckpointDir()
    if current and (named is None or named.rstrip("/") in current):
        return current
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR_KEY} to a shared folder")
        named = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def stored(frame: DataFrame, *, dictionaries: bool = True) -> DataFrame:
    """Write ``frame`` once to the shared checkpoint folder, compressed, and return the written table.

    Without ``dictionaries`` rows that are nearly all different are written faster.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = frame.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        writer.option("parquet.enable.dictionary", str(dictionaries).lower()).parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(frame.schema).parquet(path)
