"""Idempotency operators: first occurrence, conflicting reuse, and the pending filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_occurrences(
    records: DataFrame, key: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Keep the first row of every key in the given order.

    Written as the minimum of a struct, so copies collapse map-side before the shuffle; a
    key with very many copies never gathers in one task as it would under a window.
    """
    others = [name for name in records.columns if name not in key and name not in order_by]
    return (
        records.groupBy(*key)
        .agg(F.min(_comparable(records, [*order_by, *others])).alias("_first"))
        .select(*key, *[F.col(f"_first.{name}") for name in [*order_by, *others]])
        .select(*records.columns)
    )


def _comparable(records: DataFrame, names: Sequence[str]):
    return F.struct(*[F.col(name) for name in names])


#: Rows of one reused key that meet in one task; a key with more is dealt to several.
HOT = 100_000


def conflicting_reuse(
    records: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str],
    compared: Sequence[str],
    hot: int = HOT,
) -> DataFrame:
    """Rows whose compared columns differ from those of the first row with the same key.

    Only keys that really hold two different values take part. The rows of a key with more than
    ``hot`` rows are spread over as many salts as it needs, and only its one row per key is repeated,
    so one reused key cannot gather all of its copies in a single task and few rows are repeated.
    The join is never a broadcast: Spark takes the size from the compressed files below, so a
    table of conflicts far too large for the driver would pass as small.
    """
    value = F.struct(*compared)
    disagreeing = (
        records.groupBy(*key)
        .agg(
            F.min(F.struct(*order_by, value.alias("_value"))).alias("_first"),
            F.min(value).alias("_least"),
            F.max(value).alias("_greatest"),
            F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("_salts"),
        )
        .filter(~F.col("_least").eqNullSafe(F.col("_greatest")))
    )
    # at most one row per ``hot`` records; naming _first lets both uses share one aggregate
    wide = disagreeing.filter((F.col("_salts") > 1) & F.col("_first").isNotNull()).select(*key, "_salts")
    salt = F.pmod(F.xxhash64(*order_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = records.join(F.broadcast(wide), [*key], "left").withColumn("_salt", salt)
    expected = disagreeing.select(
        *key,
        F.col("_first._value").alias("_expected"),
        F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
    )
    return (
        salted.join(expected.hint("merge"), [*key, "_salt"])
        .filter(~value.eqNullSafe(F.col("_expected")))
        .select(*records.columns)
    )


def pending(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Records whose (consumer_group, event_id) has no marker yet."""
    key = ["consumer_group", "event_id"]
    return records.join(markers.select(*key), key, "left_anti")
