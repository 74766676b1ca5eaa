"""Exact mean and nearest-rank percentiles at any scale.

The nearest-rank percentile of *n* samples is the sample of rank ``ceil(p * n)``; nothing is
interpolated. Equal samples collapse into (value, count) first. The rank is then located in
two histogram steps, coarse logarithmic bins and equal-width bins inside the chosen one, and
only the distinct values of one fine bin are ranked. No task sees a whole group: the windows
run over at most ``_FINE_BINS`` bins or the distinct values of a single fine bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COARSE_PER_OCTAVE = 256
_FINE_BINS = 65_536
_LAST_BIN = (1 << 63) - 1


def nearest_rank_percentiles(
    samples: DataFrame, value: str, percentiles: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Rows (keys..., percentile, value) for every non-empty group; NULL samples are ignored."""
    if not all(0 < p <= 1 for p in percentiles):
        raise ValueError("a percentile must be greater than 0 and at most 1")
    keys = list(by)
    # Bins only need to be monotone in the value; both functions below are.
    # NaN is the largest value, as in Spark's own order.
    coarse = F.when(F.isnan("_v"), F.lit(_LAST_BIN)).otherwise(
        F.floor(F.signum("_v") * F.log2(1 + F.abs("_v")) * _COARSE_PER_OCTAVE).cast("bigint")
    )
    counted = (
        samples.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_coarse", coarse)
    )
    coarse_bins = counted.groupBy(*keys, "_coarse").agg(
        F.sum("_n").alias("_bin_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    per_group = Window.partitionBy(*keys)
    wanted = coarse_bins.withColumn("_total", F.sum("_bin_n").over(per_group)).withColumn(
        "_below", F.sum("_bin_n").over(per_group.orderBy("_coarse")) - F.col("_bin_n")
    )
    ranked = wanted.withColumn("percentile", F.explode(_literals(percentiles))).withColumn(
        "_rank", F.ceil(F.col("percentile") * F.col("_total"))
    )
    in_coarse = ranked.filter(_holds_rank("_bin_n")).select(
        *keys, "percentile", "_rank", "_below", "_coarse", "_low", "_high"
    )

    candidates = _null_safe_join(counted, in_coarse, keys, ["_coarse"]).withColumn("_fine", _fine_bin())
    target = [*keys, "percentile"]
    per_target = Window.partitionBy(*target)
    fine_bins = candidates.groupBy(*target, "_fine", "_rank", "_below").agg(
        F.sum("_n").alias("_bin_n")
    )
    in_fine = (
        fine_bins.withColumn(
            "_below",
            F.col("_below") + F.sum("_bin_n").over(per_target.orderBy("_fine")) - F.col("_bin_n"),
        )
        .filter(_holds_rank("_bin_n"))
        .select(*target, "_fine", F.col("_below").alias("_fine_below"))
    )
    finalists = _null_safe_join(candidates, in_fine, keys, ["percentile", "_fine"]).withColumn(
        "_below",
        F.col("_fine_below") + F.sum("_n").over(per_target.orderBy("_v")) - F.col("_n"),
    )
    return finalists.filter(_holds_rank("_n")).select(*target, F.col("_v").alias("value"))


def _null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], others: Sequence[str]
) -> DataFrame:
    """Inner join on keys, of which NULL equals NULL, and on columns that are never NULL."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in (*keys, *others)})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    for key in others:
        if key in left.columns:
            same = same & (F.col(key) == F.col(f"_right_{key}"))
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in (*keys, *others)])


def _literals(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(value)) for value in values])


def _holds_rank(size: str) -> Column:
    return (F.col("_rank") > F.col("_below")) & (F.col("_rank") <= F.col("_below") + F.col(size))


def _fine_bin() -> Column:
    width = F.col("_high") - F.col("_low")
    position = (F.col("_v") - F.col("_low")) / F.nullif(width, F.lit(0.0))
    return F.coalesce(F.floor(position * _FINE_BINS), F.lit(0)).cast("bigint")


def sample_summary(
    samples: DataFrame, value: str, percentiles: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: sample count, mean and one column per percentile (p50, p95, ...)."""
    keys = list(by)
    names = {p: "p" + f"{p * 100:g}".replace(".", "_") for p in percentiles}
    totals = samples.groupBy(*keys).agg(
        F.count(value).alias("sample_count"), F.avg(value).alias("average")
    )
    ranks = nearest_rank_percentiles(samples, value, percentiles, keys).select(
        *keys,
        *[
            F.when(F.col("percentile") == float(p), F.col("value")).alias(name)
            for p, name in names.items()
        ],
    )
    # One row per group from the totals and one per percentile: a union and an aggregate
    # put them side by side without a join.
    parts = totals.unionByName(ranks, allowMissingColumns=True)
    measures = ["sample_count", "average", *names.values()]
    return parts.groupBy(*keys).agg(*[F.max(name).alias(name) for name in measures])
