"""Connected components of an edge table by alternating star steps.

Each step is a grouping and a join; the edges never grow beyond the input's number, hubs are minima
with map-side partial results, and AQE splits a hub's partition in the join. Steps are cut off with
reliable checkpoints and repeated until nothing changes, so the result does not depend on the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node it is connected with."""
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    state = _state(current)
    while state[0]:
        current = stored(_small_star(_large_star(current)))
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
