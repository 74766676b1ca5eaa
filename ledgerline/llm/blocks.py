"""Packed blocks: what one Arrow batch sends to one bucket, as a single compressed row.

A block is a list of numpy arrays and byte strings. Spark shuffles the rows to their buckets, one
partition each; there they are unpacked one at a time, so memory holds one block, not a bucket.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

LEVEL = 5


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions, the cluster's setting for data size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def to_buckets(frame: DataFrame, count: int, column: str = "bucket") -> DataFrame:
    """Shuffle rows so that bucket n is partition n."""
    return frame.repartitionById(count, column)


def pack(*parts) -> bytes:
    head = np.array([len(parts)], dtype=np.int64)
    body, sizes = [], []
    for part in parts:
        if isinstance(part, np.ndarray):
            code = ord(part.dtype.char)
            data = np.ascontiguousarray(part).tobytes()
        else:
            code, data = 0, part
        sizes += [code, len(data)]
        body.append(data)
    raw = head.tobytes() + np.array(sizes, dtype=np.int64).tobytes() + b"".join(body)
    return zstandard.compress(raw, LEVEL)


def unpack(blob: bytes) -> list:
    raw = zstandard.decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * count, 8)
    at, parts = 8 + 16 * count, []
    for code, size in sizes.reshape(-1, 2).tolist():
        data = raw[at : at + size]
        parts.append(np.frombuffer(data, chr(code)) if code else data)
        at += size
    return parts


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the smallest type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers, for dealing to buckets and ranking; equality is judged on content."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def dealt(values: np.ndarray, count: int) -> np.ndarray:
    return (mixed(values) >> np.uint64(11)).astype(np.int64) % count
