"""Windows that share a minimiser, packed as one string, and the removals that come back.

A text is a row of units (words or bytes). Each window of ``size`` units has a minimiser: the
``gram`` of units with the smallest rank in it, the leftmost of equals. Neighbouring windows with the
same minimiser form one superstring. Equal windows have equal minimisers, so dealing superstrings to
buckets by minimiser brings all equal windows together.

A chunk of an Arrow batch pre-aggregates: equal superstrings are sent once, whatever a passage's share of all
rows. Removals ("cuts") travel as (first unit, windows) runs per row and are joined to the texts once.

Rows are told apart by doc_id and a 64-bit digest of their text, so rows that share an id do not mix;
equal rows have equal results and are all kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ledgerline.llm.blocks import LEVEL, pack, to_buckets, unpack
from ledgerline.llm.common import NULL_ID, doc_key, map_arrow, map_batches, texts

#: Buckets a partition works off one after another, to divide its memory.
ROUNDS = 4
#: Units of a batch that are ranked at a time.
CHUNK = 1 << 20

_POSITION = np.uint64((1 << 24) - 1)

EXCHANGE = "partition int, bucket int, block binary"
CUTS = "doc_key long, digest long, cuts binary"


def sliding_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by doubling."""
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if reach < width:
        step = width - reach
        keys = np.minimum(keys[:-step], keys[step:])
    return keys


def segments(ranks: np.ndarray, allowed: np.ndarray, width: int):
    """Superstrings over a chunk: first window, number of windows, place of the minimiser.

    ``ranks`` are those of the grams; ``allowed`` marks the windows that lie in one document.
    """
    keys = (ranks & ~_POSITION) | np.arange(len(ranks), dtype=np.uint64)
    lowest = (sliding_minima(keys, width) & _POSITION).astype(np.int64)
    windows = np.flatnonzero(allowed[: len(lowest)])
    if not len(windows):
        return windows, windows, windows
    place = lowest[windows]
    fresh = np.ones(len(windows), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(windows)))
    return windows[first], count, place[first]


def chunks_of(lengths: list[int], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Documents in groups of about ``CHUNK`` units as (row, first unit, end).

    A longer document is cut into parts that overlap by ``size - 1`` units: each window is in one.
    """
    group, held = [], 0
    for row, length in enumerate(lengths):
        start = 0
        while True:
            end = min(length, start + CHUNK + size - 1)
            group.append((row, start, end))
            held += end - start
            if held >= CHUNK:
                yield group
                group, held = [], 0
            if end == length:
                break
            start = end - (size - 1)
    if group:
        yield group


def window_mask(group: list[tuple[int, int, int]], size: int, total: int) -> np.ndarray:
    """Marks of the units of a chunk where a window inside one document begins."""
    mask = np.zeros(total, dtype=bool)
    at = 0
    for _, start, end in group:
        if end - start >= size:
            mask[at : at + end - start - size + 1] = True
        at += end - start
    return mask


def digest_of(raw: bytes) -> int:
    """A signed 64-bit digest that tells texts of one doc_id apart."""
    value = xxh3_64_intdigest(raw)
    return value - (1 << 64) if value >> 63 else value


def text_digest(text: str) -> int:
    return digest_of(text.encode("utf-8", "surrogatepass"))


def sources(documents: DataFrame) -> DataFrame:
    return documents.select(doc_key().alias("doc_key"), "text")


def block_rows(blocks: dict[int, bytes], partitions: int) -> dict[str, list]:
    buckets = list(blocks)
    return {
        "partition": [b % partitions for b in buckets],
        "bucket": buckets,
        "block": list(blocks.values()),
    }


def cut_block(keys: np.ndarray, digests: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    return pack(
        keys.astype(np.int64), digests.astype(np.int64), first.astype(np.int64), count.astype(np.int64)
    )


def cut_rows(keys: np.ndarray, digests: np.ndarray, first: np.ndarray, count: np.ndarray) -> dict[str, list]:
    """Cuts grouped by row, as (first, count) pairs of 64-bit numbers; those of equal rows once."""
    order = np.lexsort((count, first, digests, keys))
    keys, digests, first, count = keys[order], digests[order], first[order], count[order]
    new = np.ones(len(keys), dtype=bool)
    for k, column in enumerate((keys, digests, first, count)):
        differs = column[1:] != column[:-1]
        new[1:] = differs if k == 0 else new[1:] | differs
    keys, digests = keys[new], digests[new]
    pairs = np.stack((first[new], count[new]), axis=1).astype("<i8")
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])
    edges = np.append(np.flatnonzero(fresh), len(keys))
    return {
        "doc_key": keys[edges[:-1]],
        "digest": digests[edges[:-1]],
        "cuts": [pairs[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())],
    }


def resolve_buckets(
    exchanged: DataFrame, partitions: int, judge: Callable[[list[list]], Iterator[tuple]]
) -> DataFrame:
    """Shuffle blocks to their buckets and let ``judge`` turn each bucket's blocks into cuts.

    Rows of bucket -1 - n hold cuts that their batch could already tell; they pass through.
    """
    ready = to_buckets(exchanged, partitions, "partition").sortWithinPartitions("bucket")

    def function(batches):
        import pyarrow as pa

        from ledgerline.llm.common import arrow_schema

        schema = arrow_schema(cuts_schema)
        current, held = None, []

        def out(columns):
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
            )

        def finished():
            for keys, digests, first, count in judge(held):
                if len(keys):
                    yield out(cut_rows(keys, digests, first, count))

        for batch in batches:
            for bucket, block in zip(batch.column(1).to_pylist(), batch.column(2)):
                parts = unpack(block.as_py())
                if bucket < 0:
                    keys, digests, first, count = parts
                    yield out(cut_rows(keys, digests, first, count))
                    continue
                if bucket != current and held:
                    yield from finished()
                    held = []
                current = bucket
                held.append(parts)
        if held:
            yield from finished()

    cuts_schema = exchanged.sparkSession.createDataFrame([], CUTS).schema
    return map_arrow(ready, function, cuts_schema)


def _packed_texts(documents: DataFrame) -> DataFrame:
    """(doc_key, digest, packed): texts compressed for the one shuffle that they take part in."""

    def function(batch):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        digests, packed = [], []
        for text in texts(batch):
            raw = text.encode("utf-8", "surrogatepass")
            digests.append(digest_of(raw))
            packed.append(packer.compress(raw))
        yield {"doc_key": batch.column(0), "digest": digests, "packed": packed}

    return map_batches(sources(documents), function, "doc_key long, digest long, packed binary")


def with_cuts(documents: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of (doc_id, packed, cuts): each text with all its cuts, an array of binaries or null.

    Equal rows of one id have equal cuts; a set keeps them once, so that the list does not grow with
    the number of copies.
    """
    gathered = cuts.groupBy("doc_key", "digest").agg(F.collect_set("cuts").alias("cuts"))
    return _packed_texts(documents).join(gathered, ["doc_key", "digest"], "left").select(
        F.when(F.col("doc_key") != NULL_ID, F.col("doc_key")).alias("doc_id"), "packed", "cuts"
    )


def covered(cuts: list[bytes] | None, length: int, size: int) -> np.ndarray:
    """Marks of the units that the cut windows cover."""
    marks = np.zeros(length + 1, dtype=np.int64)
    if cuts:
        pairs = np.frombuffer(b"".join(cuts), "<i8").reshape(-1, 2)
        np.add.at(marks, pairs[:, 0], 1)
        np.add.at(marks, pairs[:, 0] + pairs[:, 1] + size - 1, -1)
    return np.cumsum(marks[:-1]) > 0


def finish(
    documents: DataFrame, cuts: DataFrame, function: Callable, schema: str
) -> DataFrame:
    """Apply ``function(bytes of the text, cuts)``, the columns after doc_id, to every row."""
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batch):
        rows = [
            function(zstandard.decompress(packed.as_py()), cut.as_py())
            for packed, cut in zip(batch.column(1), batch.column(2))
        ]
        columns = list(zip(*rows)) or [[] for _ in names]
        yield {"doc_id": batch.column(0)} | dict(zip(names, map(list, columns)))

    return map_batches(with_cuts(documents, cuts), run, f"doc_id long, {schema}")
