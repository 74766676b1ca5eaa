"""Token counts without ids: pieces per distinct pre-token times its frequency in each document.

Each Arrow batch turns its documents into per-document pre-token frequencies and deals them to
buckets by pre-token: a block lists the batch's pre-tokens of that bucket with their (row of the batch,
frequency) postings. In its bucket a pre-token is encoded once and its number of pieces is joined to
all postings; the sums of a block go home to where their batch's other sums meet, and are added up
there by row. Ids and sizes of the batch's documents go home once, not with the postings: what is
shuffled grows with the postings, whatever the number of buckets.

A pre-token that many documents of a batch hold (``HOT`` of them) is dealt by batch instead, so that
a very common one is spread over all buckets, at the price of one encoding in each of them.

Every row of the input gives one row, whatever ids and texts repeat; nulls and empty texts have 0 tokens.
An empty table gives no rows. A task that is repeated must find its rows in the same order, as files
give them; sums of a batch that its home does not know raise an error.
"""

from __future__ import annotations

import zlib
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.blocks import bucket_count, dealt, narrow, pack, to_buckets, unpack
from ledgerline.llm.common import NULL_ID, doc_key, map_arrow, map_batches, texts
from ledgerline.llm.tokens import default_path, piece_counts, pre_tokens

#: Documents of one batch from which a pre-token counts as common.
HOT = 256
#: Bytes of the distinct pre-tokens that a bucket's task keeps encoded at a time.
KEPT_BYTES = 16 << 20
#: Postings and bytes of pre-tokens gathered before blocks are written, to bound a batch of long texts.
FLUSH, FLUSH_BYTES = 2_000_000, 64 << 20
#: A block of one batch: where it is worked on, where its sums go, and whether it has them, else postings.
_BLOCK = "bucket int, home int, batch long, is_rows boolean, block binary"


def _blocks(documents: DataFrame, path: str, buckets: int) -> DataFrame:
    def function(batch, number=[0]):  # noqa: B006  one for each task
        ids, n_bytes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cut = pre_tokens(path)
        units: dict[str, list[int]] = {}
        held, size, first = 0, 0, 0
        for row, text in enumerate(texts(batch)):
            counted = Counter(cut(text))
            for unit, times in counted.items():
                posting = units.get(unit)
                if posting is None:
                    units[unit] = [row - first, times]
                    size += len(unit)
                else:
                    posting += (row - first, times)
            held += len(counted)
            if held > FLUSH or size > FLUSH_BYTES or row + 1 == len(ids):
                yield _packed(units, ids[first : row + 1], n_bytes[first : row + 1], number, buckets)
                units, held, size, first = {}, 0, 0, row + 1

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return map_batches(documents.select(doc_key().alias("doc_id"), size, "text"), function, _BLOCK)


def _packed(units: dict[str, list[int]], ids, n_bytes, number: list[int], buckets: int) -> dict[str, list]:
    """The blocks of one batch: ids and sizes for its home, then postings by bucket."""
    known = np.concatenate(([TaskContext.get().partitionId(), number[0]], ids, n_bytes)).astype(np.int64)
    number[0] += 1
    name = np.frombuffer(blake2b(known.tobytes(), digest_size=8).digest(), np.int64)
    home = int(dealt(name, buckets)[0])
    names = list(units)
    raw = [unit.encode("utf-8", "surrogatepass") for unit in names]
    postings = list(units.values())
    sizes = np.fromiter(map(len, postings), np.int64, len(postings)) // 2
    flat = np.fromiter((x for p in postings for x in p), np.int64, 2 * int(sizes.sum())).reshape(-1, 2)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # rows of a pre-token ascend: the first one, then the steps
    steps = np.diff(flat[:, 0], prepend=0)
    steps[starts[:-1]] = flat[starts[:-1], 0]
    bucket = dealt(np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw)), buckets)
    bucket = np.where(sizes >= HOT, (bucket + home) % buckets, bucket)
    order = np.lexsort((sizes, bucket))
    out_bucket, out_block = [home], [pack(ids, narrow(n_bytes))]
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        chosen = order[begin:end]
        at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in chosen.tolist()])
        chosen_raw = [raw[k] for k in chosen.tolist()]
        out_bucket.append(int(bucket[chosen[0]]))
        out_block.append(
            pack(
                narrow(np.fromiter(map(len, chosen_raw), np.int64, len(chosen_raw))),
                narrow(sizes[chosen]),
                *_bytewise(steps[at]),
                narrow(flat[at, 1]),
                b"".join(chosen_raw),
            )
        )
    count = len(out_block)
    return {
        "bucket": out_bucket,
        "home": [home] * count,
        "batch": [int(name[0])] * count,
        "is_rows": [True] + [False] * (count - 1),
        "block": out_block,
    }


def _bytewise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low bytes of all values and what is above them, which is mostly 0 and packs well apart."""
    return (values & 255).astype(np.uint8), narrow(values >> 8)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 8) | low


def token_counts(documents: DataFrame, tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    """Per document: bytes, tokens, and whether it has more than ``limit`` tokens."""
    path = tokenizer_path or default_path("byte_bpe_50k.json")
    buckets = bucket_count(documents.sparkSession)

    def count(batch, known={}, size=[0]):  # noqa: B006  one for each task
        out: list[bytes] = []
        for blob, is_rows in zip(batch.column(4), batch.column(3).to_pylist()):
            if is_rows:
                out.append(blob.as_py())
                continue
            lengths, sizes, low, high, times, raw = unpack(blob.as_py())
            ends = np.cumsum(lengths.astype(np.int64)).tolist()
            units = [raw[a:b] for a, b in zip([0, *ends], ends)]
            if size[0] > KEPT_BYTES:
                known.clear()
                size[0] = 0
            missing = [u for u in units if u not in known]
            found = piece_counts(path, [u.decode("utf-8", "surrogatepass") for u in missing])
            known.update(zip(missing, found.tolist()))
            size[0] += sum(map(len, missing))
            pieces = np.fromiter((known[u] for u in units), np.int64, len(units))
            sizes = sizes.astype(np.int64)
            rows = np.cumsum(_joined(low, high))  # runs on from one pre-token to the next
            before = np.cumsum(sizes) - sizes
            rows -= np.repeat(np.concatenate(([0], rows[before[1:] - 1])), sizes)
            total = np.zeros(int(rows.max()) + 1, dtype=np.int64)
            np.add.at(total, rows, np.repeat(pieces, sizes) * times.astype(np.int64))
            present = np.flatnonzero(total)
            out.append(pack(*_bytewise(np.diff(present, prepend=0)), *_bytewise(total[present])))
        yield {name: batch.column(name) for name in ("bucket", "home", "batch", "is_rows")} | {"block": out}

    counted = map_batches(to_buckets(_blocks(documents, path, buckets), buckets), count, _BLOCK)
    # the blocks of a batch come home next to each other, ids and sizes first
    met = to_buckets(counted, buckets, "home").sortWithinPartitions("batch", F.desc("is_rows"))
    sums = map_arrow(
        met.select("batch", "is_rows", "block"), _add_up, "doc_id long, n_bytes long, n_tokens long"
    )
    return sums.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def _add_up(batches):
    """The documents of each batch with the sums of its blocks; one batch is held at a time."""
    current, held = None, None
    for blocks in batches:
        names, kinds = blocks.column(0).to_pylist(), blocks.column(1).to_pylist()
        for name, is_rows, blob in zip(names, kinds, blocks.column(2)):
            if is_rows:
                if held:
                    yield _record(*held)
                ids, n_bytes = unpack(blob.as_py())
                current, held = name, (ids, n_bytes, np.zeros(len(ids), dtype=np.int64))
            elif name != current:
                raise RuntimeError("a repeated task found its documents in another order")
            else:
                low, high, below, above = unpack(blob.as_py())
                held[2][np.cumsum(_joined(low, high))] += _joined(below, above)
    if held:
        yield _record(*held)


def _record(*columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x.astype(np.int64)) for x in columns]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])
