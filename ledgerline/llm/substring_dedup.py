"""Substring dedup on 13-word windows by super-k-mer partitioning.

A window's minimiser is a gram of ``GRAM`` words; consecutive windows that share it travel as one
packed string to the bucket of that gram. There all windows are sorted by a hash of their words, equal
hashes are compared word for word, and each distinct window learns the smallest doc_id it starts in.
A window is cut from every document with a larger id.

Inside a chunk of a batch only the document with the smallest id sends a superstring; the others already
know that they lose all its windows. A passage in a third of all documents thus reaches its bucket
once per chunk, not once per document.

Nulls and empty texts have no words. Null doc_ids come after all others. Rows that share a doc_id
are not cut for one another; equal rows have equal results. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from ledgerline.llm.blocks import bucket_count, dealt, mixed, pack
from ledgerline.llm.superstrings import (
    EXCHANGE,
    ROUNDS,
    block_rows,
    text_digest,
    chunks_of,
    covered,
    cut_block,
    finish,
    resolve_buckets,
    segments,
    sources,
    window_mask,
)
from ledgerline.llm.common import map_batches, texts

WINDOW = 13
GRAM = 3
#: Bytes of a bucket whose words are hashed at a time.
HASHED_BYTES = 1 << 20

_MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _combined(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values."""
    count = len(values) - size + 1
    total = values[:count] * _MULTIPLIERS[0]
    for k in range(1, size):
        total += values[k : count + k] * _MULTIPLIERS[k % 64] * np.uint64(k // 64 * 2 + 1)
    return total


def _exchange(documents: DataFrame, partitions: int, size: int) -> DataFrame:
    buckets = partitions * ROUNDS

    def function(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        rows = list(texts(batch))
        digests = np.fromiter(map(text_digest, rows), np.int64, len(rows))
        # only one chunk's words are held at a time; words weigh many times their text
        for group in chunks_of([len(words_of(text)) for text in rows], size):
            words = {row: words_of(rows[row]) for row, _, _ in group}
            yield from _chunk(group, words, keys, digests, partitions, buckets, size)

    return map_batches(sources(documents), function, EXCHANGE)


def _chunk(group, words, keys, digests, partitions, buckets, size):
    listed = [w for row, start, end in group for w in words[row][start:end]]
    if len(listed) < size:
        return
    raw = np.fromiter(map(zlib.crc32, listed), np.uint64, len(listed))
    grams = mixed(_combined(mixed(raw), GRAM))
    first, count, place = segments(
        grams, window_mask(group, size, len(listed)), size - GRAM + 1
    )
    if not len(first):
        return
    whole = b" ".join(listed)
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    strings = [
        whole[a:b] for a, b in zip(begins[first].tolist(), ends[first + count + size - 2].tolist())
    ]
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))

    sizes = np.fromiter((end - start for _, start, end in group), np.int64, len(group))
    chunk_first = np.cumsum(sizes) - sizes
    member = np.searchsorted(chunk_first, first, side="right") - 1
    member_row = np.fromiter((row for row, _, _ in group), np.int64, len(group))
    member_start = np.fromiter((start for _, start, _ in group), np.int64, len(group))
    row = member_row[member]
    start = first - chunk_first[member] + member_start[member]

    owner = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, keys[row])
    loses = keys[row] > owner[which]
    if loses.any():
        yield {
            "partition": [int(keys[0] % partitions)],
            "bucket": [-1 - int(keys[0] % buckets)],
            "block": [cut_block(keys[row][loses], digests[row][loses], start[loses], count[loses])],
        }
    sends = np.flatnonzero(~loses)
    bucket = dealt(grams[place[sends]], buckets)
    order = np.lexsort((start[sends], row[sends], which[sends], bucket))
    sends, bucket = sends[order], bucket[order]
    names = list(known)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    blocks = {}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = sends[a:b]
        text_ids, text_of = np.unique(which[part], return_inverse=True)
        chosen = [names[k] for k in text_ids.tolist()]
        present, local = np.unique(row[part], return_inverse=True)
        blocks[int(bucket[a])] = pack(
            keys[present].astype(np.int64),
            digests[present],
            text_of.astype(np.uint32),
            local.astype(np.uint32),
            start[part].astype(np.uint32),
            b"\n".join(chosen),
        )
    yield block_rows(blocks, partitions)


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of the buffer, without a loop over words; bounded memory."""
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + HASHED_BYTES)))
        low, high = int(starts[first]), int(ends[last - 1]) + 1
        sizes = lengths[first:last]
        inside = np.arange(high - low) - np.repeat(starts[first:last] - low, sizes + 1)
        # the separator behind a word counts as nothing
        terms = (buffer[low:high].astype(np.uint64) + np.uint64(1)) * powers[inside]
        terms[ends[first:last] - low] = 0
        hashes[first:last] = np.add.reduceat(terms, starts[first:last] - low)
        first = last
    return mixed(hashes + lengths.astype(np.uint64))


def _judge(blocks: list[list], size: int):
    """Cuts of one bucket: windows that start in a document with a smaller id as well."""
    known: dict[bytes, int] = {}
    keys, digests, text_of, start = [], [], [], []
    for ids, checks, texts_at, local, starts, raw in blocks:
        names = raw.split(b"\n")
        numbers = np.fromiter((known.setdefault(n, len(known)) for n in names), np.int64, len(names))
        keys.append(ids[local])
        digests.append(checks[local])
        text_of.append(numbers[texts_at])
        start.append(starts.astype(np.int64))
    blocks.clear()
    keys, digests, text_of, start = map(np.concatenate, (keys, digests, text_of, start))
    owner = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(owner, text_of, keys)

    data = b"\n".join(known) + b"\n"
    buffer = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((buffer == 32) | (buffer == 10))
    begins = np.concatenate(([0], ends[:-1] + 1))
    text_number = np.cumsum(buffer[ends] == 10)
    text_number = np.concatenate(([0], text_number[:-1]))
    n_words = np.bincount(text_number, minlength=len(known))
    text_first = np.cumsum(n_words) - n_words
    hashes = _combined(_word_hashes(buffer, begins, ends), size)
    where = np.flatnonzero(text_number[: len(hashes)] == text_number[size - 1 :])
    hashes = hashes[where]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    order, fresh = _exact(order, fresh, where, begins, ends, data, size)
    group_first = np.flatnonzero(fresh)
    least = np.minimum.reduceat(owner[text_number[where[order]]], group_first)
    smallest = np.empty(len(order), dtype=np.int64)
    smallest[order] = np.repeat(least, np.diff(np.append(group_first, len(order))))

    # windows of a text are neighbours in ``where``: expand the entries over them
    n_windows = n_words - size + 1
    window_first = np.cumsum(n_windows) - n_windows
    wide = n_windows[text_of]
    entry = np.repeat(np.arange(len(text_of)), wide)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(wide) - wide, wide)
    lost = smallest[window_first[text_of[entry]] + step] < keys[entry]
    entry, step = entry[lost], step[lost]
    if len(entry):
        new = np.ones(len(entry), dtype=bool)
        new[1:] = (entry[1:] != entry[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(entry)))
        at = entry[first]
        yield keys[at], digests[at], start[at] + step[first], count


def _exact(order, fresh, where, begins, ends, data, size):
    """Split runs of equal hashes whose words differ, so that groups are equal windows exactly."""
    follows = np.flatnonzero(~fresh)
    if not len(follows):
        return order, fresh
    a, b = where[order[follows - 1]], where[order[follows]]
    bounds = zip(
        begins[a].tolist(), ends[a + size - 1].tolist(), begins[b].tolist(), ends[b + size - 1].tolist()
    )
    differs = np.fromiter((data[p:q] != data[r:s] for p, q, r, s in bounds), bool, len(follows))
    if not differs.any():
        return order, fresh
    order, fresh = order.copy(), fresh.copy()
    firsts = np.flatnonzero(fresh)
    for k in np.unique(np.searchsorted(firsts, follows[differs], side="right") - 1).tolist():
        low = int(firsts[k])
        high = int(firsts[k + 1]) if k + 1 < len(firsts) else len(order)
        run = order[low:high].tolist()
        content = {w: data[begins[where[w]] : ends[where[w] + size - 1]] for w in run}
        run.sort(key=lambda w: (content[w], w))
        order[low:high] = run
        for at in range(low + 1, high):
            fresh[at] = content[run[at - low]] != content[run[at - low - 1]]
    return order, fresh


def repeated_windows(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """Runs of windows that start in a document with a smaller id, per row (packed)."""
    partitions = bucket_count(documents.sparkSession)
    exchanged = _exchange(documents, partitions, size)
    return resolve_buckets(exchanged, partitions, lambda blocks: _judge(blocks, size))


def dedup_substrings(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document row: words, removed words, digest of the kept words, the kept text."""

    def function(text, cuts):
        words = text.split()
        gone = covered(cuts, len(words), size)
        removed = int(gone.sum())
        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if removed else b" ".join(words)
        return len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")

    return finish(
        documents,
        repeated_windows(documents, size),
        function,
        "n_words long, n_removed long, kept_sha256 string, kept_text string",
    )
