"""Suffix-array dedup of repeated 200-byte strings.

Superstrings of windows that share a minimiser meet in one bucket. Most minimisers are met in one
superstring only and hold no repeat. The others are laid out in shards of bounded size, whole groups
together; each shard has its suffix array (Larsson-Sadakane), Kasai's common prefixes give runs of
suffixes that agree in 200 bytes, and every run with two window starts is a repeat. Strings of one
minimiser that do not fit one shard fill several, and these are merged by binary search: the windows
of each are looked up in the suffix arrays of the others.

Equal superstrings of one chunk are repeats at once: all are cut where they stand and one goes on as
a witness, so a passage in a third of all documents reaches its bucket once per chunk.

Nulls and empty texts have no bytes. All rows take part, also those with equal or null doc_ids: a row
that is repeated repeats its strings. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ledgerline.llm.blocks import bucket_count, dealt, mixed, pack
from ledgerline.llm.common import map_batches, texts
from ledgerline.llm.suffix_arrays import Shard
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

WINDOW = 200
GRAM = 16
SHARD_BYTES = 1 << 21


def _gram_ranks(data: bytes) -> np.ndarray:
    """Mixed hashes of all 16-byte grams."""
    count = len(data) - GRAM + 1
    low = np.ndarray((count,), "<u8", data, 0, (1,))
    high = np.ndarray((count,), "<u8", data, 8, (1,))
    return mixed(low * np.uint64(0x9E3779B97F4A7C15) + mixed(high))


def _exchange(documents: DataFrame, partitions: int, size: int) -> DataFrame:
    buckets = partitions * ROUNDS

    def function(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        rows = list(texts(batch))
        digests = np.fromiter(map(text_digest, rows), np.int64, len(rows))
        coded = [text.encode("utf-8", "surrogatepass") for text in rows]
        for group in chunks_of([len(c) for c in coded], size):
            yield from _chunk(group, coded, keys, digests, partitions, buckets, size)

    return map_batches(sources(documents), function, EXCHANGE)


def _chunk(group, coded, keys, digests, partitions, buckets, size):
    whole = b"".join(coded[row][start:end] for row, start, end in group)
    if len(whole) < size:
        return
    grams = _gram_ranks(whole)
    first, count, place = segments(grams, window_mask(group, size, len(whole)), size - GRAM + 1)
    if not len(first):
        return
    strings = [
        whole[a:b] for a, b in zip(first.tolist(), (first + count + size - 1).tolist())
    ]
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
    sizes = np.fromiter((end - start for _, start, end in group), np.int64, len(group))
    chunk_first = np.cumsum(sizes) - sizes
    member = np.searchsorted(chunk_first, first, side="right") - 1
    row = np.fromiter((r for r, _, _ in group), np.int64, len(group))[member]
    start = first - chunk_first[member] + np.fromiter((s for _, s, _ in group), np.int64, len(group))[member]

    times = np.bincount(which, minlength=len(known))
    repeated = times[which] > 1
    if repeated.any():
        yield {
            "partition": [int(keys[0] % partitions)],
            "bucket": [-1 - int(keys[0] % buckets)],
            "block": [
                cut_block(keys[row][repeated], digests[row][repeated], start[repeated], count[repeated])
            ],
        }
    _, sends = np.unique(which, return_index=True)
    bucket = dealt(grams[place[sends]], buckets)
    order = np.argsort(bucket, kind="stable")
    sends, bucket = sends[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    blocks = {}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = sends[a:b]
        present, local = np.unique(row[part], return_inverse=True)
        blocks[int(bucket[a])] = pack(
            keys[present].astype(np.int64),
            digests[present],
            local.astype(np.uint32),
            start[part].astype(np.uint32),
            (place[part] - first[part]).astype(np.uint16),
            repeated[part].astype(np.uint8),
            (count[part] + size - 1).astype(np.uint16),
            b"".join([strings[k] for k in part.tolist()]),
        )
    yield block_rows(blocks, partitions)


def _judge(blocks: list[list], size: int, shard_bytes: int):
    """Cuts of one bucket: windows that occur twice or more, witnesses of chunks included."""
    known: dict[bytes, int] = {}
    keys, digests, text_of, start, again, offset = [], [], [], [], [], []
    for ids, checks, local, starts, places, repeated, lengths, raw in blocks:
        ends = np.cumsum(lengths.astype(np.int64)).tolist()
        names = [raw[a:b] for a, b in zip([0, *ends], ends)]
        text_of.append(np.fromiter((known.setdefault(n, len(known)) for n in names), np.int64, len(names)))
        keys.append(ids[local])
        digests.append(checks[local].astype(np.int64))
        start.append(starts.astype(np.int64))
        offset.append(places.astype(np.int64))
        again.append(repeated.astype(bool))
    blocks.clear()
    keys, digests, text_of, start, offset, again = map(
        np.concatenate, (keys, digests, text_of, start, offset, again)
    )
    names = list(known)
    n_windows = np.fromiter(map(len, names), np.int64, len(names)) - size + 1
    times = np.bincount(text_of, minlength=len(names))
    np.add.at(times, text_of[again], 1)
    window_first = np.cumsum(n_windows) - n_windows
    lost = np.repeat(times > 1, n_windows)

    grams: dict[bytes, list[int]] = {}
    at = np.zeros(len(names), dtype=np.int64)
    at[text_of] = offset
    for number, place in enumerate(at.tolist()):
        grams.setdefault(names[number][place : place + GRAM], []).append(number)
    group: list[int] = []
    held = 0
    for members in grams.values():
        if len(members) == 1:
            continue
        total = sum(len(names[k]) for k in members)
        if total > shard_bytes:
            _across(members, names, window_first, n_windows, lost, size, shard_bytes)
            continue
        if held + total > shard_bytes and group:
            _within(group, names, window_first, n_windows, lost, size)
            group, held = [], 0
        group += members
        held += total
    if group:
        _within(group, names, window_first, n_windows, lost, size)

    wide = n_windows[text_of]
    entry = np.repeat(np.arange(len(text_of)), wide)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(wide) - wide, wide)
    gone = lost[window_first[text_of[entry]] + step] & ~again[entry]
    entry, step = entry[gone], step[gone]
    if len(entry):
        new = np.ones(len(entry), dtype=bool)
        new[1:] = (entry[1:] != entry[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(new)
        at = entry[first]
        yield keys[at], digests[at], start[at] + step[first], np.diff(np.append(first, len(entry)))


def _window_starts(shard: Shard, members: np.ndarray, window_first, n_windows):
    """Places in the shard's text where windows begin, and their numbers in the bucket."""
    wide = n_windows[members]
    step = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    return np.repeat(shard.starts, wide) + step, np.repeat(window_first[members], wide) + step


def _within(group, names, window_first, n_windows, lost, size):
    shard = Shard([names[k] for k in group], size)
    members = np.array(group)
    places, windows = _window_starts(shard, members, window_first, n_windows)
    run = shard.groups()[places]
    lost[windows[np.bincount(run)[run] > 1]] = True


def _across(members, names, window_first, n_windows, lost, size, shard_bytes):
    """One minimiser's strings in several shards: runs in each, binary search between them."""
    parts, held, part = [], 0, []
    for number in members:
        if part and held + len(names[number]) > shard_bytes:
            parts.append(np.array(part))
            part, held = [], 0
        part.append(number)
        held += len(names[number])
    parts.append(np.array(part))
    for k, own in enumerate(parts):
        _within(own.tolist(), names, window_first, n_windows, lost, size)
        shard = Shard([names[x] for x in own.tolist()], size)
        places, windows = _window_starts(shard, own, window_first, n_windows)
        run_of = shard.groups()
        for further in parts[k + 1 :]:
            other = Shard([names[x] for x in further.tolist()], size)
            there, numbers = _window_starts(other, further, window_first, n_windows)
            found = shard.find(other, there)
            met = found >= 0
            lost[numbers[met]] = True
            lost[windows[np.isin(run_of[places], run_of[found[met]])]] = True


def repeated_strings(
    documents: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Runs of starts of strings that also start elsewhere, per row (packed)."""
    partitions = bucket_count(documents.sparkSession)
    exchanged = _exchange(documents, partitions, size)
    return resolve_buckets(exchanged, partitions, lambda blocks: _judge(blocks, size, shard_bytes))


def dedup_suffixes(documents: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document row: bytes, removed bytes and runs, digest of what is kept, the kept bytes."""

    def function(text, cuts):
        raw = np.frombuffer(text, np.uint8)
        gone = covered(cuts, len(raw), size)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = raw[~gone].tobytes()
        return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept

    return finish(
        documents,
        repeated_strings(documents, size, shard_bytes),
        function,
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary",
    )
