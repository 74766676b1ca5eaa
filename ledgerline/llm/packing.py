"""Best-fit packing by exact-complement hashing over length counts.

Documents become pieces of at most ``capacity`` tokens. Packing looks only at how many pieces have
each length, at most ``capacity`` counts whatever the corpus: for each length, from the longest, the
gap it leaves is looked up among the sums of one, two and three available lengths, and the
combination is used as often as its counts allow. What finds no exact complement is placed best fit:
each piece goes to the fullest sequence that still takes it. The outcome is a bounded list of
patterns (lengths, and how many sequences look like that).

Pieces then learn their place without meeting each other: the task that makes a piece numbers it among
its own pieces of that length, so a very common length is not one task, and stores it; the stored
counts of the tasks before give its rank, patterns own ranges of ranks, and a range gives sequence and
offset by arithmetic.

Nulls and empty texts are one piece that holds the closing id only. Repeated rows, also of one
doc_id, are packed once each; they are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow, map_batches, stored, texts
from ledgerline.llm.tokens import default_path, id_cache

CAPACITY = 2048
END_ID = 0
#: Counts per task and length up to which they are sent to every task, so that no piece is shuffled.
BROADCAST_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32())]
    + [(name, pa.int64()) for name in ("start", "length", "ids_crc32", "within")]
    + [("block", pa.int32())]
)


def pieces_of(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces per document: number, first token, length, checksum of the ids.

    ``block`` names the task that made a piece, ``within`` counts its earlier pieces of that length: the
    rows must be stored before anything else reads them, since another run may deal them otherwise.
    """

    def function(batches):
        cache = id_cache(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        block, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            ids = batch.column(0)
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "within")}
            for row, text in enumerate(texts(batch)):
                coded = cache.ids_of(text) + end
                for number, start in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[start : start + 4 * capacity]
                    length = len(part) // 4
                    out["doc_id"].append(ids[row].as_py())
                    out["piece"].append(number)
                    out["start"].append(start // 4)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["within"].append(made[length])
                    made[length] += 1
            out["block"] = [block] * len(out["piece"])
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(
        source,
        function,
        "doc_id long, piece int, start long, length long, ids_crc32 long, within long, block int",
    )


class _Plan:
    """Patterns over available counts per length."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.capacity = counts.astype(np.int64), capacity
        self.patterns: list[tuple[Pattern, int]] = []

    def fits(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], times: int) -> Pattern:
        used = {x: lengths.count(x) for x in lengths}
        for x, k in used.items():
            self.counts[x] -= k * times
        return tuple(used.items())

    def pair(self, total: int, first: int = 0) -> tuple[int, int] | None:
        """Two available lengths with the given sum, the longer as long as possible."""
        if total < 2:
            return None
        free = self.counts[: total + 1] > 0
        both = np.flatnonzero(free[1:total] & free[total - 1 : 0 : -1]) + 1
        both = both[both * 2 >= total]
        for a in both[::-1].tolist():
            b = total - a
            if self.fits((first, a, b) if first else (a, b)):
                return a, b
        return None

    def triple(self, total: int, pairs: np.ndarray) -> tuple[int, int, int] | None:
        """Three available lengths with the given sum; ``pairs`` marks sums of two."""
        if total < 3:
            return None
        free = np.flatnonzero(self.counts[:total] > 0)
        free = free[(free * 3 >= total) & (free <= total - 2)]
        free = free[pairs[total - free]]
        for a in free[::-1].tolist():
            found = self.pair(total - a, a)
            if found:
                return (a, *found)
        return None

    def pair_sums(self) -> np.ndarray:
        free = (self.counts > 0).astype(np.float64)
        size = 1 << int(2 * len(free)).bit_length()
        spectrum = np.fft.rfft(free, size)
        return np.fft.irfft(spectrum * spectrum, size)[: self.capacity + 1] > 0.5

    def exact(self) -> None:
        """Use up combinations that fill a sequence exactly, longest lengths first."""
        full = int(self.counts[self.capacity])
        if full:
            self.patterns.append((self.take((self.capacity,), full), full))
        pairs, changed = self.pair_sums(), False
        for long in range(self.capacity - 1, 0, -1):
            while self.counts[long] > 0:
                gap = self.capacity - long
                single = self.counts[gap] > 0 and self.fits((long, gap))
                found: tuple[int, ...] | None = (gap,) if single else None
                if found is None:
                    self.counts[long] -= 1  # set one aside: it may also be part of its complement
                    rest = self.pair(gap)
                    if rest is None:
                        if changed:
                            pairs, changed = self.pair_sums(), False
                        rest = self.triple(gap, pairs)
                    self.counts[long] += 1
                    found = rest
                if found is None:
                    break
                lengths = (long, *found)
                times = self.fits(lengths)
                self.patterns.append((self.take(lengths, times), times))
                changed = changed or any(self.counts[x] == 0 for x in lengths)

    def best_fit(self) -> None:
        """Place what is left, longest first, each in the fullest sequence that takes it."""
        open_by_gap: dict[int, list[tuple[Pattern, int]]] = {}
        gaps = np.zeros(self.capacity + 1, dtype=bool)

        def opened(pattern: Pattern, gap: int, times: int) -> None:
            if gap == 0:
                self.patterns.append((pattern, times))
            else:
                open_by_gap.setdefault(gap, []).append((pattern, times))
                gaps[gap] = True

        for length in np.flatnonzero(self.counts)[::-1].tolist():
            left = int(self.counts[length])
            self.counts[length] = 0
            while left:
                enough = np.flatnonzero(gaps[length:])
                if len(enough):
                    gap = length + int(enough[0])
                    pattern, times = open_by_gap[gap].pop()
                    if not open_by_gap[gap]:
                        gaps[gap] = False
                else:
                    gap, pattern, times = self.capacity, (), -(-left // (self.capacity // length))
                each = min(gap // length, left)
                whole = min(times, left // each)
                if whole < times:
                    if pattern:
                        opened(pattern, gap, times - whole)
                    elif left > whole * each:  # a last new sequence takes the odd rest
                        rest = left - whole * each
                        opened(((length, rest),), self.capacity - rest * length, 1)
                        left -= rest
                opened((*pattern, (length, each)), gap - each * length, whole)
                left -= whole * each
        for held in open_by_gap.values():
            self.patterns += held


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns as ((length, how many), ...) with the number of sequences of that pattern."""
    made = _Plan(counts, capacity)
    made.exact()
    made.best_fit()
    return made.patterns


def slots_of(patterns: list[tuple[Pattern, int]], counts: np.ndarray) -> np.ndarray:
    """Ranges of ranks, all lengths in a row: first rank, pieces a sequence, first sequence, offset."""
    base = np.concatenate(([0], np.cumsum(counts)))[:-1]
    used = np.zeros_like(base)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((base[length] + used[length], each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack_documents(
    documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: where it starts, its checksum, and its place in a sequence."""
    path = tokenizer_path or default_path("word_bpe_49k.json")
    pieces = stored(pieces_of(documents, path, capacity))
    per_block = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows, whatever the corpus
    totals = per_block.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in totals:
        counts[row.length] = row.n
    slots = slots_of(plan(counts, capacity), counts)
    base = np.concatenate(([0], np.cumsum(counts)))[:-1]

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = per_block.select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    if sum(row.blocks for row in totals) <= BROADCAST_ROWS:
        first = F.broadcast(first)
    ranked = pieces.join(first, ["length", "block"])

    def function(batch):
        length, rank = (
            batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5)
        )
        if len(length):
            place = base[length] + rank
            slot = slots[np.searchsorted(slots[:, 0], place, side="right") - 1]
            inside = place - slot[:, 0]
            yield {
                "doc_id": batch.column(0), "piece": batch.column(1), "start": batch.column(2),
                "length": batch.column(3), "ids_crc32": batch.column(4),
                "sequence_id": slot[:, 2] + inside // slot[:, 1],
                "offset": slot[:, 3] + inside % slot[:, 1] * length,
            }

    numbered = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("within")).cast("long").alias("rank"),
    )
    return map_batches(
        numbered,
        function,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
