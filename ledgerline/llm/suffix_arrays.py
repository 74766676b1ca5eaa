"""Suffix arrays of byte strings in numpy: prefix doubling, common prefixes, search across shards.

A shard is a list of strings, each ended by a mark of its own that is smaller than any byte, so no
match reaches from one string into the next.
"""

from __future__ import annotations

import numpy as np

#: Symbols in the first sort key; nine bits each.
_FIRST = 7


class Shard:
    """Suffix array of some strings and the common prefixes of its neighbours, cut off at ``depth``."""

    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(lengths) - lengths
        self.stop = np.repeat(self.starts + lengths, lengths)
        self.longest = int(lengths.max(initial=0))
        self.order, self.rank = self._refined()
        self.common = self._kasai()

    def _refined(self) -> tuple[np.ndarray, np.ndarray]:
        """Larsson-Sadakane: sort by the first symbols, then double the depth of unsorted groups.

        A suffix carries the number of its group; only groups of two or more are sorted again, by
        the group of the suffix ``depth`` further on.
        """
        size = len(self.data)
        place = np.arange(size, dtype=np.int64)
        left = self.stop - place
        padded = np.concatenate((self.data.astype(np.int64) + 1, np.zeros(_FIRST, np.int64)))
        key = np.zeros(size, dtype=np.int64)
        for k in range(_FIRST):
            key = (key << 9) | np.where(left > k, padded[k : size + k], 0)
        order = np.argsort(key, kind="stable")
        fresh = np.ones(size, dtype=bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(size, dtype=np.int64)
        heads = np.flatnonzero(fresh)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, size)))
        reach = _FIRST
        while reach < self.longest:
            single = fresh & np.append(fresh[1:], True)
            places = np.flatnonzero(~single)  # places in the array that are not settled
            if not len(places):
                break
            members = order[places]
            ahead = members + reach
            inside = ahead < self.stop[members]
            second = np.where(inside, rank[np.minimum(ahead, size - 1)] + 1, 0)
            again = np.argsort(rank[members] * np.int64(size + 1) + second, kind="stable")
            members, second = members[again], second[again]
            group = rank[members]
            order[places] = members
            split = np.ones(len(members), dtype=bool)
            split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
            fresh[places] = split
            heads = np.flatnonzero(split)
            rank[members] = np.repeat(places[heads], np.diff(np.append(heads, len(members))))
            reach *= 2
        # suffixes that are equal to their ends stay in the order of their strings
        final = np.empty(size, dtype=np.int64)
        final[order] = place
        return order, final

    def _kasai(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it in the array, at most ``depth``.

        Kasai's walk in text order, in many lanes at a time: a lane starts from nothing and then
        loses at most one symbol a step, so its comparisons stay linear in its length.
        """
        size = len(self.data)
        common = np.zeros(size, dtype=np.int64)
        if size < 2:
            return common
        before = np.full(size, -1, dtype=np.int64)
        before[self.order[1:]] = self.order[:-1]
        most = np.minimum(self.stop - np.arange(size), self.stop[before] - before)
        most = np.where(before < 0, 0, np.minimum(most, self.depth))
        # eight symbols from every place on, as one number
        eight = np.ndarray((size,), "<u8", np.append(self.data, np.zeros(8, np.uint8)).tobytes(), 0, (1,))
        lane = 2 * self.depth
        first = np.arange(0, size, lane)
        height = np.zeros(len(first), dtype=np.int64)
        for step in range(lane):
            here = first + step
            if here[-1] >= size:
                here, height, first = here[:-1], height[:-1], first[:-1]
                if not len(here):
                    break
            other, limit = before[here], most[here]
            height = np.minimum(height, limit)
            open_ = np.flatnonzero(height < limit)
            while len(open_):
                at = height[open_]
                odd = eight[here[open_] + at] ^ eight[other[open_] + at]
                same = np.bitwise_count((odd & -odd) - np.uint64(1)) >> 3  # equal symbols in front
                height[open_] = np.minimum(at + same, limit[open_])
                open_ = open_[(same == 8) & (height[open_] < limit[open_])]
            common[self.rank[here]] = height
            height = np.maximum(height - 1, 0)
        return common

    def groups(self) -> np.ndarray:
        """Per suffix in text order: the number of its run of neighbours that share ``depth`` symbols."""
        run = np.cumsum(self.common < self.depth)
        return run[self.rank]

    def find(self, other: Shard, places: np.ndarray) -> np.ndarray:
        """For suffixes of ``other``: a place of this text with the same ``depth`` symbols, or -1.

        Binary search of all of them at once over this suffix array.
        """
        low = np.zeros(len(places), dtype=np.int64)
        high = np.full(len(places), len(self.order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            less = self._below(self.order[middle], other, places[open_])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        found = np.full(len(places), -1, dtype=np.int64)
        hit = np.flatnonzero(low < len(self.order))
        here = self.order[low[hit]]
        equal = self._compared(here, other, places[hit]) == 0
        found[hit[equal]] = here[equal]
        return found

    def _below(self, here, other, there) -> np.ndarray:
        return self._compared(here, other, there) < 0

    def _compared(self, here, other, there) -> np.ndarray:
        """-1, 0 or 1 for suffixes of this and the other text, over ``depth`` symbols."""
        result = np.zeros(len(here), dtype=np.int64)
        open_ = np.arange(len(here))
        for k in range(self.depth):
            a, b = here[open_] + k, there[open_] + k
            left = np.where(a < self.stop[here[open_]], self.data[np.minimum(a, len(self.data) - 1)].astype(np.int64), -1)
            right = np.where(b < other.stop[there[open_]], other.data[np.minimum(b, len(other.data) - 1)].astype(np.int64), -1)
            sign = np.sign(left - right)
            result[open_] = sign
            open_ = open_[(sign == 0) & (left >= 0)]
            if not len(open_):
                break
        return result
