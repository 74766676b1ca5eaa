"""Texts as sets of word shingles: bands of minimum hashes, exact similarity, and links in large bands.

Two texts are similar if the Jaccard similarity of their distinct ``GROUP_SHINGLE``-word shingles is
``SIMILAR`` or more. A band joins ``BAND_ROWS`` minimum hashes; a pair just at the limit shares one of the
``BANDS`` bands with probability 0.999.

``dense_links`` finds the links between texts of a band that no earlier link connects, however many texts
share the band. Similar texts differ in their number of shingles by a factor of at most 1 / ``SIMILAR``,
so texts are split into length classes whose bounds lie further apart than that, and classes into blocks
by a hash of the text. Every two blocks of one class or of neighbours form a cell, one bounded task:

1. on one byte of each minimum hash a cell names the texts that have a possible partner in another
   component (``NEEDED`` equal bytes; a similar pair has fewer with a probability below 0.0001), counting
   a pair only in the first band that it shares;
2. the named texts travel to the cell, and pairs of different components are compared on whole sets.

Texts of one component are never compared, so a group of thousands of copies costs nothing here. Many
texts that are all different and all nearly similar are compared pair by pair: quadratic in time, not in
memory, and no pairs are written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.blocks import LEVEL, mixed
from ledgerline.llm.common import apply_arrow, map_batches, slices, stored, texts

SEED = 42
#: Words of a shingle, least Jaccard similarity, bands and their minimum hashes.
GROUP_SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_ROWS = 24, 6
#: Equal bytes of minimum hashes, of BANDS * BAND_ROWS, from which a pair is compared on whole sets.
NEEDED = 94
#: Texts and shingles that a block holds on average at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Ratio of the bounds of a length class, above 1 / SIMILAR.
LENGTH_RATIO = 1.26

_FACTORS = mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_digest():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingles_of(raw: bytes, shingle: int = GROUP_SHINGLE) -> set[bytes]:
    """The distinct word shingles of a text; all words of a shorter one, nothing of one without words."""
    words = raw.translate(LOWER).split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))


def similarity(left: set[bytes], right: set[bytes]) -> float:
    """Jaccard similarity; two texts without words are equal."""
    return len(left & right) / len(left | right) if left or right else 1.0


def _hashes(shingles: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def minima_of(shingles: set[bytes]) -> tuple[np.ndarray, bytes]:
    """One number per band, its minimum hashes combined; and one byte of every minimum hash."""
    hashes = mixed(_hashes(shingles))
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for part in slices(len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[part, None] * _FACTORS).min(axis=0))
    spread = mixed(least)
    band = np.arange(BANDS, dtype=np.uint64)
    rows = (spread.reshape(BANDS, BAND_ROWS) * _FACTORS[:BAND_ROWS]).sum(axis=1, dtype=np.uint64)
    return mixed(rows + band).view(np.int64), (spread & np.uint64(255)).astype(np.uint8).tobytes()


def packed_texts(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(digest, packed): every text that a candidate pair names, once."""

    def packed(batch):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        raw = [packer.compress(text.encode("utf-8", "surrogatepass")) for text in texts(batch)]
        yield {"digest": batch.column(0), "packed": raw}

    nodes = candidates.select(F.col("a").alias("digest")).union(candidates.select("b")).distinct()
    source = documents.select(text_digest().alias("digest"), "text")
    needed = map_batches(source, packed, "digest long, packed binary").join(nodes, "digest", "left_semi")
    return stored(needed.groupBy("digest").agg(F.first("packed").alias("packed")))


def similar_texts(packed: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (a, b) whose texts are similar, on the whole sets of shingles."""

    def check(batch):
        keep = []
        for left, right in zip(batch.column(2), batch.column(3)):
            sets = [shingles_of(zstandard.decompress(side.as_py())) for side in (left, right)]
            keep.append(similarity(*sets) >= SIMILAR)
        chosen = np.array(keep, dtype=bool)
        yield {
            name: batch.column(k).to_numpy(zero_copy_only=False)[chosen] for k, name in enumerate("ab")
        }

    both = candidates.join(packed.toDF("a", "left"), "a").join(packed.toDF("b", "right"), "b")
    return map_batches(both.select("a", "b", "left", "right"), check, "a long, b long")


def _cells(members: DataFrame) -> DataFrame:
    """``members`` (place, band, digest, root, size) once for each cell: with its number and the block."""
    length = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(LENGTH_RATIO))
    classed = members.withColumn("class", length.cast("int"))
    full = F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("size") / BLOCK_SHINGLES)
    classes = classed.groupBy("band", "class").agg(F.ceil(full).cast("int").alias("blocks"))
    by_class = Window.partitionBy("band").orderBy("class")  # as many rows as classes

    def neighbour(pick, step):
        there = pick("class").over(by_class) == F.col("class") + step
        return F.when(there, pick("blocks").over(by_class)).otherwise(0)

    classes = classes.select(
        "*", neighbour(F.lead, 1).alias("after"), neighbour(F.lag, -1).alias("before")
    )
    placed = classed.join(classes, ["band", "class"]).withColumn(
        "block", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("blocks")).cast("int")
    )

    def among(count, cell):
        numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1))
        return F.transform(F.coalesce(numbers, F.array().cast("array<int>")), cell)

    def number(left, right):
        return F.xxhash64("band", *left, *right)

    here, block = F.col("class"), F.col("block")
    cells = F.concat(
        among("blocks", lambda k: number((here, F.least(block, k)), (here, F.greatest(block, k)))),
        among("after", lambda k: number((here, block), (here + 1, k))),
        among("before", lambda k: number((here - 1, k), (here, block))),
    )
    return placed.select(
        F.explode(cells).alias("cell"), F.xxhash64("class", "block").alias("tag"), *members.columns
    )


def _partners(tag: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows outside the most frequent component, and whether all rows lie in one block."""
    _, place, sizes = np.unique(root, return_inverse=True, return_counts=True)
    return np.flatnonzero(place != sizes.argmax()), bool((tag == tag[0]).all())


def possible_partners(tag, root, place, bands, minima) -> np.ndarray:
    """Whether each row of a cell may be similar to a row of another component and block."""
    named = np.zeros(len(tag), dtype=bool)
    rows, single = _partners(tag, root)
    for part in slices(len(rows), 128):
        own = rows[part]
        open_ = root[own, None] != root[None, :]
        if not single:
            open_ &= tag[own, None] != tag[None, :]
        equal = np.zeros(open_.shape, dtype=np.uint8)
        for column in minima.T:
            equal += column[own, None] == column[None, :]
        left, right = np.nonzero(open_ & (equal >= NEEDED))
        earlier = np.zeros(len(left), dtype=bool)
        for piece in slices(len(left), 1 << 15):
            met = bands[own[left[piece]]] == bands[right[piece]]
            earlier[piece] = (met & (np.arange(BANDS) < place)).any(axis=1)
        named[own[left[~earlier]]] = True
        named[right[~earlier]] = True
    return named


def cell_links(tag, root, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between components in a cell, on sorted distinct hashes."""
    links: list[tuple[int, int]] = []
    rows, single = _partners(tag, root)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    empty = np.flatnonzero(sizes == 0)
    every, terms = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(terms, minlength=len(every))[terms] > 1
    terms, owner = terms[shared], owner[shared]
    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    root = root.copy()
    marked = np.zeros(len(every), dtype=bool)
    for row in rows.tolist():
        own = terms[starts[row] : starts[row + 1]]
        marked[own] = True
        common = np.bincount(owner[marked[terms]], minlength=len(sets))
        marked[own] = False
        union = sizes[row] + sizes - common
        near = common / np.maximum(union, 1) >= SIMILAR
        if sizes[row] == 0:
            near[empty] = True
        if not single:
            near &= tag != tag[row]
        for other in np.flatnonzero(near & (root != root[row])).tolist():
            if root[other] != root[row]:
                links.append((row, other))
                root[root == root[other]] = root[row]
    return links


def dense_links(members: DataFrame, marks: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b): links between different components of ``members`` (place, band, digest, root, size).

    ``marks`` holds (digest, bands, minima), ``packed`` (digest, packed) of all members, once each.
    """
    cells = stored(_cells(members))
    mixed_cells = cells.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    cells = cells.join(mixed_cells.where("x <> y").select("cell"), "cell", "left_semi")

    def column(table, name):
        return table.column(name).to_numpy()

    def name_partners(table):
        minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint8)
        bands = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        named = possible_partners(
            column(table, "tag"),
            column(table, "root"),
            column(table, "place")[0],
            bands.reshape(-1, BANDS),
            minima.reshape(-1, BANDS * BAND_ROWS),
        )
        return table.select(["cell", "tag", "digest", "root"]).filter(pa.array(named))

    def link(table):
        digest = column(table, "digest")
        sets = [
            np.unique(_hashes(shingles_of(zstandard.decompress(raw.as_py()))))
            for raw in table.column("packed")
        ]
        found = cell_links(column(table, "tag"), column(table, "root"), sets)
        left, right = (digest[[pair[k] for pair in found]] if found else digest[:0] for k in (0, 1))
        return pa.table({"a": left, "b": right})

    named = stored(
        apply_arrow(
            cells.join(marks, "digest").groupBy("cell"),
            name_partners,
            "cell long, tag long, digest long, root long",
        )
    )
    return apply_arrow(named.join(packed, "digest").groupBy("cell"), link, "a long, b long")
