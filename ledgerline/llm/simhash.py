"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code on 61 of the 64 fingerprint bits: two binary Golay codes of
length 23 (covering radius 3) and a Hamming code of length 15 (radius 1); the other three bits are
free. These codes are perfect, so every point has exactly one anchor within the covering radius. Two
linked fingerprints have a point half way between them, at most ``threshold / 2`` bits from either;
the anchor that covers this point receives both, if each fingerprint is copied to all anchors within
covering radius plus half the threshold. That is all of the ball of radius plus threshold that a link
can need, about 17 anchors for two bits.

Exact copies collapse to one fingerprint before anything is copied. An anchor compares its distinct
fingerprints only with each other and reports a spanning tree of its links, never all pairs: few are
compared pairwise with numpy, many by looking up all fingerprints within the threshold. Trees are
joined to components over all anchors.

Nulls and empty texts have fingerprint zero. Null doc_ids link like any other and form a component
whose id is the smallest id in it, or null. Repeated rows have equal results; an empty table gives no
rows.

``one_of_each_group`` has settings of its own: texts are linked if the sets of their five-word shingles
have a Jaccard similarity of 0.8 or more (``near_texts``). Fingerprints of such texts are up to about 15
bits apart, where anchors would need thousands of copies, so candidates also come from bands of minimum
hashes. Each is checked on the whole shingle sets. In a first round a band of at most ``FULL`` texts
proposes all its pairs; in a larger one each text meets ``CENTRES`` texts, those that share bands with
the most others. That connects most groups; a second round compares, in every larger band, the texts
that are not connected yet, so that no pair that shares a band is left out.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.blocks import bucket_count
from ledgerline.llm.common import NULL_ID, doc_key, map_arrow, map_batches, slices, stored, texts
from ledgerline.llm.components import components
from ledgerline.llm.near_texts import (  # noqa: F401  similarity: for callers of this module
    GROUP_SHINGLE,
    LOWER,
    SEED,
    dense_links,
    minima_of,
    packed_texts,
    shingles_of,
    similar_texts,
    similarity,
    text_digest,
)

SHINGLE = 3
THRESHOLD = 2
#: Fingerprints of an anchor up to which all pairs are compared at once.
PAIRWISE = 2048

#: Texts of a band up to which all pairs are candidates of the first round.
FULL = 64
#: Texts of a larger band that all its texts are compared with in the first round.
CENTRES = 4

#: (bits, generator polynomial, covering radius): Golay, Golay, Hamming; fixed values.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))
COVERED_BITS = sum(bits for bits, _, _ in CODES)


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, dtype=np.int64)
    count = len(words) - shingle + 1
    for start in range(0, count, 1 << 16):  # bounded memory for very long texts
        part = words[start : min(start + (1 << 16), count) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle)))
        hashes = np.fromiter(
            (xxh64_intdigest(s, SEED) for s in map(b" ".join, parts)), "<u8", len(part) - shingle + 1
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > count).tolist())


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_key, digest, fp): one row per document row; the digest tells texts of one id apart."""

    def function(batch):
        values = [fingerprint_of(text, shingle) for text in texts(batch)]
        yield {
            "doc_key": batch.column(0),
            "digest": batch.column(2),
            "fp": np.array(values, dtype=np.uint64).view(np.int64),
        }

    source = documents.select(doc_key().alias("doc_key"), "text", text_digest().alias("digest"))
    return map_batches(source, function, "doc_key long, digest long, fp long")


def _patterns(bits: int, weight: int) -> np.ndarray:
    """All words of at most ``weight`` ones."""
    found = [0]
    for ones in range(1, weight + 1):
        found += [sum(1 << k for k in chosen) for chosen in combinations(range(bits), ones)]
    return np.array(found, dtype=np.int64)


def _syndromes(values: np.ndarray, bits: int, generator: int) -> np.ndarray:
    """Remainders of polynomial division by the generator."""
    degree = generator.bit_length() - 1
    rest = values.copy()
    for bit in range(bits - 1, degree - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (generator << (bit - degree)), rest)
    return rest


@lru_cache
def _coset(bits: int, generator: int, weight: int) -> list[np.ndarray]:
    """Per syndrome: the words of at most ``weight`` ones that lead to a code word."""
    patterns = _patterns(bits, weight)
    syndromes = _syndromes(patterns, bits, generator)
    degree = generator.bit_length() - 1
    return [patterns[syndromes == s] for s in range(1 << degree)]


def anchors_of(fps: np.ndarray, threshold: int = THRESHOLD) -> list[list[int]]:
    """Per fingerprint: anchors within covering radius plus half the threshold, rounded up."""
    extra = -(-threshold // 2)
    found: list[list[tuple[int, int]]] = [[(0, 0)]] * len(fps)  # (anchor so far, extra bits spent)
    shift = 0
    for bits, generator, radius in CODES:
        cosets = [
            [(error << shift, max(0, error.bit_count() - radius)) for error in coset.tolist()]
            for coset in _coset(bits, generator, radius + extra)
        ]
        values = (fps >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
        syndromes = _syndromes(values, bits, generator).tolist()
        parts = (values << shift).tolist()
        found = [
            [(a | part ^ e, s + t) for a, s in sums for e, t in cosets[syndrome] if s + t <= extra]
            for sums, part, syndrome in zip(found, parts, syndromes)
        ]
        shift += bits
    return [[a for a, _ in sums] for sums in found]


def _replicas(classes: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp) for every anchor that may have to compare the fingerprint."""

    def function(batch):
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for part in slices(len(fps), 1000):
            found = anchors_of(fps[part].view(np.uint64), threshold)
            yield {
                "anchor": np.array([a for anchors in found for a in anchors], dtype=np.int64),
                "fp": np.repeat(fps[part], [len(anchors) for anchors in found]),
            }

    return map_batches(classes.select("fp"), function, "anchor long, fp long")


@lru_cache
def _differences(threshold: int) -> np.ndarray:
    flips = [
        sum(1 << k for k in chosen)
        for ones in range(1, threshold + 1)
        for chosen in combinations(range(64), ones)
    ]
    return np.array(flips, dtype=np.uint64)


def links_of(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as index pairs (child, root)."""
    size = len(fps)
    root = np.arange(size)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)

    if size <= PAIRWISE:
        step = max(1, (1 << 20) // size)
        for start in range(0, size, step):
            near = np.bitwise_count(fps[start : start + step, None] ^ fps[None, :]) <= threshold
            left, right = np.nonzero(near)
            later = right > left + start
            join(left[later] + start, right[later])
    else:
        order = np.argsort(fps)
        ordered = fps[order]
        for flip in _differences(threshold):
            wanted = ordered ^ flip
            at = np.minimum(np.searchsorted(ordered, wanted), size - 1)
            met = np.flatnonzero((ordered[at] == wanted) & (wanted > ordered))
            join(order[met], order[at[met]])
    roots = np.array([find(k) for k in range(size)], dtype=np.int64)
    child = np.flatnonzero(roots != np.arange(size))
    return child, roots[child]


def link_edges(replicas: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) between fingerprints, found anchor by anchor."""
    parts = bucket_count(replicas.sparkSession)
    dealt = replicas.repartition(parts, "anchor").sortWithinPartitions("anchor", "fp")

    def flush(anchor, fps):
        """Links inside runs of equal anchors of sorted arrays."""
        starts = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
        sizes = np.diff(np.append(starts, len(anchor)))
        pairs = starts[sizes == 2]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= threshold]
        left, right = [fps[pairs]], [fps[pairs + 1]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            child, root = links_of(fps[start : start + size], threshold)
            left.append(fps[start + child])
            right.append(fps[start + root])
        return [np.concatenate(side).view(np.int64) for side in (left, right)]

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def out():
            columns = flush(*map(np.concatenate, zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fps = fps.view(np.uint64)
            if held and held[-1][0][-1] != anchor[0]:
                yield out()
            # the last anchor's run may go on in the next batch
            last = int(np.searchsorted(anchor, anchor[-1], side="left"))
            if last:
                held.append((anchor[:last], fps[:last]))
                yield out()
            held.append((anchor[last:], fps[last:]))
        if held:
            yield out()

    return map_arrow(dealt, run, "a long, b long")


def _components(
    documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """(doc_key, digest, fp, root, component) per row: root is a fingerprint, component the smallest id."""
    marked = stored(fingerprints(documents, shingle))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_key").alias("rep")))
    labels = components(link_edges(_replicas(classes, threshold), threshold))
    rooted = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "root", "component")
    return marked.join(named, "fp")


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """Per document row: fingerprint and component, named by the smallest doc_id in it."""
    return _components(documents, shingle, threshold).select(
        F.when(F.col("doc_key") != NULL_ID, F.col("doc_key")).alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"),
    )


def _marks(documents: DataFrame) -> DataFrame:
    """(doc_key, digest, fp, size, bands, minima) per row; size is the number of distinct shingles."""

    def function(batch):
        fps, sizes, bands, minima = [], [], [], []
        for text in texts(batch):
            shingles = shingles_of(text.encode("utf-8", "surrogatepass"))
            fps.append(fingerprint_of(text, GROUP_SHINGLE))
            sizes.append(len(shingles))
            for kept, value in zip((bands, minima), minima_of(shingles)):
                kept.append(value)
        yield {
            "doc_key": batch.column(0),
            "digest": batch.column(2),
            "fp": np.array(fps, dtype=np.uint64).view(np.int64),
            "size": sizes,
            "bands": bands,
            "minima": minima,
        }

    source = documents.select(doc_key().alias("doc_key"), "text", text_digest().alias("digest"))
    schema = "doc_key long, digest long, fp long, size long, bands array<long>, minima binary"
    return map_batches(source, function, schema)


def _members(classes: DataFrame) -> DataFrame:
    """(place, band, digest, size, n): the texts of every band that n > 1 texts share."""
    listed = classes.select("digest", "size", F.posexplode("bands").alias("place", "band"))
    sizes = listed.groupBy("band").agg(F.count("*").alias("n"))
    return stored(listed.join(sizes.where("n > 1"), "band"))


def _candidates(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests, a < b, of the first round: near fingerprints and shared bands."""
    heads = stored(classes.groupBy("fp").agg(F.min("digest").alias("head")))
    links = link_edges(_replicas(heads, THRESHOLD))
    near = (
        links.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("left")), "a")
        .join(heads.select(F.col("fp").alias("b"), F.col("head").alias("right")), "b")
        .select("left", "right")
    )
    equal = classes.join(heads, "fp").select("digest", "head")

    large, small = members.where(F.col("n") > FULL), members.where(F.col("n") <= FULL)
    # how many texts share bands with each text; the greatest of every residue class is a centre
    weights = members.groupBy("digest").agg(F.sum("n").alias("weight"))
    centres = (
        large.join(weights, "digest")
        .groupBy("band", F.pmod("digest", F.lit(CENTRES)).alias("class"))
        .agg(F.max(F.struct("weight", "digest")).alias("top"))
        .select("band", F.col("top.digest").alias("centre"))
    )
    central = large.join(centres, "band").select("digest", "centre")
    pairs = small.select("band", "digest").join(
        small.select("band", F.col("digest").alias("other")), "band"
    )
    found = near.union(equal).union(central)
    found = found.union(pairs.select("digest", "other")).toDF("x", "y").where("x <> y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _second_round(members: DataFrame, marked: DataFrame, packed: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, root) after the links between components that meet in a large band."""
    rooted = members.where(F.col("n") > FULL).join(
        labels.withColumnRenamed("node", "digest"), "digest", "left"
    )
    rooted = stored(
        rooted.select("place", "band", "digest", F.coalesce("root", "digest").alias("root"), "size")
    )
    open_bands = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    open_bands = stored(open_bands.where("x <> y").select("band"))
    if open_bands.isEmpty():  # every large band lies in one component
        return labels
    inside = stored(rooted.join(open_bands, "band", "left_semi"))
    needed = inside.select("digest").distinct()
    marks = marked.select("digest", "bands", "minima").join(needed, "digest", "left_semi")
    found = stored(dense_links(inside, marks.dropDuplicates(["digest"]), packed))
    return components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of similar texts, all columns kept.

    Groups are the components of the links between texts. Of several rows with that doc_id, one stays.
    The texts are shuffled once, for the join that finds the rows; equal rows are then next to each other.
    """
    marked = stored(_marks(documents))
    first = [F.first(c).alias(c) for c in ("fp", "size", "bands")]
    classes = stored(marked.groupBy("digest").agg(*first))
    members = _members(classes)
    candidates = stored(_candidates(classes, members))
    packed = packed_texts(documents, candidates)
    labels = components(similar_texts(packed, candidates))
    labels = _second_round(members, marked, packed, labels)
    named = marked.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select(
        "doc_key", "digest", F.coalesce("root", "digest").alias("root")
    )
    heads = named.groupBy("root").agg(F.min(F.struct("doc_key", "digest")).alias("head"))
    heads = heads.select(F.col("head.doc_key").alias("_key"), F.col("head.digest").alias("_digest"))
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    rows = documents.select(whole, doc_key().alias("_row_key"), text_digest().alias("_row_digest"))
    found = rows.join(
        heads,
        (F.col("_row_key") == F.col("_key")) & (F.col("_row_digest") == F.col("_digest")),
        "left_semi",
    )
    return found.dropDuplicates(["_row_key", "_row_digest"]).select("_row.*")
