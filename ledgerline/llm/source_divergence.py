"""How far the sources of a language use its terms differently: hash-consed segment trees.

Terms are runs of letters (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased). A language keeps the
V terms that occur in at least ``LEAST_DOCUMENTS`` of its documents. A group (language, source) with
N occurrences of kept terms, and likewise the language as a whole, gives each kept term the share

    p = 1 + floor(SHARES * (count + 1) / (N + V))

and a group with share p diverges from a share q by f = floor((p - q)^2 / q). All of it is integers.

Tasks count the terms of a batch as arrays, one row per group and term. One shuffle by language and term
brings a term's rows of all groups together: it adds them up, counts documents and drops rare terms.

Term ids are dealt to blocks of about ``BLOCK_TERMS`` by a hash of the term. In a block each group has
a segment tree over the ids; nodes are hash-consed over all groups of the block, so equal subtrees are
one node, and ids are ordered by frequency, so that long runs of zeros and ones are shared. Two groups
are compared by walking both trees at once from their roots: each level keeps the distinct pairs of
nodes with their multiplicity, so an equal pair of nodes is opened once, and an equal pair of leaves
priced once, however often it occurs. A block yields one partial sum per pair of groups, which Spark
adds up. Groups of a language are dealt to tiles of about ``TILE_GROUPS``; a task compares two tiles
in one block, so neither many terms nor many sources meet in one task.

Null text, lang and source are empty strings. Every occurring group appears, also without terms; a
language of one source has no ``pair`` rows, and values are zero where V is zero. Repeated rows are
documents of their own; ids are not read. Ties rank by item. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import apply_arrow, map_batches, stored

LEAST_DOCUMENTS = 3
SHARES = 10**9
TERM_RANKS = 200
BLOCK_TERMS = 4096
TILE_GROUPS = 64
#: Occurrences of terms, as far as bytes tell, that a task counts at once before it sends the counts on.
HELD_TERMS = 8_000_000

#: Letters stay, A-Z lower-cased; other ASCII bytes separate terms.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Counts whose product with SHARES fits into 64 bits.
_FITS = 9 * 10**9
#: The base in which long division makes a share of 10^9: three digits.
_STEP = 1000


def _by_group(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, text) of a batch with documents of one group side by side; nulls are empty."""
    columns = {}
    for name in ("lang", "source", "text"):
        column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
        columns[name] = pc.fill_null(column, "")
    table = pa.table(columns)
    codes = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in (0, 1)]
    return table.take(pa.array(np.lexsort(codes[::-1])))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, and where each text's words begin and end; empty strings may be among them."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    letters = b"" if data is None else data[start:end].to_pybytes().translate(_LETTERS)
    plain = pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, pa.py_buffer(offsets - start), pa.py_buffer(letters)]
    )
    split = pc.ascii_split_whitespace(plain)
    return split.flatten().dictionary_encode(), split.offsets.to_numpy()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs."""
    keys.sort()
    starts = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(starts, append=len(keys))


def _sizes(values: pa.Array) -> list[tuple[str, int]]:
    """The distinct values in their order of first appearance and how often each occurs."""
    return [(row["values"], row["counts"]) for row in values.value_counts().to_pylist()]


def _counted(table: pa.Table) -> Iterator[dict[str, pa.Array]]:
    """Counts of each group's terms over documents that lie by group: a row per group and term."""
    langs, sources, texts = (table.column(k).combine_chunks() for k in range(3))
    first = 0
    for lang, size in _sizes(langs):
        here = sources.slice(first, size)
        words, offsets = _words(texts.slice(first, size))
        first += size
        distinct, codes = words.dictionary, words.indices.to_numpy()
        empty, width = pc.index(distinct, "").as_py(), max(1, len(distinct))
        found, at = [], 0
        for source, documents in _sizes(here):
            own = offsets[at : at + documents + 1]
            at += documents
            inside = codes[own[0] : own[-1]]
            term, n = _runs(inside.copy())
            of = np.repeat(np.arange(documents, dtype=np.int64), np.diff(own))
            each, _ = _runs(of * width + inside)
            _, docs = _runs(each % width)  # the same terms in the same order
            words_only = term != empty
            found.append((source, term[words_only], n[words_only], docs[words_only]))
        names = pa.array([f[0] for f in found], pa.large_string())
        lengths = [len(f[1]) for f in found]
        terms = distinct.take(pa.array(np.concatenate([f[1] for f in found])))
        heads = pa.nulls(len(found), terms.type)
        zeros = np.zeros(len(found), dtype=np.int64)
        places = np.concatenate([np.repeat(np.arange(len(found)), lengths), np.arange(len(found))])
        yield {
            "lang": pa.repeat(pa.scalar(lang, pa.large_string()), len(places)),
            "source": names.take(pa.array(places)),
            "term": pa.concat_arrays([terms, heads]),
            "n": pa.array(np.concatenate([f[2] for f in found] + [zeros])),
            "docs": pa.array(np.concatenate([f[3] for f in found] + [zeros])),
        }


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, added up by Spark.

    A null term counts the group itself, so that groups without terms stay. The rows of a language's
    term are in one partition, so that its groups meet without another shuffle.
    """

    def function(batch):
        table = _by_group(batch)
        # a text of b bytes has at most (b + 1) / 2 terms
        most = np.cumsum((pc.binary_length(table.column("text")).to_numpy() + 1) // 2)
        start = 0
        while start < len(table):
            before = most[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(most, before + HELD_TERMS, side="right")))
            yield from _counted(table.slice(start, end - start))
            start = end

    named = documents.select("lang", "source", "text")
    schema = "lang string, source string, term string, n long, docs long"
    return (
        map_batches(named, function, schema)
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _share(count, total, terms):
    """1 + floor(SHARES * (count + 1) / (total + terms)); as decimals where a product leaves 64 bits."""
    divisor, grown = total + terms, count + 1
    large = F.lit(SHARES).cast("decimal(10,0)") * grown.cast("decimal(20,0)")
    exact = _div(large, divisor.cast("decimal(20,0)"))
    return F.when(count < _FITS, _div(F.lit(SHARES) * grown, divisor)).otherwise(exact) + 1


def _div(left, right):
    return F.call_function("div", left, right)


def shares(counts: np.ndarray, divisor: int) -> np.ndarray:
    """The same for arrays, by long division."""
    quotient, rest = np.zeros_like(counts), counts + 1
    for scale in (1, _STEP, _STEP, _STEP):
        digit = rest * scale // divisor
        quotient = quotient * scale + digit
        rest = rest * scale - digit * divisor
    return quotient + 1


class Forest:
    """Segment trees of count rows of one length, with equal subtrees of any row as one node.

    ``levels[0]`` holds the distinct leaves' counts (-1: beyond the last term); ``levels[k]`` the
    distinct pairs of nodes of the level below. ``roots`` has one node per row.
    """

    def __init__(self, rows: np.ndarray):
        width = 1 << max(0, (rows.shape[1] - 1).bit_length())
        padded = np.full((len(rows), width), -1, dtype=np.int64)
        padded[:, : rows.shape[1]] = rows
        leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.levels: list[np.ndarray] = [leaves]
        while nodes.shape[1] > 1:
            below = len(self.levels[-1])
            codes = nodes[:, 0::2] * below + nodes[:, 1::2]
            known, flat = np.unique(codes, return_inverse=True)
            nodes = flat.reshape(codes.shape)
            self.levels.append(np.stack(np.divmod(known, below), axis=1))
        self.roots = nodes[:, 0]

    def leaf_pairs(self, left: int, rights: np.ndarray):
        """Walk the tree of ``left`` with each of ``rights`` at once.

        Returns (position in rights, leaf of left, leaf of right, multiplicity), each pair of leaves
        once per position.
        """
        at = np.arange(len(rights), dtype=np.int64)
        a = np.full(len(rights), self.roots[left], dtype=np.int64)
        b = self.roots[rights].astype(np.int64)
        times = np.ones(len(rights), dtype=np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            children, size = self.levels[level], len(self.levels[level - 1])
            codes = np.concatenate(
                [(at * size + children[a, side]) * size + children[b, side] for side in (0, 1)]
            )
            known, flat = np.unique(codes, return_inverse=True)
            merged = np.zeros(len(known), dtype=np.int64)
            np.add.at(merged, flat, np.concatenate([times, times]))
            times = merged
            rest, b = np.divmod(known, size)
            at, a = np.divmod(rest, size)
        return at, a, b, times


def divergences(
    rows: np.ndarray, divisors: list[int], pairs: list[tuple[int, int]]
) -> list[tuple[int, int]]:
    """Per pair (i, j) of rows: the sums of f of i against j's shares and of j against i's."""
    forest = Forest(rows)
    leaves = forest.levels[0]
    known = np.maximum(leaves, 0)
    table = np.stack([shares(known, d) for d in divisors])
    by_left: dict[int, list[int]] = defaultdict(list)
    for i, j in pairs:
        by_left[i].append(j)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, others in by_left.items():
        rights = np.array(others, dtype=np.int64)
        at, a, b, times = forest.leaf_pairs(i, rights)
        times = np.where((leaves[a] >= 0) & (leaves[b] >= 0), times, 0)
        p, q = table[i, a], table[rights[at], b]
        square = (p - q) ** 2
        sums = np.zeros((2, len(rights)), dtype=np.int64)
        np.add.at(sums[0], at, square // q * times)
        np.add.at(sums[1], at, square // p * times)
        for k, j in enumerate(others):
            found[i, j] = (int(sums[0, k]), int(sums[1, k]))
    return [found[pair] for pair in pairs]


def _price_block(table: pa.Table) -> pa.Table:
    """One block of terms, two tiles of groups: partial sums of all their pairs.

    Rows without a term name the groups with their totals; the others hold counts.
    """
    terms = table.column("term").combine_chunks().dictionary_encode()
    sources = table.column("source").combine_chunks().dictionary_encode()
    n = table.column("n").to_numpy()
    term = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(term < 0)
    source = sources.indices.to_numpy(zero_copy_only=False)
    row_of = np.empty(len(sources.dictionary), dtype=np.int64)
    row_of[source[heads]] = np.arange(len(heads))
    names = sources.dictionary.take(pa.array(source[heads])).to_pylist()
    tiles, divisors, widths = (
        table.column(name).take(pa.array(heads)).to_pylist() for name in ("tile", "divisor", "block_terms")
    )

    counts = np.flatnonzero(term >= 0)
    frequency = np.bincount(term[counts], weights=n[counts], minlength=len(terms.dictionary))
    place = np.empty(len(frequency), dtype=np.int64)
    place[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency))
    rows = np.zeros((len(heads), widths[0]), dtype=np.int64)
    rows[row_of[source[counts]], place[term[counts]]] = n[counts]
    low, high, lang = (table.column(name)[0].as_py() for name in ("low", "high", "lang"))
    pairs = [
        (i, j)
        for i in range(len(names))
        for j in range(len(names))
        if tiles[i] == low and tiles[j] == high and (low != high or i < j)
    ]
    found = divergences(rows, divisors, pairs)
    both = [(names[i], names[j], f) for (i, j), (f, _) in zip(pairs, found)]
    both += [(names[j], names[i], f) for (i, j), (_, f) in zip(pairs, found)]
    left, right, value = ([x[k] for x in both] for k in range(3))
    return pa.table(
        {
            "lang": pa.array([lang] * len(both), pa.string()),
            "source": pa.array(left, pa.string()),
            "item": pa.array(right, pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def _pair_values(counts: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of groups of a language.

    ``counts`` (lang, source, term, n) of kept terms; ``groups`` (lang, source, total, terms, tiles,
    tile) of all groups; ``sizes`` (lang, block, block_terms) of all blocks of kept terms.
    """
    cells = F.explode(
        F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, tile) AS low, greatest(t, tile) AS high))")
    )
    dealt = groups.select("lang", "source", "total", "terms", "tile", cells.alias("cell"))
    heads = dealt.join(sizes, "lang").select(
        "lang",
        "block",
        "cell.low",
        "cell.high",
        "source",
        "tile",
        F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("long").alias("n"),
        (F.col("total") + F.col("terms")).alias("divisor"),
        "block_terms",
    )
    none = F.lit(None).cast("long")
    body = counts.join(dealt.drop("total", "terms"), ["lang", "source"]).select(
        "lang", "block", "cell.low", "cell.high", "source", "tile", "term", "n",
        none.alias("divisor"), none.alias("block_terms"),
    )
    grouped = heads.union(body).groupBy("lang", "block", "low", "high")
    partial = apply_arrow(grouped, _price_block, "lang string, source string, item string, value long")
    # pairs of a language without kept terms: no block names them
    left = groups.where("terms = 0").select("lang", "source")
    right = left.select("lang", F.col("source").alias("item"))
    empty = left.join(right, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return partial.union(empty).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of groups and each group's foremost terms."""
    # a language's term is in one partition: what its groups have in common needs a sort, by a hash first
    term_hash = F.xxhash64("term")
    common = Window.partitionBy("hash", "lang", "term")
    counted = stored(
        term_counts(documents)
        .withColumn("hash", term_hash)
        .select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("n").over(common).alias("lang_n"),
            F.sum("docs").over(common).alias("lang_docs"),
            (F.min("source").over(common) == F.col("source")).alias("first"),
        )
        .where(F.col("term").isNull() | (F.col("lang_docs") >= LEAST_DOCUMENTS))
        .drop("lang_docs")
    )
    kept_counts = counted.where(F.col("term").isNotNull())

    # one row per language and group: their number is that of the sources, not of the documents
    terms = (
        kept_counts.where("first")
        .groupBy("lang")
        .agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    )
    totals = kept_counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = counted.where(F.col("term").isNull()).select("lang", "source")
    tiles = names.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(TILE_GROUPS)).cast("int").alias("tiles"))
    zero = F.lit(0).cast("long")
    groups = stored(
        names.join(totals, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .join(tiles, "lang")
        .select(
            "lang",
            "source",
            F.coalesce("total", zero).alias("total"),
            F.coalesce("terms", zero).alias("terms"),
            F.coalesce("lang_total", zero).alias("lang_total"),
            "tiles",
            F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"),
        )
    )
    placed = kept_counts.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    block = F.pmod(term_hash, F.ceil(F.col("terms") / F.lit(BLOCK_TERMS))).cast("int")
    placed = placed.withColumn("block", block)
    sizes = placed.where("first").groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    pairs = _pair_values(placed.select("lang", "source", "term", "n", "block"), groups, sizes)

    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    rated = placed.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order)
    # Spark limits each group before the shuffle, so a hot source sends few rows from each task
    foremost = (
        rated.select("lang", "source", "item", value.alias("value"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= TERM_RANKS)
    )
    ranked = pairs.withColumn("rank", rank)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (
        ranked.withColumn("part", F.lit("pair"))
        .select(*columns)
        .union(foremost.withColumn("part", F.lit("term")).select(*columns))
    )
