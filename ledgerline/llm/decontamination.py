"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

Both sides are lower-cased (A-Z) and cut into words of ASCII letters, digits and all non-ASCII
characters. Every 13 consecutive words of an item are a pattern; a shorter item is one pattern. The
automaton reads word numbers, so a pattern costs few nodes; a word that no item has ends a run. Hits are mapped to code points of the original text.

The benchmark is a stated query set. It is taken in blocks of at most ``BLOCK_BYTES`` of text; each
block is one automaton that tasks build from a broadcast of that bounded size, and documents are
scanned once per block. Usual test sets are one block, which needs no shuffle. Of several, the driver
holds one at a time: each block's hits are written before the next is fetched, and joined to the rows by
a digest of the text, since equal texts have equal hits whatever their ids.

Nulls: a null text has no words, a null item or item without words no pattern, an item with a null
id marks words but is not listed. Repeated document rows are judged row by row; repeated items
count once per item_id. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow, map_batches, stored, texts

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to normalised bytes: A-Z to lower case, other ASCII but digits and letters to blanks.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:int,end:int>>"
)


def words_of(text: str) -> list[bytes]:
    """Normalised words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def blocks_of(items: DataFrame) -> tuple[int, Iterator[list[tuple[str | None, str]]]]:
    """The number of blocks of bounded size, and the items block by block, fetched when asked for."""
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        F.length("text") > 0
    )
    totals = sized.agg(F.sum(F.octet_length("text")).alias("b")).first()
    if not totals.b:
        return 0, iter(())
    count = 1 if totals.b <= BLOCK_BYTES else -(-2 * totals.b // BLOCK_BYTES)
    dealt = sized.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    return count, (
        [tuple(row) for row in dealt.where(F.col("_block") == k).drop("_block").collect()]
        for k in range(count)
    )


class Patterns:
    """Item windows as an automaton over word numbers.

    A word number is spelled with ``DIGIT_BITS`` bits a character, each place with an alphabet of its
    own: nodes stay narrow, which the automaton's linear child lists need, and matches stay aligned.
    Only runs of item words as long as the shortest pattern enter the automaton.
    """

    DIGIT_BITS = 5

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        numbers: dict[bytes, int] = {}
        rows = [
            (item, [numbers.setdefault(word, len(numbers) + 1) for word in words_of(text)])
            for item, text in items
        ]
        self.places = max(1, -(-len(numbers).bit_length() // self.DIGIT_BITS))
        self.letters = {word: chr(n if n < 0xD800 else n + 0x800) for word, n in numbers.items()}
        self.spelled = {self.letters[word]: self._spell(n) for word, n in numbers.items()}
        found: dict[tuple[int, ...], set] = {}
        for item, row in rows:
            if row:
                for start in range(max(1, len(row) - window + 1)):
                    found.setdefault(tuple(row[start : start + window]), set()).add(item)
        self.any = bool(found)
        self.automaton = ahocorasick.Automaton()
        for key, owners in found.items():
            self.automaton.add_word("".join(map(self._spell, key)), (len(key), frozenset(owners)))
        if found:
            self.automaton.make_automaton()
            self.runs = re.compile("[^\0]{%d,}" % min(map(len, found)))

    def _spell(self, number: int) -> str:
        base = 1 << self.DIGIT_BITS
        return "".join(
            chr(1 + place * base + (number >> (place * self.DIGIT_BITS)) % base)
            for place in range(self.places)
        )

    def hits(self, words: list[bytes]):
        """Marks of hit words and the items found, or None where nothing matches."""
        get = self.letters.get
        row = "".join([get(word, "\0") for word in words])
        edges, owners = None, set()
        for run in self.runs.finditer(row):
            spelled = "".join(map(self.spelled.__getitem__, run[0]))
            for at, (length, items) in self.automaton.iter(spelled):
                if edges is None:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                end = run.start() + (at + 1) // self.places
                edges[end - length] += 1
                edges[end] -= 1
                owners |= items
        if edges is None:
            return None
        return np.cumsum(edges[:-1]) > 0, owners


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as code points of the text, end exclusive."""
    spans: list[dict[str, int]] = []
    last = None
    for number, match in enumerate(_WORD.finditer(text)):
        if not hit[number]:
            continue
        if last is not None and last == number - 1:
            spans[-1]["end"] = match.end()
        else:
            spans.append({"start": match.start(), "end": match.end()})
        last = number
    return spans


def digest_of(items) -> str:
    listed = sorted(x for x in items if x is not None)
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def _scan(documents: DataFrame, shared, window: int) -> DataFrame:
    """Hits of the broadcast items in every row of (doc_id, text)."""
    made: list[Patterns] = []

    def function(batch):
        if not made:
            made.append(Patterns(shared.value, window))
        patterns = made[0]
        out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        out |= {"doc_id": batch.column(0), "items": [], "spans": []}
        for text in texts(batch):
            words = words_of(text)
            hits = patterns.hits(words) if patterns.any and words else None
            n_hit, owners, spans = 0, [], []
            if hits:
                n_hit = int(hits[0].sum())
                owners = sorted(x for x in hits[1] if x is not None)
                spans = original_spans(text, hits[0])
            out["n_words"].append(len(words))
            out["n_hit"].append(n_hit)
            out["n_items"].append(len(owners))
            out["items_sha256"].append(digest_of(owners))
            out["contaminated"].append(n_hit > 0 and HIT_SHARE * n_hit >= len(words))
            out["items"].append(owners)
            out["spans"].append(spans)
        yield out

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(source, function, SCHEMA)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: words, hit words, items found, spans of hits, verdict."""
    count, blocks = blocks_of(benchmark)
    if count > 1:
        return _merged(documents, blocks, window)
    shared = documents.sparkSession.sparkContext.broadcast(next(blocks, []))
    return _scan(documents, shared, window)


def _text_digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _block_hits(documents: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """(digest, items, spans) of the texts that one block hits, written before the block is released."""
    shared = documents.sparkSession.sparkContext.broadcast(items)
    made: list[Patterns] = []

    def function(batch):
        if not made:
            made.append(Patterns(shared.value, window))
        out: dict[str, list] = {"digest": [], "items": [], "spans": []}
        for text, digest in zip(texts(batch), batch.column(1).to_pylist()):
            words = words_of(text)
            hits = made[0].hits(words) if made[0].any and words else None
            if hits:
                out["digest"].append(digest)
                out["items"].append(sorted(x for x in hits[1] if x is not None))
                out["spans"].append(original_spans(text, hits[0]))
        yield out

    source = documents.select("text", _text_digest().alias("digest"))
    schema = "digest string, items array<string>, spans array<struct<start:int,end:int>>"
    written = stored(map_batches(source, function, schema))
    shared.destroy()
    return written


def _merged(
    documents: DataFrame, blocks: Iterator, window: int, *, digests: bool = False
) -> DataFrame:
    """Union of the blocks' hits, judged on the words that any block hits; with text digests if asked."""
    parts = None
    for block in blocks:
        part = _block_hits(documents, block, window)
        parts = part if parts is None else parts.unionByName(part)
    # sets have partial results, so copies of a text add nothing to its group
    items = parts.select("digest", F.explode_outer("items").alias("item")).groupBy("digest").agg(
        F.collect_set("item").alias("items")
    )
    spans = parts.select("digest", F.explode("spans").alias("span")).groupBy("digest").agg(
        F.collect_set("span").alias("spans")
    )
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", _text_digest().alias("digest")
    )
    found = rows.join(items.join(spans, "digest"), "digest", "left")

    def function(batch):
        out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        out |= {"doc_id": batch.column(0), "items": [], "spans": []}
        for text, named, spans in zip(texts(batch), batch.column(2), batch.column(3)):
            owners = sorted(named.as_py() or [])
            inside = np.zeros(len(text), dtype=bool)
            for span in spans.as_py() or []:
                inside[span["start"] : span["end"]] = True
            hit = inside[np.array([m.start() for m in _WORD.finditer(text)], dtype=np.int64)]
            n_hit = int(hit.sum())
            out["n_words"].append(len(hit))
            out["n_hit"].append(n_hit)
            out["n_items"].append(len(owners))
            out["items_sha256"].append(digest_of(owners))
            out["contaminated"].append(n_hit > 0 and HIT_SHARE * n_hit >= len(hit))
            out["items"].append(owners)
            out["spans"].append(original_spans(text, hit) if n_hit else [])
        if digests:
            out["digest"] = batch.column(4)
        yield out

    schema = f"{SCHEMA}, digest string" if digests else SCHEMA
    return map_batches(found.select("doc_id", "text", "items", "spans", "digest"), function, schema)


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, all columns kept."""
    count, blocks = blocks_of(benchmark)
    if count <= 1:
        items = next(blocks, [])
        return _filtered(documents, items) if items else documents
    bad = _merged(documents, blocks, WINDOW, digests=True).where("contaminated")
    verdict = bad.select(F.col("digest").alias("_key")).distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    rows = documents.select(whole, _text_digest().alias("_key"))
    return rows.join(verdict, "_key", "left_anti").select("_row.*")


def _filtered(documents: DataFrame, items: list) -> DataFrame:
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(items)
    made: list[Patterns] = []
    place = documents.columns.index("text")

    def run(batches):
        if not made:
            made.append(Patterns(shared.value, WINDOW))
        patterns = made[0]
        for batch in batches:
            keep = []
            for value in batch.column(place):
                words = words_of(value.as_py() or "")
                hits = patterns.hits(words) if patterns.any and words else None
                keep.append(hits is None or HIT_SHARE * int(hits[0].sum()) < len(words))
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return map_arrow(documents, run, documents.schema)
