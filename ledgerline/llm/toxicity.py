"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel counts common subsequences of ``ORDER`` characters; each character a match stretches over
costs a factor ``DECAY``. A sentence is compared with a landmark by its best word: windows slide over
the whole word, twice as long as the landmark at most, relative to the landmark with itself, so inserted
characters, joined words, suffixes and letters set apart by blanks change little. Landmarks are words and
beginnings of words, or of the parts of words between signs, of toxic training texts, picked greedily
until every toxic text is covered ``COVER`` times. Nystroem's K^(-1/2) turns landmark similarities, the
largest of a sentence for each landmark, into features for a linear machine. The score of a document is the
share of toxic training documents at its largest sentence margin, by monotone regression.

Training takes at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` other labelled documents that are not
held out, chosen by a hash of doc_id, one text for each id, and between ``TRAIN_SENTENCES`` and twice as
many clean sentences of these, evenly by their features; sentences of clean documents are negative, the strongest sentence
of a toxic one and those that hold a landmark nearly whole are positive. Scoring covers every text whole and sees nothing
but the text; a worker remembers compared words up to ``KEPT_BYTES``.

Nulls and empty texts score like a text without any similar word. Rows are scored one by one; a null
doc_id is never held out. Without toxic training texts every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_batches, slices, stored, texts

ORDER = 3
DECAY = 0.93
LEAST_PREFIX, MOST_PREFIX = 4, 8
LANDMARKS = 64
COVER = 4
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 6000
TRAIN_SENTENCES = 20_000
CANDIDATES = 3000
#: Nats of evidence a landmark needs: its texts would be toxic by chance with probability e^-SURPRISE.
SURPRISE = 12.0
#: Similarities below this are noise of common letters and count as none.
NOISE = 0.6
#: Similarities are raised to this power, a kernel again, so that near misses count for less.
SHARPNESS = 3
#: Sentences of toxic texts with such a similarity are positive, besides the strongest of each.
CERTAIN = 0.9
TOXIC_FROM = 0.7
#: Memory of compared words in a worker, with what an entry costs besides its characters.
KEPT_BYTES, ENTRY_BYTES = 96 << 20, 120

_STOP = re.compile(r"[.,!?;:\"]+(?=\s)")
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_SIGNS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def words_of(text: str) -> list[str]:
    """Lower-cased words without closing punctuation; letters set apart by blanks are one word."""
    text = _STOP.sub(" ", text.lower() + " ")
    words = text.split()
    if _SPACED.search(text):
        words += ["".join(m[0].split()) for m in _SPACED.finditer(text)]
    return words


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of many strings (rows of ``left``, padded with 0) with one."""
    rows, width = left.shape
    length = len(right)
    # ahead[b]: sum over matches of the first i symbols inside right[:b], with the weight of the tails
    same = [left == symbol for symbol in right]
    ahead = np.ones((width + 1, length + 1, rows))
    total = np.zeros(rows)
    for level in range(1, order + 1):
        fresh = np.zeros((width + 1, length + 1, rows))
        if level == order:
            for a in range(width):
                for b in range(length):
                    total += same[b][:, a] * ahead[a, b] * decay**2
            break
        for a in range(width):
            run = np.zeros(rows)
            for b in range(length):
                run = decay * run + same[b][:, a] * ahead[a, b] * decay**2
                fresh[a + 1, b + 1] = decay * fresh[a, b + 1] + run
        ahead = fresh
    return total


def _codes(words: list[str], width: int) -> np.ndarray:
    """Characters as numbers, cut or padded to ``width``."""
    joined = "".join([w[:width].ljust(width, "\0") for w in words])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)


def _pairs(codes: np.ndarray, reach: int) -> np.ndarray:
    """Marks, per row, of hashed pairs of characters at most ``reach`` apart."""
    marks = np.zeros((len(codes), 256), dtype=np.uint8)
    rows = np.arange(len(codes))[:, None]
    for apart in range(1, min(reach, codes.shape[1] - 1) + 1):
        left, right = codes[:, :-apart], codes[:, apart:]
        place = np.where(right > 0, (left * 31 + right * 7) % 255 + 1, 0)
        marks[rows, place] = 1
    marks[:, 0] = 0
    return marks


class Landmarks:
    """Similarity of words with the landmarks."""

    #: Longest window, and the lengths that words, or pieces of longer ones, are padded to.
    WINDOW = 2 * MOST_PREFIX - 1
    SHORT, PIECE = 16, 48

    def __init__(self, names: list[str]):
        self.names = names
        self.codes = [_codes([n], len(n))[0] for n in names]
        self.own = np.array([subsequence_kernel(c[None], c)[0] for c in self.codes])
        self.pairs = [np.flatnonzero(_pairs(c[None], 1)[0]) for c in self.codes]
        self.similar: dict[str, tuple[tuple[int, float], ...]] = {}
        self.other: set[str] = set()
        self.size = 0

    def gram(self) -> np.ndarray:
        """Normalised kernel among the landmarks."""
        size = len(self.names)
        table = np.zeros((size, size))
        width = max(map(len, self.names))
        rows = _codes(self.names, width)
        for k in range(size):
            table[:, k] = subsequence_kernel(rows, self.codes[k])
        return (table / np.sqrt(np.outer(self.own, self.own))) ** SHARPNESS

    def _pieces(self, words: list[str]):
        """(owners, strings, width) in bounded groups; a longer word is cut into overlapping pieces."""
        short = [n for n, word in enumerate(words) if len(word) <= self.SHORT]
        if short:
            yield short, [words[n] for n in short], self.SHORT
        owners, held = [], []
        for n, word in enumerate(words):
            if len(word) > self.SHORT:
                for at in range(0, len(word) - self.WINDOW + 1, self.PIECE - self.WINDOW + 1):
                    owners.append(n)
                    held.append(word[at : at + self.PIECE])
                    if len(held) == 20_000:
                        yield owners, held, self.PIECE
                        owners, held = [], []
        if held:
            yield owners, held, self.PIECE

    def compare(self, words: list[str]) -> dict[str, tuple[tuple[int, float], ...]]:
        """Per word that resembles a landmark: (landmark, similarity) pairs above the noise.

        Windows open at the beginning and wherever one of the landmark's first three characters
        stands: what lacks these three is not similar. Pairs of neighbours in the landmark must be
        met, at most two characters between, for most pairs of it before the kernel is computed.
        """
        found: dict[str, dict[int, float]] = {}
        for owners, held, width in self._pieces(words):
            codes = _codes(held, width)
            marks = _pairs(codes, 3)
            padded = np.pad(codes, ((0, 0), (0, self.WINDOW)))
            for k, name in enumerate(self.names):
                met = marks[:, self.pairs[k]].sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(met >= 0.6 * len(self.pairs[k]))
                opens = np.isin(codes[near], self.codes[k][:3])
                opens[:, 0] = True
                row, start = np.nonzero(opens)
                row = near[row]
                reach = np.arange(2 * len(name) - 1)
                for part in slices(len(row), 4096):
                    windows = padded[row[part, None], start[part, None] + reach]
                    value = np.minimum(subsequence_kernel(windows, self.codes[k]) / self.own[k], 1.0)
                    for n in np.flatnonzero(value >= NOISE).tolist():
                        best = found.setdefault(words[owners[row[part][n]]], {})
                        best[k] = max(best.get(k, 0.0), float(value[n]))
        return {word: tuple(pairs.items()) for word, pairs in found.items()}

    def learn(self, words: set[str]) -> None:
        """Compare the words not met before; the memory of words is bounded."""
        fresh = [w for w in words if w not in self.other and w not in self.similar]
        if self.size + sum(map(len, fresh)) + ENTRY_BYTES * len(fresh) > KEPT_BYTES:
            self.other.clear()
            self.similar.clear()
            self.size, fresh = 0, list(words)
        self.size += sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
        for part in slices(len(fresh), 20_000):
            found = self.compare(fresh[part])
            self.similar.update(found)
            self.other.update(w for w in fresh[part] if w not in found)

    def sentences(self, listed: list[str]) -> list[np.ndarray]:
        """Per text: similarities of its sentences that have any, each the best of its words."""
        out = []
        for part in slices(len(listed), 100):
            words = [set(words_of(text)) for text in listed[part]]
            self.learn(set().union(*words))
            for text, own in zip(listed[part], words):
                rows = []
                if not self.similar.keys().isdisjoint(own):
                    for sentence in _SENTENCE.split(text):
                        near = [self.similar[w] for w in words_of(sentence) if w in self.similar]
                        if near:
                            row = np.zeros(len(self.names))
                            for pairs in near:
                                for k, value in pairs:
                                    row[k] = max(row[k], value**SHARPNESS)
                            rows.append(row)
                out.append(np.array(rows).reshape(-1, len(self.names)))
        return out


def _sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The training documents (doc_id, toxic, text), one of equal texts, of bounded number."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(
        F.col("doc_id").isNotNull()
        & F.col("toxic").isin(0, 1)
        & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    )
    chosen = None
    for toxic, bound in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    # of bounded size by the limits above
    wanted = F.broadcast(stored(chosen))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    one = F.min_by("text", F.xxhash64("text")).alias("text")  # an id's rows may be many
    return found.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(one).dropDuplicates(["text", "toxic"])


def _units(text: str) -> set[str]:
    """Words, their parts between signs, and the beginnings of both."""
    units = set()
    for word in words_of(text):
        for form in {word, *_SIGNS.split(word)}:
            if len(form) >= LEAST_PREFIX:
                units.add(form)
                units.update(form[:n] for n in range(LEAST_PREFIX, min(len(form), MOST_PREFIX) + 1))
    return units


def _candidates(sample: DataFrame) -> list[str]:
    """Words and word beginnings that mark toxic texts, the most frequent first."""

    def function(batch):
        out = {"unit": [], "toxic": []}
        for text, toxic in zip(texts(batch), batch.column(1).to_pylist()):
            units = _units(text)
            out["unit"] += units
            out["toxic"] += [toxic] * len(units)
        yield out

    counted = (
        map_batches(sample.select("text", "toxic"), function, "unit string, toxic int")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("misses"))
    )
    sizes = sample.agg(F.avg("toxic").alias("share")).first()
    if not sizes.share or sizes.share == 1:
        return []
    least = max(3.0, SURPRISE / -math.log(sizes.share))
    marking = counted.where((F.col("hits") >= least) & (F.col("hits") >= 20 * F.col("misses")))
    rows = marking.orderBy(F.desc("hits"), F.desc(F.length("unit")), "unit").limit(CANDIDATES).collect()
    return [row.unit for row in rows]


def _pick(sample: DataFrame, candidates: list[str]) -> list[str]:
    """Greedy cover: landmarks until each toxic text holds ``COVER`` of them."""
    if not candidates:
        return []
    number = {unit: k for k, unit in enumerate(candidates)}

    def function(batch):
        held = []
        for text in texts(batch):
            held.append(sorted(number[u] for u in _units(text) if u in number))
        yield {"units": held}

    toxic = sample.where("toxic = 1").select("text")
    rows = [r.units for r in map_batches(toxic, function, "units array<int>").collect()]
    holds = np.zeros((len(rows), len(candidates)), dtype=bool)
    for at, units in enumerate(rows):
        holds[at, units] = True
    need = np.minimum(COVER, holds.sum(axis=1))
    lengths = np.array([len(c) for c in candidates])
    picked: list[str] = []
    while len(picked) < LANDMARKS:
        gain = holds[need > 0].sum(axis=0)
        best = int(np.lexsort((-lengths, -gain))[0])
        if gain[best] < 3:
            break
        covered = holds[:, best].copy()
        picked.append(candidates[best])
        need -= covered & (need > 0)
        # longer and shorter forms of it add nothing to the same texts
        name = candidates[best]
        forms = [k for k, c in enumerate(candidates) if c.startswith(name) or name.startswith(c)]
        holds[np.ix_(covered, forms)] = False
        holds[:, best] = False
    return [p[:MOST_PREFIX] for p in dict.fromkeys(picked)]


class Model:
    """Landmarks, their whitening, the machine's weights and its calibration."""

    def __init__(self, names: list[str]):
        self.names = names
        self.weights, self.direct, self.bias = np.zeros(len(names)), np.zeros(len(names)), 0.0
        self.margins, self.shares = [0.0], [0.0]
        if names:
            values, vectors = np.linalg.eigh(Landmarks(names).gram())
            safe = np.maximum(values, 1e-3)
            self.whitening = vectors @ np.diag(safe**-0.5) @ vectors.T

    def margin(self, rows: np.ndarray) -> float:
        """Largest margin among the sentences of a document and a sentence without similar words."""
        if not len(rows):
            return self.bias
        return max(self.bias, float((rows @ self.direct).max()) + self.bias)

    def score(self, rows: np.ndarray) -> float:
        return float(np.interp(self.margin(rows), self.margins, self.shares))

    def fit(self, documents: list[tuple[int, np.ndarray]], rounds: int = 4) -> None:
        """Hinge loss by averaged subgradient steps; a toxic text's strongest sentence is re-chosen."""
        negative = [rows for toxic, rows in documents if not toxic and len(rows)]
        positive = [rows for toxic, rows in documents if toxic and len(rows)]
        if not positive:
            return
        low = np.concatenate([*negative, np.zeros((max(20, len(positive)), len(self.names)))])
        low = low[np.lexsort(low.T)][:: max(1, len(low) // TRAIN_SENTENCES)]
        self.direct = self.whitening @ self.whitening @ np.ones(len(self.names))
        for _ in range(rounds):
            high = np.concatenate(
                [
                    rows[(rows.max(axis=1) >= CERTAIN) | (np.arange(len(rows)) == np.argmax(rows @ self.direct))]
                    for rows in positive
                ]
            )
            data = np.concatenate([high, low]) @ self.whitening
            sign = np.concatenate([np.ones(len(high)), -np.ones(len(low))])
            share = np.where(sign > 0, 0.5 / len(high), 0.5 / len(low))
            weights, bias = np.zeros(data.shape[1]), 0.0
            mean, mean_bias, steps = np.zeros_like(weights), 0.0, 600
            for step in range(1, steps + 1):
                wrong = sign * (data @ weights + bias) < 1
                pull = share * wrong * sign
                rate = 1.0 / (1.0 + 0.02 * step)
                weights += rate * (pull @ data - 1e-4 * weights) * 4
                bias += rate * pull.sum() * 4
                if step > steps // 2:
                    mean += weights
                    mean_bias += bias
            self.weights, self.bias = mean / (steps // 2), mean_bias / (steps // 2)
            self.direct = self.whitening @ self.weights
        self._calibrate(documents)

    def _calibrate(self, documents: list[tuple[int, np.ndarray]]) -> None:
        """Share of toxic documents by margin, monotone: neighbours that fall are pooled."""
        pairs = sorted((self.margin(rows), t) for t, rows in documents)
        blocks: list[list[float]] = []  # least and largest margin, toxic documents, documents
        for margin, toxic in pairs:
            blocks.append([margin, margin, toxic, 1.0])
            while len(blocks) > 1 and (
                blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]
                or blocks[-2][1] >= blocks[-1][0]
            ):
                low, high, hits, size = blocks.pop()
                blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + hits, blocks[-1][3] + size]
        self.margins = [edge for block in blocks for edge in block[:2]]
        self.shares = [block[2] / block[3] for block in blocks for _ in range(2)]


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit the model on the bounded sample."""
    sample = stored(_sample(documents, labels))
    model = Model(_pick(sample, _candidates(sample)))
    if not model.names:
        return model
    names = model.names

    def function(batch):
        marks = landmarks(tuple(names))
        rows = marks.sentences(list(texts(batch)))
        yield {
            "toxic": batch.column(1),
            "rows": [np.round(r, 3).ravel().tolist() for r in rows],
        }

    found = map_batches(sample.select("text", "toxic"), function, "toxic int, rows array<double>")
    model.fit([(r.toxic, np.array(r.rows).reshape(-1, len(names))) for r in found.collect()])
    return model


@lru_cache(maxsize=2)
def landmarks(names: tuple[str, ...]) -> Landmarks:
    """One set for each worker process, with the words it has met."""
    return Landmarks(list(names))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: held out or not, score, prediction."""
    model = train(documents, labels)

    def function(batch):
        listed = list(texts(batch))
        if model.names:
            rows = landmarks(tuple(model.names)).sentences(listed)
        else:
            rows = [np.zeros((0, 0))] * len(listed)
        yield {"doc_id": batch.column(0), "score": [model.score(r) for r in rows]}

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = map_batches(source, function, "doc_id long, score double")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return scored.select(
        "doc_id",
        F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )
