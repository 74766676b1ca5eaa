"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The patterns find their kinds as the contract says and are never overruled. The field works on
regions, runs of words that hold a digit or an at sign. Its segments are whole candidate entities of
at most ``MAX_TOKENS`` tokens; features look at the whole span (digit counts, checksums, groups,
balance, borders, the word before). A dynamic program over token borders chooses boundaries and kinds
together, in time linear in the text for the bounded entity length; what it finds outside the base
spans is added.

Weights are trained here by maximum likelihood (forward-backward over the same segments, AdaGrad) on
at most ``TRAIN_REGIONS`` different regions, chosen by hash over all documents and labelled by the patterns.
A third of them is shown without its leading sign or
with other separators, so that the field also learns forms that the patterns do not know. The bound
is the only sampling; scanning covers every text whole.

Nulls are empty texts without spans. Rows are scanned one by one, repeated rows alike; an empty table
gives no rows. Without any region the weights stay zero and nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import map_arrow, map_batches, texts

KINDS = ("email", "ip", "card", "phone")
TRAIN_REGIONS = 600
MAX_REGION = 240
MAX_TOKENS = 20
EPOCHS = 12
#: Log-odds against the reading without the entity from which a found span is added.
MARGIN = 1.0

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGIT = re.compile(r"[^0-9]+")
_SEED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")

Span = tuple[str, int, int]

SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, found array<struct<kind:string,start:int,end:int>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def email_spans(text: str) -> list[Span]:
    """Leftmost matches, found from their at signs so that long words cost no backtracking."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by kind, then place."""
    found = email_spans(text)
    if not _SEED.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or at sign, single blanks between them included."""
    found: list[tuple[int, int]] = []
    seed = _SEED.search(text)
    while seed:
        start = end = seed.start()
        low = found[-1][1] if found else 0
        while start > low and not text[start - 1].isspace():
            start -= 1
        size = len(text)
        while end < size and not text[end].isspace():
            end += 1
        if found and start - found[-1][1] <= 1:
            found[-1] = (found[-1][0], end)
        else:
            found.append((start, end))
        seed = _SEED.search(text, end)
    return found


#: Names of the whole-span features, in order.
FEATURES = (
    "bias", "at", "one_at", "dot_after_at", "letter_end", "digits_7_8", "digits_9_12", "digits_13_19",
    "digits_20", "luhn", "octets", "groups_1", "groups_2_3", "groups_4", "groups_5", "plus", "paren",
    "unbalanced", "dash", "blank", "dot", "letters", "other", "cut_left", "cut_right", "cut_sign",
    "blank_and_dot", "uneven_groups",
)
_PLACE = {name: k for k, name in enumerate(FEATURES)}


def span_features(text: str, start: int, end: int, low: int = 0, high: int | None = None) -> list[int]:
    """Active features of text[start:end]; borders are looked at within [low, high)."""
    span = text[start:end]
    high = len(text) if high is None else high
    on = ["bias"]
    digits = _NOT_DIGIT.sub("", span)
    groups = [g for g in _NOT_DIGIT.split(span) if g]
    count = len(digits)
    signs = span.count("@")
    if signs:
        on.append("at")
        if signs == 1:
            on.append("one_at")
            if "." in span[span.index("@") :]:
                on.append("dot_after_at")
        if span[-1].isalpha():
            on.append("letter_end")
    if not signs:
        on.append(
            "digits_20" if count > 19 else "digits_13_19" if count > 12
            else "digits_9_12" if count > 8 else "digits_7_8"
        )
        if 13 <= count <= 19 and luhn(digits):
            on.append("luhn")
        if len(groups) == 4 and span.count(".") == 3 and all(map(_octet, groups)):
            on.append("octets")
        if len(set(map(len, groups))) > 1:
            on.append("uneven_groups")
        size = len(groups)
        on.append("groups_1" if size == 1 else "groups_2_3" if size < 4 else "groups_4" if size == 4 else "groups_5")
    if span[0] == "+":
        on.append("plus")
    if "(" in span or ")" in span:
        on.append("paren")
        if span.count("(") != span.count(")"):
            on.append("unbalanced")
    letters = any(c.isalpha() for c in span)
    blank, dot = " " in span, "." in span
    for name, there in (
        ("dash", "-" in span), ("blank", blank), ("dot", dot), ("letters", letters and not signs),
        ("other", any(not c.isalnum() and c not in "@+().- _%" for c in span)),
        ("blank_and_dot", blank and dot),
    ):
        if there:
            on.append(name)
    before = text[start - 1] if start > low else " "
    after = text[end] if end < high else " "
    if before.isalnum():
        on.append("cut_left")
    if after.isalnum():
        on.append("cut_right")
    if before in "+@(" or after == "@" or (after in ".-" and end + 1 < high and text[end + 1].isalnum()):
        on.append("cut_sign")
    return [_PLACE[name] for name in on]


def segments(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token borders of a region and its candidate segments as (first, last border, features)."""
    tokens = list(_TOKEN.finditer(text, low, high))
    borders = [m.start() for m in tokens] + [high]
    digits = np.concatenate(([0], np.cumsum([len(m[0]) if m[0][0] in "0123456789" else 0 for m in tokens]))).tolist()
    signs = np.concatenate(([0], np.cumsum([m[0] == "@" for m in tokens]))).tolist()
    found = []
    size = len(tokens)
    for i in range(size):
        first = tokens[i][0][0]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i + 1, min(size, i + MAX_TOKENS) + 1):
            last = tokens[j - 1][0][0]
            if not last.isalnum():
                if last.isspace() and last != " ":
                    break
                continue
            if signs[j] - signs[i] == 1 or signs[j] == signs[i] and digits[j] - digits[i] >= 7:
                found.append((i, j, span_features(text, borders[i], borders[j], low, high)))
    return borders, found


def _scores(found, weights: np.ndarray) -> list[list[float]]:
    rows = weights.T.tolist()
    return [[sum(column) for column in zip(*(rows[f] for f in features))] for _, _, features in found]


def decode(text: str, low: int, high: int, weights: np.ndarray) -> list[Span]:
    """Best boundaries and kinds of a region; tokens outside entities score nothing."""
    borders, found = segments(text, low, high)
    if not found:
        return []
    ending: dict[int, list] = {}
    for (i, j, _), scores in zip(found, _scores(found, weights)):
        kind = max(range(len(KINDS)), key=scores.__getitem__)
        if scores[kind] > MARGIN:
            ending.setdefault(j, []).append((i, kind, scores[kind]))
    best, back = [0.0], [None]
    for j in range(1, len(borders)):
        top, choice = best[j - 1], None
        for i, kind, score in ending.get(j, ()):
            if best[i] + score > top:
                top, choice = best[i] + score, (i, kind)
        best.append(top)
        back.append(choice)
    spans, j = [], len(borders) - 1
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            spans.append((KINDS[kind], borders[i], borders[j]))
            j = i
    return spans[::-1]


def _variants(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """Every third region without leading signs or with other separators, its labels adjusted."""
    if turn % 3 != 2 or len(spans) != 1:
        return text, spans
    kind, start, end = spans[0]
    span = text[start:end]
    if kind == "phone":
        span = span[1:] if turn % 2 else span.replace(" ", "-").replace("(", "").replace(")", "")
    elif kind == "card" and len(span) == 16:
        span = ".".join(span[k : k + 4] for k in range(0, 16, 4))
    return text[:start] + span + text[end:], [(kind, start, start + len(span))]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _gradient(borders, found, gold: set, weights: np.ndarray, into: np.ndarray) -> None:
    """Add the gradient of one region's log-likelihood, by forward and backward sums."""
    size = len(borders)
    scores = _scores(found, weights)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for number, (i, j, _) in enumerate(found):
        by_end.setdefault(j, []).append(number)
        by_start.setdefault(i, []).append(number)
    ahead = [0.0] * size
    for j in range(1, size):
        terms = [ahead[j - 1]]
        for number in by_end.get(j, ()):
            base = ahead[found[number][0]]
            terms += [base + s for s in scores[number]]
        ahead[j] = _log_sum(terms)
    behind = [0.0] * size
    for i in range(size - 2, -1, -1):
        terms = [behind[i + 1]]
        for number in by_start.get(i, ()):
            base = behind[found[number][1]]
            terms += [base + s for s in scores[number]]
        behind[i] = _log_sum(terms)
    total = ahead[-1]
    for number, (i, j, features) in enumerate(found):
        base = ahead[i] + behind[j] - total
        for kind in range(len(KINDS)):
            observed = (borders[i], borders[j], kind) in gold
            into[kind, features] += observed - math.exp(base + scores[number][kind])


def train(labelled: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (kinds x features) from regions with their gold spans."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    lattices = []
    for turn, (text, spans) in enumerate(labelled):
        text, spans = _variants(text, spans, turn)
        borders, found = segments(text, 0, len(text))
        if found:
            gold = {(start, end, KINDS.index(kind)) for kind, start, end in spans}
            lattices.append((borders, found, gold))
    squares = np.full_like(weights, 1e-6)
    for _ in range(epochs):
        for part in range(0, len(lattices), 20):
            gradient = -0.01 * weights
            for borders, found, gold in lattices[part : part + 20]:
                _gradient(borders, found, gold, weights, gradient)
            squares += gradient * gradient
            weights += 0.5 * gradient / np.sqrt(squares)
    return weights


def training_regions(documents: DataFrame, bound: int = TRAIN_REGIONS) -> list[tuple[str, list[Span]]]:
    """At most ``bound`` different regions of moderate length with the patterns' labels.

    They are chosen by a hash of the region over all documents: half from regions without a label and
    an eighth from those that begin with each kind, whatever the order of rows and the copies of a region.
    """

    def function(batch):
        out = {"region": [], "kind": []}
        for text in texts(batch):
            for low, high in regions(text):
                region = text[low:high]
                if len(region) <= MAX_REGION:
                    spans = base_spans(region)
                    out["region"].append(region)
                    out["kind"].append(spans[0][0] if spans else "")
        yield out

    found = map_batches(
        documents.select("text").where(F.col("text").rlike("[0-9@]")), function, "region string, kind string"
    ).distinct()
    # Spark limits the ranks of a kind in each task before it shuffles them
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("region"), "region"))
    chosen = (
        found.withColumn("place", place)
        .where(F.col("place") <= bound // 2)
        .where((F.col("kind") == "") | (F.col("place") <= bound // (2 * len(KINDS))))
        .collect()
    )
    chosen.sort(key=lambda r: (r.place, r.kind))
    return [(r.region, base_spans(r.region)) for r in chosen]


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with the field's additions, by kind, then place."""
    base = base_spans(text)
    taken = sorted((start, end) for _, start, end in base)
    added, at = [], 0
    for low, high in regions(text):
        while at < len(taken) and taken[at][1] <= low:
            at += 1
        stop = at
        while stop < len(taken) and taken[stop][0] < high:
            stop += 1
        near = taken[at:stop]
        for span in decode(text, low, high, weights):
            if not any(s < span[2] and span[1] < e for s, e in near):
                added.append(span)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=order), sorted(base + added, key=order)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(documents: DataFrame, bound: int = TRAIN_REGIONS) -> DataFrame:
    """Per document row: counts of the base kinds, digest of the base spans, all spans."""
    weights = train(training_regions(documents, bound))

    def function(batch):
        out: dict = {part.split(" ")[0]: [] for part in SCHEMA.split(", ")[:7]}
        out |= {"doc_id": batch.column(0), "found": []}
        for text in texts(batch):
            base, every = all_spans(text, weights)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
            out["found"].append([dict(zip(("kind", "start", "end"), s)) for s in every])
        yield out

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(source, function, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_documents(documents: DataFrame, bound: int = TRAIN_REGIONS) -> DataFrame:
    """``documents`` with personal data replaced in ``text``; n_chars, where present, follows."""
    import pyarrow as pa

    weights = train(training_regions(documents, bound))
    place = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            changed = []
            for value in batch.column(place):
                text = value.as_py()
                spans = all_spans(text, weights)[1] if text else []
                changed.append(masked(text, spans) if spans else text)
            column = pa.array(changed, type=batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), column)

    result = map_arrow(documents, run, documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        result = result.withColumn(
            "n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind)
        )
    return result
