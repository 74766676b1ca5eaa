"""Secret scan: fixed patterns plus sliding-window entropy per character class.

Candidate strings are runs of ``MIN_RUN`` or more characters that keys are written in. Inside a
candidate each character class has its own runs, window statistics and threshold: the Shannon entropy
of every window is kept by counts that change by one character in and one out, so the work is linear
in the text. Windows above the threshold join to spans. The allow list suppresses what only looks
random: identifiers in a public form as whole candidates, placeholders with the part between
separators they stand in, alphabets and repeated characters alone. The rest of the candidate is scanned.

Nulls are empty texts without spans. Every row is scanned alone, repeated rows alike; an empty table
gives no rows. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_batches, texts

# The base patterns and their limits.
_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

MIN_RUN = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` are scanned with ``window`` characters; ``bits`` is the least entropy."""

    kind: str
    pattern: re.Pattern
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 20, 3.0),
    CharacterClass("entropy_upper", re.compile(r"[A-Z0-9]+"), 20, 3.4),
    CharacterClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
)

#: What looks random and is none: whole candidates in a public form.
PUBLIC = (
    re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
)
#: Words of placeholders hide the part between separators that they stand in.
PLACEHOLDERS = re.compile(r"(?i)example|placeholder|changeme|your[_-]|dummy|sample")
#: Alphabets and repeated characters hide only themselves.
STRETCHES = (
    re.compile(r"(?i)abcdefghij[k-z]*|0123456789|qwertyuiop"),
    re.compile(r"(.)\1{7,}"),
)
_PART = re.compile(r"[^/_=+-]+")

KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_ORDER = {kind: place for place, kind in enumerate(KINDS)}

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int>>"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns as (kind, start, end)."""
    found = []
    if "=" in text or ":" in text:
        found += [
            ("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST
        ]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def random_runs(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined windows of ``run`` whose entropy is at least ``bits``."""
    if len(run) < window:
        return []
    # entropy = log2(w) - sum(c * log2 c) / w, so only the sum is carried along
    weight = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    most = window * (math.log2(window) - bits) + 1e-9
    spans: list[tuple[int, int]] = []
    for at, letter in enumerate(run):
        if at >= window:
            gone = run[at - window]
            count = counts[gone]
            total += weight[count - 1] - weight[count]
            counts[gone] = count - 1
        count = counts.get(letter, 0)
        total += weight[count + 1] - weight[count]
        counts[letter] = count + 1
        if at >= window - 1 and total <= most:
            start = at - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


def _kinds_of_letters(text: str) -> int:
    return (
        any(c.isdigit() for c in text) + any("a" <= c <= "z" for c in text) + any("A" <= c <= "Z" for c in text)
    )


def _open_pieces(whole: str) -> list[tuple[int, int]]:
    """What of a candidate the allow list leaves to be scanned, as (start, end)."""
    if any(rule.search(whole) for rule in PUBLIC):
        return []
    hidden = [m.span() for rule in STRETCHES for m in rule.finditer(whole)]
    words = [m.span() for m in PLACEHOLDERS.finditer(whole)]
    if words:
        at = 0
        for part in _PART.finditer(whole):
            while at < len(words) and words[at][1] <= part.start():
                at += 1
            if at < len(words) and words[at][0] < part.end():
                hidden.append(part.span())
    pieces, last = [], 0
    for start, end in sorted(hidden):
        if start > last:
            pieces.append((last, start))
        last = max(last, end)
    pieces.append((last, len(whole)))
    return pieces


def entropy_spans(text: str, classes=CLASSES) -> list[tuple[str, int, int]]:
    found = []
    for candidate in _CANDIDATE.finditer(text):
        whole = candidate[0]
        if _kinds_of_letters(whole) < 2:
            continue
        for low, high in _open_pieces(whole):
            if high - low < MIN_RUN:
                continue
            for kind in classes:
                for run in kind.pattern.finditer(whole, low, high):
                    for start, end in random_runs(run[0], kind.window, kind.bits):
                        if _kinds_of_letters(run[0][start:end]) >= 2:
                            base = candidate.start() + run.start()
                            found.append((kind.kind, base + start, base + end))
    return found


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Per document row: counts of the base kinds, digest of the base spans, all spans."""

    def function(batch):
        out: dict = {k.split(" ")[0]: [] for k in SCHEMA.split(", ")[:6]}
        out |= {"doc_id": batch.column(0), "found": []}
        for text in texts(batch):
            place = lambda s: (s[1], _ORDER[s[0]], s[2])
            base = sorted(base_spans(text), key=place)
            every = sorted(base + entropy_spans(text), key=place)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
            out["found"].append([dict(zip(("kind", "start", "end"), s)) for s in every])
        yield out

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(source, function, SCHEMA)
