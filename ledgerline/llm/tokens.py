"""Units of text that public tokenizers treat independently, and a cache from unit to ids.

A byte-level tokenizer cuts a text by one published pattern; ``pre_tokens`` applies it, so that its units
are the tokenizer's own pre-tokens. For any other tokenizer a text may be cut before a single blank or line feed that stands between two other characters that
are no white space: the pre-tokenizers in use end a pre-token there, whatever stands around. Cut either
way, the pieces add up to the library's result for the whole text; special strings stay in one piece.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from sys import getsizeof

import numpy as np
import regex

_UNIT = re.compile(r"\s*\S+(?:(?:\s\s+|[^\S \n])\S*)*|\s+")

_tokenizers: dict[str, object] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def units_of(text: str) -> list[str]:
    """Pieces of a text between single blanks; joined they are the text."""
    return _UNIT.findall(text)


#: Unicode white space, and the published pattern of byte-level pre-tokenizers; fixed values.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{digits}+| ?[^{white}{rest}]+|[{white}]+(?![^{white}])|[{white}]+"
)
_PRE_TOKEN = regex.compile(
    _BYTE_LEVEL.format(letters=r"\p{L}", digits=r"\p{N}", rest=r"\p{L}\p{N}", white=_WHITE)
)
#: The same for texts of ASCII characters.
_ASCII_PRE_TOKEN = re.compile(
    _BYTE_LEVEL.format(letters="[A-Za-z]", digits="[0-9]", rest="A-Za-z0-9", white=r"\t-\r ")
)


#: Characters whose class is the same in every Unicode version in use; with others the library cuts the text.
_SETTLED = re.compile(
    "[\0-\u0557\u0590-\u088e\u0900-\u0c5b\u0d00-\u208e\u20a0-\ua7cd\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f]*"
)


def byte_level_pre_tokens(text: str, cutter) -> list[str]:
    """Pre-tokens of a text without special strings; ``cutter`` is the library's own pre-tokenizer."""
    if text.isascii():
        return _ASCII_PRE_TOKEN.findall(text)
    if _SETTLED.fullmatch(text):
        return _PRE_TOKEN.findall(text)
    return [text[start:end] for _, (start, end) in cutter.pre_tokenize_str(text)]


@lru_cache(maxsize=4)
def pre_tokens(path: str):
    """A function from a text to the pieces that the tokenizer of a .json file codes one by one."""
    config = json.loads(tokenizer(path).to_str())
    before = config.get("pre_tokenizer") or {}
    added = config.get("added_tokens") or []
    if (
        before.get("type") != "ByteLevel"
        or not before.get("use_regex")
        or before.get("add_prefix_space")
        or config.get("normalizer")
        or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
    ):
        return units_of
    cutter = tokenizer(path).pre_tokenizer
    special = sorted((x["content"] for x in added), key=len, reverse=True)
    cut = re.compile("(" + ("|".join(map(re.escape, special)) or "(?!)") + ")")

    def function(text: str) -> list[str]:
        parts = cut.split(text)
        found = byte_level_pre_tokens(parts[0], cutter)
        for name, part in zip(parts[1::2], parts[2::2]):
            found.append(name)
            found += byte_level_pre_tokens(part, cutter)
        return found

    return function


def tokenizer(path: str):
    """The library's tokenizer of a .json file, loaded once per worker process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def piece_counts(path: str, units: list[str]) -> np.ndarray:
    """Number of pieces of each unit."""
    coded = tokenizer(path).encode_batch_fast(units, add_special_tokens=False)
    return np.fromiter((len(x.ids) for x in coded), np.int64, len(units))


#: ASCII capitals to small letters.
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A full stop or comma between a small Latin letter and white space.
_STOP = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x9f-\xb6\xb8-\xbf]))([.,])(?=[ \n])")


def folds_words(path: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space, and parts letters from punctuation."""
    config = json.loads(tokenizer(path).to_str())
    normal, before = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    splits = before.get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and splits[0]["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not splits[1].get("add_prefix_space")
    )


def folded_units(text: str) -> list[bytes]:
    """Words of a text for a tokenizer that folds them: fewer different ones than pre-tokens.

    Capitals stay where a special string might stand, since those are matched before lower-casing.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if b"<|" not in raw:
        raw = raw.translate(_SMALL)
    return _STOP.sub(rb" \1", raw).split()


#: Bytes of a cache entry besides the unit and its ids: its place in the dictionary.
_ENTRY = 100


class IdCache:
    """Ids of texts through a cache from unit to ids (little-endian bytes) of bounded size.

    Bytes are bounded too, since a unit without blanks may be a whole text.
    """

    def __init__(self, path: str, limit: int = 1_200_000, limit_bytes: int = 256 << 20):
        self.path, self.limit, self.limit_bytes = path, limit, limit_bytes
        self.known: dict = {}
        self.held = 0
        self.folds = folds_words(path)

    def ids_of(self, text: str) -> bytes:
        units = folded_units(text) if self.folds else units_of(text)
        known = self.known
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            missing = list({u for u in units if u not in known})
        words = [u.decode("utf-8", "surrogatepass") for u in missing] if self.folds else missing
        # units are normalised and split one by one; word_ids tells them apart again
        coded = tokenizer(self.path).encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, dtype="<u4")
        owner = np.array([-1 if w is None else w for w in coded.word_ids], dtype=np.int64)
        edges = np.searchsorted(owner, np.arange(len(missing) + 1)).tolist()
        found = {
            unit: ids[edges[number] : edges[number + 1]].tobytes() for number, unit in enumerate(missing)
        }
        held = self.held + sum(getsizeof(unit) + getsizeof(code) + _ENTRY for unit, code in found.items())
        if len(known) + len(found) <= self.limit and held <= self.limit_bytes:  # once full, common units are known
            known.update(found)
            self.held = held
            return b"".join([known[u] for u in units])
        return b"".join([found[u] if u in found else known[u] for u in units])


@lru_cache(maxsize=2)
def id_cache(path: str) -> IdCache:
    """One cache for each worker process, kept from task to task."""
    return IdCache(path)
