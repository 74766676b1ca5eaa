"""Substring, suffix and SimHash dedup against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from ledgerline.llm import near_texts, simhash, superstrings
from ledgerline.llm.components import components
from ledgerline.llm.simhash import anchors_of, fingerprint_of, near_duplicates, one_of_each_group
from ledgerline.llm.substring_dedup import dedup_substrings
from ledgerline.llm.suffix_arrays import Shard
from ledgerline.llm.suffix_dedup import dedup_suffixes


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


def digest(data):
    return hashlib.sha256(data).hexdigest()


def brute_substrings(rows, size=13):
    first = {}
    key = lambda d: (d is None, d or 0)
    for doc, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            first[window] = min(first.get(window, key(doc)), key(doc))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < key(doc):
                gone.update(range(k, k + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), digest(kept)))
    return sorted(out, key=repr)


def brute_suffixes(rows, size):
    texts = [(text or "").encode() for _, text in rows]
    counts = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for (doc, _), text in zip(rows, texts):
        gone = np.zeros(len(text), dtype=bool)
        for k in range(len(text) - size + 1):
            if counts[text[k : k + size]] > 1:
                gone[k : k + size] = True
        runs = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((doc, len(text), int(gone.sum()), runs, digest(kept)))
    return sorted(out, key=repr)


def generated(spark, seed):
    """Texts of few words, so that windows repeat in many ways, with hot copies."""
    rng = random.Random(seed)
    phrases = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    rows = []
    for doc in range(120):
        words = [w for _ in range(rng.randrange(4)) for w in rng.choice(phrases)]
        words += [f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))]
        rows.append((rng.choice([doc, doc, doc, None]), rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200 + k, " ".join(phrases[0] * 2)) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    docs = generated(spark, seed)
    found = dedup_substrings(docs).drop("kept_text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_substrings(rows_of(docs))


def test_substrings_awkward(awkward, nothing):
    found = dedup_substrings(awkward).drop("kept_text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_substrings(rows_of(awkward))
    assert dedup_substrings(nothing).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 21, 400])
def test_suffixes_match_brute_force(spark, awkward, shard_bytes):
    for docs in (generated(spark, 3), awkward):
        found = dedup_suffixes(docs, shard_bytes=shard_bytes).drop("kept_bytes").collect()
        assert sorted((tuple(r) for r in found), key=repr) == brute_suffixes(rows_of(docs), 200)


def test_suffixes_of_nothing(nothing):
    assert dedup_suffixes(nothing).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(60):
        depth = rng.choice([1, 3, 9, 20])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(6)]
        shard = Shard(texts, depth)
        whole = b"".join(texts)
        suffixes = sorted((whole[k : shard.stop[k]], k) for k in range(len(whole)))
        assert shard.order.tolist() == [k for _, k in suffixes]
        for at in range(1, len(suffixes)):
            left, right = suffixes[at - 1][0], suffixes[at][0]
            common = 0
            while common < min(len(left), len(right), depth) and left[common] == right[common]:
                common += 1
            assert shard.common[at] == common


def test_fingerprint_is_the_majority_of_shingle_bits():
    for text in ("", "one", "One Two", "a B c d e a b c", "é à ü é à ü x"):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert fingerprint_of(text) == (bits if hashes else 0)


def test_linked_fingerprints_share_an_anchor():
    rng = np.random.default_rng(7)
    for _ in range(100):
        one = int(rng.integers(0, 1 << 63))
        two = one
        for bit in rng.choice(64, int(rng.integers(0, 3)), replace=False):
            two ^= 1 << int(bit)
        left, right = anchors_of(np.array([one, two], dtype=np.uint64))
        assert set(left) & set(right)


def brute_components(rows):
    fps = [fingerprint_of(text or "") for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(doc)
    name = {r: min((d for d in docs if d is not None), default=None) for r, docs in ids.items()}
    return sorted(((doc, f"{fps[k]:016x}", name[find(k)]) for k, (doc, _) in enumerate(rows)), key=repr)


def test_near_duplicates_match_brute_force(spark, awkward, nothing):
    base = " ".join(f"t{n * n % 1000}" for n in range(900))
    words = base.split()
    rows = [(k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in range(0, 900, 15)]
    rows += [(1000 + k, base) for k in range(30)] + [(2000 + k, f"other {k} text") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, awkward):
        found = sorted((tuple(r) for r in near_duplicates(frame).collect()), key=repr)
        assert found == brute_components(rows_of(frame))
    assert near_duplicates(nothing).count() == 0


def test_one_of_each_group(awkward, nothing):
    kept = one_of_each_group(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids
    assert one_of_each_group(nothing).count() == 0


@pytest.mark.parametrize("full", [64, 8])
def test_edited_copies_leave_one_of_each_group(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)
    rng = random.Random(12)
    rows, ids = [], iter(range(10_000))
    for origin in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 400]))]
        rows.append((next(ids), " ".join(words)))
        for copy in range(3 if origin else 60):
            edited = list(words)
            for _ in range(1 + len(words) // 100):  # up to five shingles each way for each word
                edited[rng.randrange(len(words))] = f"e{copy}"
            rows.append((next(ids), " ".join(edited)))
        rows.append((next(ids), " ".join(words[: len(words) // 2] + [f"o{rng.random()}" for _ in words])))
    sets = {key: simhash.shingles_of(text.encode()) for key, text in rows}
    root = {key: key for key in sets}
    far = 0
    for a, b in combinations(sets, 2):
        if simhash.similarity(sets[a], sets[b]) >= 0.8:
            far += (simhash.fingerprint_of(rows[a][1]) ^ simhash.fingerprint_of(rows[b][1])).bit_count() > 2
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {key: new if r == old else r for key, r in root.items()}
    assert far > 100
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.values()))


@pytest.mark.parametrize("block", [1024, 60])
def test_pairs_in_a_band_that_all_texts_share(spark, monkeypatch, block):
    """Similarity 0.828 inside a pair and 0.767 across: all texts meet in large bands, pairs stay apart."""
    monkeypatch.setattr(near_texts, "BLOCK_TEXTS", block)
    common = " ".join(f"c{n}" for n in range(300))
    rows = []
    for pair in range(300):
        joint = " ".join(f"j{pair}x{n}" for n in range(13))
        for side in range(2):
            own = " ".join(f"o{pair}x{side}x{n}" for n in range(32))
            rows.append((2 * pair + side, f"{common} {joint} {own}"))
    left, right, other = (simhash.shingles_of(rows[k][1].encode()) for k in (0, 1, 2))
    assert simhash.similarity(left, right) > 0.82 and 0.76 < simhash.similarity(left, other) < 0.77
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 600, 2))


@pytest.mark.parametrize("single", [True, False])
def test_cell_links_match_brute_force(single):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 90, dtype=np.uint64)
    sets = [np.array([], dtype=np.uint64)] * 2
    for _ in range(80):
        extra = rng.integers(0, 60, rng.integers(0, 14), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[: rng.integers(60, 90)], extra])))
    tag = np.zeros(len(sets), dtype=np.int64) if single else rng.integers(0, 2, len(sets))
    start = rng.integers(0, 30, len(sets))

    def closure(links):
        root = start.copy()
        for a, b in links:
            root[root == root[a]] = root[b]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    pairs = [
        (a, b)
        for a, b in combinations(range(len(sets)), 2)
        if (single or tag[a] != tag[b])
        and simhash.similarity(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8
    ]
    found = near_texts.cell_links(tag, start, sets)
    assert {tuple(sorted(p)) for p in found} <= set(pairs)
    assert closure(found) == closure(pairs)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(k, 0) for k in range(1, 41)} | {(100 + k, 100) for k in range(1, 50)}


def crc_twins():
    """A repeating and a fresh text without id whose crc32 is equal."""
    fresh = " ".join(f"fresh{n}" for n in range(60))
    repeating = " ".join(f"alpha{n} beta{n % 7}" for n in range(40))
    rng = random.Random(1)
    seen = {}
    for _ in range(300_000):
        tail = f"{rng.getrandbits(64):x}"
        seen[zlib.crc32(f"{repeating} {tail}".encode())] = tail
    for _ in range(300_000):
        tail = f"{rng.getrandbits(64):x}"
        if (other := seen.get(zlib.crc32(f"{fresh} {tail}".encode()))) is not None:
            return f"{repeating} {other}", f"{fresh} {tail}", repeating
    raise AssertionError("no twins")


def test_texts_without_id_and_with_equal_crc_do_not_mix(spark):
    left, right, first = crc_twins()
    assert zlib.crc32(left.encode()) == zlib.crc32(right.encode())
    docs = spark.createDataFrame([(1, first), (None, left), (None, right)], "doc_id long, text string")
    found = {(r.doc_id, r.n_words): r.n_removed for r in dedup_substrings(docs).collect()}
    assert found == {(1, 80): 0, (None, 81): 80, (None, 61): 0}
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = sorted((tuple(r) for r in dedup_suffixes(docs).select(*columns).collect()), key=repr)
    assert found == brute_suffixes(rows_of(docs), 200)


def test_cuts_of_repeated_rows_do_not_grow_with_their_number(spark, monkeypatch):
    """Many equal rows of one id: every row gets the cuts once, not once per copy."""
    sizes = []

    for copies in (50, 200):
        text = " ".join(f"w{n}" for n in range(300))
        rows = [(1, text)] + [(2, text)] * copies
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        kept = []
        original = superstrings.with_cuts
        with monkeypatch.context() as patch:
            patch.setattr(superstrings, "with_cuts", lambda *a: kept.append(original(*a)) or kept[-1])
            found = dedup_substrings(docs)
            assert {r.n_removed for r in found.where("doc_id = 2").collect()} == {300}
        lengths = kept[0].selectExpr("coalesce(aggregate(cuts, 0, (s, c) -> s + length(c)), 0) AS n")
        sizes.append(lengths.agg({"n": "max"}).first()[0])
    assert sizes[0] == sizes[1] > 0
