"""Embedding near-dedup, filter audit and source divergence against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import embedding_dedup, source_divergence
from ledgerline.llm.embedding_dedup import forest, near_vectors, table_settings
from ledgerline.llm.filter_audit import FILTERS, audit_filters, coalition_removals, shapley_values
from ledgerline.llm.source_divergence import Forest, divergence, divergences, shares

VECTORS = "vec_id long, embedding array<float>, label int, digest string, core int"


def brute_vectors(rows, similar=0.9):
    """(vec_id, n_links, component_id, kept) per row from all pairs."""
    vectors = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors.append(np.array(v, dtype=np.float32).astype(float) if good else None)
    size = len(rows)
    near = [set() for _ in rows]
    for i in range(size):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= similar:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    for i in range(size):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(map(key, seen))
        component = None if least[0] else least[1]
        out.append((rows[i][0], len(near[i]), component, key(i) == least))
    return sorted(out, key=repr)


def near(rng, centre, degrees):
    """A vector at the given angle from a centre."""
    side = rng.standard_normal(len(centre))
    side -= centre * (side @ centre) / (centre @ centre)
    angle = math.radians(degrees)
    unit = centre / np.linalg.norm(centre)
    return [float(x) for x in math.cos(angle) * unit + math.sin(angle) * side / np.linalg.norm(side)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], VECTORS)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_vectors_with_awkward_rows(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    base = near(rng, centre, 5)
    rows = [
        (9, base),
        (9, base),
        (4, [3 * x for x in base]),
        (None, base),
        (None, [-x for x in base]),
        (None, None),
        (1, []),
        (2, [0.0] * 16),
        (3, [float("nan")] + base[1:]),
        (5, [float("inf")] + base[1:]),
        (6, [None] + base[1:]),
        (7, base[:8]),
        (8, [x * 1e-30 for x in base]),
    ]
    rows += [(20 + k, near(rng, centre, 12)) for k in range(30)]
    assert result(near_vectors(frame_of(spark, rows))) == brute_vectors(rows)
    assert near_vectors(frame_of(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("block", [16, 5000])
def test_dense_groups_in_blocks_equal_brute_force(spark, monkeypatch, block):
    """Tight cores, loose groups around the threshold and strangers; blocks far smaller than groups."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "RECALL", 1 - 1e-9)
    monkeypatch.setattr(embedding_dedup, "CLASS_ROWS", 5)
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for degrees, size in ((6, 150), (11, 60), (18, 60), (30, 40)):
        centre = rng.standard_normal(24)
        rows += [(k + n, near(rng, centre, degrees)) for n in range(size)]
        k += size
    rows += [(k + n, [float(x) for x in rng.standard_normal(24)]) for n in range(120)]
    rows += [(900 + n, rows[0][1]) for n in range(12)]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    assert result(near_vectors(frame_of(spark, rows))) == brute_vectors(rows)


def test_recall_at_the_threshold(spark):
    """2,000 pairs with a cosine of 0.9 to 0.91 among strangers: at least 0.99 of them are found."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(2000):
        centre = rng.standard_normal(48)
        rows.append((2 * k, [float(x) for x in centre]))
        rows.append((2 * k + 1, near(rng, centre, 25.0 + 0.8 * rng.random())))
    found = near_vectors(frame_of(spark, rows)).where("n_links > 0").count()
    assert found >= 0.99 * 4000


def test_tables_keep_their_recall():
    for classes in (1, 1000, 10**6, 10**9, 10**12):
        bits, tables = table_settings(classes)
        meet = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= embedding_dedup.RECALL


def test_forest_names_the_first_row():
    linked = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 2), (2, 4), (3, 5)):
        linked[a, b] = linked[b, a] = True
    assert forest(linked).tolist() == [0, 1, 0, 3, 0, 3]


# filters


def fails(text, doc, smallest):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search("[#$%&*|]", text)),
        doc > smallest[text],
    )


def brute_audit(rows, labels):
    """Every order applied to every document, one filter after the other."""
    key = lambda d: (d is None, d or 0)
    smallest = {}
    for doc, text, _ in rows:
        smallest[text or ""] = min(smallest.get(text or "", key(doc)), key(doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, lang in rows:
        failed = fails(text or "", key(doc), smallest)
        parts[lang or ""].append((failed, doc in good, doc in toxic))
    out = []
    for part, docs in parts.items():
        steps, shapley = [], Counter()
        for order in permutations(range(5)):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                redundant = sum(d[0][f] for d in docs) - len(gone)
                alone = sum(d[0][f] and sum(d[0]) == 1 for d in docs)
                lost = [sum(d[k] for d in gone) for k in (1, 2)]
                steps.append((order, f, step, len(left), len(gone), redundant, alone, *lost))
        for order, f, *rest in steps:
            out.append((part, "".join(FILTERS[i] for i in order), *rest, shapley[f]))
    return sorted(out)


def filter_rows():
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(400)]
    rows = []
    for doc in range(150):
        size = rng.choice([0, 20, 99, 100, 101, 150, 160])
        words = rng.choices(pool[: rng.choice([60, 120, 400])], k=size)
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|"))
        rows.append((doc, rng.choice(" \t\n").join(words), rng.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k % 7][1], "fr") for k in range(20)]
    rows += [(3, rows[3][1], "en"), (None, rows[5][1], "en"), (None, None, None), (None, "é" * 9 + "A", "en")]
    labels = [(d, rng.randint(0, 1), rng.randint(0, 1)) for d in range(0, 220, 2)]
    labels += [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    return rows, labels


def test_audit_equals_all_orders(spark):
    rows, labels = filter_rows()
    docs = spark.createDataFrame(
        [(d, t, lang, 1, "x") for d, t, lang in rows],
        "doc_id long, text string, lang string, mask int, digest string",
    )
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert result(audit_filters(docs, marks)) == sorted(brute_audit(rows, labels), key=repr)
    assert audit_filters(docs.where("false"), marks).count() == 0
    without = audit_filters(docs, marks.where("false"))
    assert without.agg({"good_lost": "sum", "toxic_lost": "sum", "*": "count"}).first()[0] in (0, 600 * 5, 600 * 4)


def test_least_squares_are_the_shapley_values():
    """The regression gives the mean marginal over all orders, also for games without structure."""
    rng = random.Random(2)
    for _ in range(5):
        game = [0] + [rng.randint(0, 50) for _ in range(31)]
        exact = [Fraction(0)] * 5
        for order in permutations(range(5)):
            before = 0
            for i in order:
                exact[i] += Fraction(game[before | 1 << i] - game[before], 120)
                before |= 1 << i
        assert shapley_values(game) == exact
    assert coalition_removals([1, 2, 3, 4]) == [0, 6, 7, 9]


# sources


def brute_divergence(rows):
    terms = lambda t: [
        "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
        for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
    ]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = terms(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)

        def p_of(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q = p_of(whole)
        p = {s: p_of(counts[lang, s]) for s in sources}
        for s in sources:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            foremost = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", foremost)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                ordered = ordered[:200] if part == "term" else ordered
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ordered, 1)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(6)
    pool = [f"{a}{b}{c}" for a in "abcdeé" for b in "xyzñ" for c in "klmnop"]
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "de", "", None])
        source = rng.choice(["s1", "s2", "s3", "é", "", None])
        words = rng.choices(pool[: rng.choice([10, 60, 140])], k=rng.randint(0, 80))
        rows.append((rng.choice([" ", "1", "-", "\n"]).join(words).replace("a", rng.choice("aA")), lang, source))
    rows += [("only one here", "fr", "s1"), ("nothing kept", "fr", "s2"), (None, "fr", "s3"), ("1 2 3", "it", "s1")]
    rows += [rows[0]] * 3
    return rows


@pytest.mark.parametrize("block,tile,held", [(4096, 64, 200_000), (8, 2, 50)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, tile, held):
    monkeypatch.setattr(source_divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(source_divergence, "TILE_GROUPS", tile)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", held)
    rows = divergence_rows()
    docs = spark.createDataFrame(
        [(t, lang, s, 1, "x") for t, lang, s in rows],
        "text string, lang string, source string, term int, item string",
    )
    assert result(divergence(docs)) == sorted(brute_divergence(rows), key=repr)
    assert divergence(docs.where("false")).count() == 0


def sent_counts(spark, monkeypatch, batch):
    """What a task sends on for one batch of documents."""
    taken = []

    def take(frame, function, schema):
        taken.append(function)
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(source_divergence, "map_batches", take)
    source_divergence.term_counts(spark.createDataFrame([], "text string, lang string, source string"))
    names = ("lang", "source", "term", "n", "docs")
    plain = lambda column: column.to_pylist() if isinstance(column, pa.Array) else column
    return [row for out in taken[0](batch) for row in zip(*(plain(out[name]) for name in names))]


def test_a_batch_sends_each_term_once(spark, monkeypatch):
    text = " ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100))
    rows = {"lang": ["en"] * 3000, "source": ["a", "b", "c"] * 1000, "text": [text] * 3000}
    sent = sent_counts(spark, monkeypatch, pa.RecordBatch.from_pydict(rows))
    assert len(sent) == 3 * 100 + 3
    assert {row[3:] for row in sent} == {(1000, 1000), (0, 0)}


@pytest.mark.parametrize("held", [1, 50, 10**6])
def test_batch_counts_equal_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(source_divergence, "HELD_TERMS", held)
    rows = divergence_rows() + [("", "en", "s1"), (" \n ", "en", "s2"), ("\u00a0x\u3000É é\0A", "xx", "é")]
    texts, langs, sources = (list(column) for column in zip(*rows))
    batch = pa.RecordBatch.from_pydict({"lang": langs, "source": sources, "text": texts})
    n, docs = Counter(), Counter()
    for lang, source, term, times, within in sent_counts(spark, monkeypatch, batch.slice(5)):
        n[lang, source, term] += times
        docs[lang, source, term] += within
    expected, expected_docs = Counter(), Counter()
    for text, lang, source in rows[5:]:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        expected.update((lang or "", source or "", t) for t in found)
        expected_docs.update((lang or "", source or "", t) for t in set(found))
        expected[lang or "", source or "", None] += 0
        expected_docs[lang or "", source or "", None] += 0
    assert dict(n) == dict(expected) and dict(docs) == dict(expected_docs)


def test_counts_and_vocabulary_take_one_shuffle(spark, monkeypatch):
    frames = []
    keep = source_divergence.stored
    monkeypatch.setattr(source_divergence, "stored", lambda frame: frames.append(frame) or keep(frame))
    divergence(spark.createDataFrame(divergence_rows(), "text string, lang string, source string"))
    wide = [frame for frame in frames if "term" in frame.columns]
    plans = [frame._jdf.queryExecution().sparkPlan().toString() for frame in wide]
    executed = [frame._jdf.queryExecution().executedPlan().toString() for frame in wide]
    assert len(wide) == 1 and not any("Join" in plan for plan in plans)
    assert sum(plan.count("Exchange ") for plan in executed) == 1


def test_term_ranks_stop_at_200(spark):
    docs = [(" ".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "en", "a")] * 3
    docs += [("other words " * 200, "en", "b")] * 3
    found = divergence(spark.createDataFrame(docs, "text string, lang string, source string"))
    assert result(found) == sorted(brute_divergence(docs), key=repr)
    assert found.where("part = 'term' and source = 'a'").count() == 200


def test_equal_subtrees_are_one_node():
    rows = np.array([[0, 0, 1, 2, 0, 0, 1, 2], [0, 0, 1, 2, 0, 0, 0, 0], [5, 0, 1, 2, 0, 0, 1, 2]])
    found = Forest(rows)
    assert [len(level) for level in found.levels] == [4, 3, 3, 3]
    at, a, b, times = found.leaf_pairs(0, np.array([1]))
    assert sorted(zip(found.levels[0][a], found.levels[0][b], times)) == [
        (0, 0, 4), (1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 2, 1)
    ]


def test_shares_are_exact_for_huge_counts():
    counts = np.array([0, 10**12, 3 * 10**12])
    divisor = 4 * 10**12 + 7
    assert shares(counts, divisor).tolist() == [1 + 10**9 * (int(c) + 1) // divisor for c in counts]
    table = [1 + 10**9 * (int(c) + 1) // divisor for c in counts]
    other = [1 + 10**9 * (c + 1) // 50 for c in (1, 2, 30)]
    expected = sum((p - q) ** 2 // q for p, q in zip(table, other))
    rows = np.array([counts, [1, 2, 30]])
    assert divergences(rows, [divisor, 50], [(0, 1)])[0][0] == expected
