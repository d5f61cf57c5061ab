"""Near-duplicate groups and components against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from packlake.llm import neardup
from packlake.llm.components import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(rows, size, percent):
    """{(doc_id, text): (n, component)} by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            places[x].append(k)
    first = {}
    for k, (d, _) in enumerate(rows):
        if d is None or not sets[k]:
            continue
        root[find(k)] = find(first.setdefault(d, k))
        common = defaultdict(int)
        for x in sets[k]:
            for j in places[x]:
                if j < k and rows[j][0] is not None:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[k]) + len(sets[j]) - c):
                root[find(k)] = find(j)
    smallest = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(k)] = min(d, smallest.get(find(k), d))
    return sorted(((d, len(s), None if d is None else smallest[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(spark, rows, size=4, percent=80):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, key string, n int")
    found = neardup.groups(docs, size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(30, 200))]
        texts.append(base)
        for _ in range(rng.randrange(copies)):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_edge_cases(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "A b"), (5, "a  B"), (4, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (2, "x y z"), (2, "p q"), (1, "P Q"), (0, "p q")]
    check(spark, rows)
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, size):
    check(spark, corpus(seed, 40, 12, 10), size)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = corpus(3, 1, 2, 1)[:1]
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(120)] = f"x{k}-{rng.randrange(10)}"
        rows.append((k + 10, " ".join(copy)))
    rows += [(1000 + k, " ".join(base)) for k in range(150)]
    check(spark, rows)


def test_sequential_comparison_keeps_links():
    needed = neardup.least_matches(80, 240)
    assert needed[-1][0] == 240 and all(k / m < 0.75 for m, k in needed)
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, (20_000, 240), np.uint8)
    for s, low, high in ((0.8, 1.0, 1.0), (0.3, 0, 0.001)):
        other = np.where(rng.random(same.shape) < s, same, rng.integers(0, 256, same.shape, np.uint8)).astype(np.uint8)
        kept = len(neardup.plausible(same, other, np.arange(20_000), np.arange(20_000), needed)) / 20_000
        assert low <= kept <= high


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 7)] + [(5, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for node, component in found.items():
        assert component == find(node)
    assert {a for a, b in links if a != b and find(a) != a} <= set(found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_loses_no_other_row(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None), (1, ""), (1, " "), (2, "text A of some words"), (2, "other text B of other words"), (3, "c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    kept = neardup.keep_first(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(rows, key=str) and kept.columns == docs.columns
    more = [(4, text), (5, text), (5, " "), (5, text.upper()), (6, "alone here in this text"), (6, "ALONE here in this text"), (6, "alone here in this text")]
    more += [(None, text), (None, text), (7, text + " more"), (7, "something else altogether in these words")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in neardup.keep_first(docs).collect()), key=str)
    # 5 and 7 are in the group of 4, but 5 has a row without words; 6 is one text in two spellings.
    chosen = min(("alone here in this text", "ALONE here in this text"), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert got == sorted(rows + [(4, text), (5, " "), (6, chosen), (None, text), (None, text)], key=str)
    assert neardup.keep_first(docs.limit(0)).count() == 0


def test_keep_first_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    test_keep_first_loses_no_other_row(spark)


def test_long_texts(spark):
    base = [f"w{k % 5000}-{k // 7}" for k in range(60_000)]
    other = list(base)
    for k in range(0, 60_000, 1000):
        other[k] = "changed"
    check(spark, [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:30_000]))])
