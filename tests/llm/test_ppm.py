"""Byte models against a symbol-by-symbol evaluation of the same trie."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlake.llm import langid, lm_scoring, ppm


def symbols_of(text):
    return list((text or b"").lower()) + [ppm.END]


def before(padded, i, k):
    return tuple(padded[i - j] for j in range(1, k + 1))


def trie_of(texts, order, nodes):
    """Counts by (context, nearest first) of the contexts that are kept."""
    counts, positions = defaultdict(lambda: defaultdict(int)), 0
    for text in texts:
        padded = [ppm.START] * order + symbols_of(text)
        for i in range(order, len(padded)):
            positions += 1
            for k in range(order + 1):
                counts[before(padded, i, k)][padded[i]] += 1
    return {c: dict(s) for c, s in counts.items() if not c or sum(s.values()) * nodes >= positions}


def chance(trie, context, symbol):
    """Escape by escape, with the exclusion of all symbols of the contexts left behind."""
    result, excluded = 1.0, set()
    while context is not None:
        if context in trie:
            own = {s: n for s, n in trie[context].items() if s not in excluded}
            different = len(own) if len(set(trie[context]) | excluded) < ppm.SYMBOLS else 0
            total = sum(own.values()) + different
            if symbol in own:
                return result * own[symbol] / total
            if own:
                result *= different / total
            excluded |= set(own)
        context = context[:-1] if context else None
    return result / (ppm.SYMBOLS - len(excluded))


def log_of(trie, text, order):
    padded = [ppm.START] * order + symbols_of(text)
    return sum(
        math.log10(chance(trie, before(padded, i, order), padded[i]))
        for i in range(order, len(padded))
    )


TRAIN = [b"the cat sat on the mat", b"The CAT ate", "café thé".encode(), b"", b"tttttttt", b"abababab" * 3]
SCORED = [b"the bat", b"", "thé Z!".encode(), b"ababab", b"\xf0\x9f\x98\x80 the", b"T" * 30]


def rows_of(spark, texts, order, nodes):
    found = lm_scoring.counts(spark.createDataFrame([(t.decode(),) for t in texts], "text string"), order)
    return ppm.trie_rows(found.where("gram IS NOT NULL").select("gram", "n"), order, nodes).toPandas()


@pytest.mark.parametrize("order, nodes", [(1, 1000), (3, 1000), (3, 12), (4, 40)])
def test_table_is_the_model(spark, order, nodes):
    rows = rows_of(spark, TRAIN, order, nodes)
    walk, table = ppm.build(rows["k"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy(), order)
    trie = trie_of(TRAIN, order, nodes)
    assert len(table) - 1 == len(trie)
    found = ppm.log_probabilities(SCORED, walk, table)
    assert np.allclose(found, [log_of(trie, t, order) for t in SCORED], rtol=1e-5)
    # All symbols together have probability 1 at each node.
    unseen = ppm.SYMBOLS - (table.shape[1] - 2)
    assert np.allclose((10.0 ** table[1:, :-2]).sum(1) + unseen * 10.0 ** table[1:, -2], 1, atol=1e-4)


def test_long_texts_are_cut_with_their_context(monkeypatch, spark):
    rows = rows_of(spark, TRAIN, 3, 1000)
    walk, table = ppm.build(rows["k"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy(), 3)
    whole = ppm.log_probabilities(SCORED, walk, table)
    monkeypatch.setattr(ppm, "SEGMENT", 4)
    assert np.allclose(ppm.log_probabilities(SCORED, walk, table), whole)


def test_overlay_scores_each_tree(spark):
    order = 3
    french = ["le chat et la souris".encode(), "été le".encode()]
    trees = []
    for texts in (TRAIN, french):
        rows = rows_of(spark, texts, order, 1000)
        trees.append(ppm.build(rows["k"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy(), order))
    walk, table = langid.overlay(trees, order)
    found = ppm.log_probabilities(SCORED, walk, table)
    for k, (own, own_table) in enumerate(trees):
        assert np.allclose(found[:, k], ppm.log_probabilities(SCORED, own, own_table), rtol=1e-5)


def base_of(train, texts, scale=0.1):
    counts = defaultdict(int)
    for t in train:
        for w in [*(t or "").encode().lower().split(), "end"]:
            counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        tokens = [*(t or "").encode().lower().split(), "end"]
        out.append((len(tokens), sum(counts.get(w, 0) > 0 for w in tokens), n, sum(math.log10((counts.get(w, 0) + scale) / (n + scale * (v + 1))) for w in tokens)))
    return out


def test_scores_and_base(spark):
    texts = ["a b a", None, "", "b cé B", "a b a", "zz zz " + "long" * 40, "x y \t\n q"]
    held = [False, False, True, False, False, True, True]
    docs = spark.createDataFrame([(k if k else None, t, h, "clash") for k, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held_out boolean, score string")
    for frequent in (2, 1 << 20):
        got = lm_scoring.score(docs, ~F.col("held_out"), frequent=frequent).collect()
        want = base_of([t for t, h in zip(texts, held) if not h], texts)
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, [None, *range(1, 7)]))
        for r in got:
            tokens, known, n, base = want[r.doc_id or 0]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "ab", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in lm_scoring.score(docs, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(257), rel=1e-5) and got[1].n_known == 0 and got[1].train_tokens == 0
    assert lm_scoring.score(docs.limit(0), F.lit(True)).count() == 0


def test_languages(spark):
    rows = [(1, "the cat is on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model[0] == ["en", "fr"]
    asked = spark.createDataFrame(
        [(1, "the mat", "a"), (2, "la table est", "b"), (3, None, "c"), (4, "", "d"), (5, "12 !?", "e"), (None, "the", "f"), (7, "€", "g")],
        "doc_id long, text string, lang_pred string",
    )
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, *model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, None, 7)] == ["en", "fr", "und", "und", "und", "en", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.identify(asked, *langid.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


@pytest.mark.parametrize("grams", [1, 20, 1 << 22])
def test_scores_are_those_of_the_whole_trie(spark, grams):
    """However many grams are looked up in the tasks, no context is left out."""
    # More than 16,384 positions to a context, so a trie of as many nodes would lack those of the first text.
    train = [*(t.decode() for t in TRAIN), "tab " * 8000]
    asked = [t.decode() for t in SCORED]
    rows = [(k, t, False) for k, t in enumerate(train)] + [(100 + k, t, True) for k, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, ~F.col("held_out"), grams=grams).collect()}
    trie = trie_of([t.encode() for t in train], lm_scoring.ORDER, 1 << 40)
    want = {k: log_of(trie, t.encode(), lm_scoring.ORDER) for k, t, _ in rows}
    assert got == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("values", [1, 1 << 24])
def test_many_languages_keep_their_contexts(spark, monkeypatch, values):
    """With sixty languages, and whatever is looked up in the tasks, each tree is whole."""
    monkeypatch.setattr(langid, "TABLE_VALUES", values)
    words = ["".join(sorted("abcde", key=lambda c: hash_of(k, c))) for k in range(60)]
    train = {f"l{k:02}": f"{w} {w[::-1]} {w}{w}" for k, w in enumerate(words)}
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(train.items())], "doc_id long, text string, lang string")
    asked = [(k, f"{w}{w[::-1]} {w}") for k, w in enumerate(words)] + [(100, "the zebra"), (101, "é")]
    found = langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), *langid.train(docs)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    tries = {lang: trie_of([t.encode()], langid.ORDER, 1 << 40) for lang, t in train.items()}
    for k, text in asked:
        logs = {lang: log_of(trie, text.encode(), langid.ORDER) for lang, trie in tries.items()}
        best = max(logs.values())
        assert logs[got[k][0]] == pytest.approx(best, rel=1e-5)
        assert got[k][1] == pytest.approx(1 / sum(10 ** (x - best) for x in logs.values()), rel=1e-3)


def hash_of(k, c):
    return (k * 7919 + 1) * (ord(c) * ord(c) + 13) % 1009
