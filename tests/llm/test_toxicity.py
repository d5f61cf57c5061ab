"""Toxicity from document labels: held-out accuracy, and the sentences that are to blame."""

import random

import pytest

from packlake.llm import toxicity


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    syllables = ["ba", "co", "di", "fu", "ge", "ha", "lo", "mi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    rows = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(1, 12))]
        toxic = int(k % 5 == 0)
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] += " " + rng.choice(["Vilescum", "zzrot" + word()])
        rows.append((k, ". ".join(parts) + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, y) for _, t, y in corpus()])


def test_held_out(spark, model):
    rows = corpus(300, 9)
    docs = spark.createDataFrame([(k, t, 0.0) for k, t, _ in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum((got[k].score >= 0.5) == bool(y) for k, _, y in rows)
    assert right >= 297
    for k, text, y in rows:
        assert 0 <= got[k].score <= 1 and got[k].n_sentences == len([p for p in text.split(".") if p.strip()])
        if y and got[k].score >= 0.5:
            blamed = [text[s.start : s.end] for s in got[k].offending]
            assert any("Vilescum" in b or "zzrot" in b for b in blamed) and len(blamed) == 1


def test_edge_cases(spark, model):
    text = "é " + "harmless bada. " * 3 + "é Vilescum!\n" + "!!! ..."
    rows = [(1, None), (2, ""), (3, " \n."), (None, text), (4, text), (4, text), (5, "codi " * 100_000)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score == 0 and by[5].score < 0.5
    span = by[4].offending[0]
    assert by[4] == by[None].__class__(**{**by[None].asDict(), "doc_id": 4}) or "Vilescum" in text[span.start : span.end]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_training_rows(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (2, None, 9), (3, "c", 9), (None, "d", 9)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (7, 1)], "doc_id long, label int")
    got = sorted(map(tuple, toxicity.training_rows(docs, labels).collect()), key=str)
    assert got == [("a", 1), ("a", 1), (None, 0)]
    assert toxicity.training_rows(docs, labels, 1).count() <= 1


def test_one_label_only():
    assert toxicity.fit([]).weights == {} and toxicity.fit([("a", 0)] * 3).bias < -10
    assert toxicity.fit([("a", 1)] * 3).bias == 0
