"""The quality cascade against the rules one by one, and its base features against plain code."""

import random
import re
from collections import Counter

from packlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé", k=rng.randrange(1, 9)))
    out = [None, "", " \n\t", "one", "é " * 30, "a b c d e f g h " * 2 + "x", "\n".join(["same line of words here"] * 9)]
    for k in range(60):
        words = [word() for _ in range(rng.randrange(1, 150))]
        if k % 3 == 0:
            words += words[: rng.randrange(len(words) + 1)]
        if k % 5 == 0:
            words = [w + rng.choice(["###", "$$", "|"]) for w in words]
        if k % 7 == 0:
            words = [w.upper() + "!!" for w in words]
        out.append(rng.choice([" ", "\n", "\x0b"]).join(words))
    return out + ["w " * 3 + "tail " * 200_000]


def test_features_and_verdicts(spark):
    rows = [(k if k else None, t, True, "x") for k, t in enumerate(texts())] + [(5, texts()[5], True, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, rejected_by string")
    got = quality.cascade(docs, features=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, text, _, _ in rows:
        r = by[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text)
        rejecting = {x.name for x in quality.RULES if x.rejects(quality.Doc(text.encode() if text else None))}
        assert r.kept == (not rejecting) and (r.kept or r.rejected_by in rejecting) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 5
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.cascade(docs.limit(0)).count() == 0


def test_cheap_and_selective_rules_go_first():
    rules = tuple(quality.Rule(n, lambda d: False) for n in ("slow", "fast", "useless", "strict"))
    ordered = quality.order_rules(rules, [(10.0, 10, 100), (0.1, 10, 100), (0.1, 0, 100), (10.0, 90, 100)])
    assert [r.name for r in ordered] == ["fast", "strict", "useless", "slow"]


def test_a_rejected_document_meets_no_further_rule(spark):
    def fails(doc):
        raise AssertionError("not reached")

    rules = (quality.Rule("all", lambda d: True), quality.Rule("never", lambda d: False))
    docs = spark.createDataFrame([(k, "some words") for k in range(10)], "doc_id long, text string")
    ordered = quality.order_rules(rules, quality.measure(docs, rules))
    assert [r.name for r in ordered] == ["all", "never"]
    doc = quality.Doc(b"x")
    assert next(r.name for r in (ordered[0], quality.Rule("bad", fails)) if r.rejects(doc)) == "all"


def test_shouting_is_about_all_scripts():
    shouting = {r.name: r for r in quality.RULES}["shouting"].rejects
    clean = ["страны НАТО и формат A4", "το NATO και η χώρα", "नाटो NATO के सदस्य देश और उनके लोग", "나토 A4 회원국", "دول NATO والعالم كله", "plain NATO text here", "12 !?", ""]
    loud = ["КУПИ СЕЙЧАС", "ΑΓΟΡΑΣΕ ΤΩΡΑ", "BUY NOW", "ÉTÉ à"]
    assert not any(shouting(quality.Doc(t.encode())) for t in clean)
    assert all(shouting(quality.Doc(t.encode())) for t in loud)
