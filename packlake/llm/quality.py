"""Quality rules as a short-circuit cascade.

Each rule looks at one document. On a sample, a rule's cost (seconds a document, with nothing shared)
and its selectivity (share of documents it rejects) are measured; the rules then run in the order of
rejections per cost, and a document leaves the cascade at the first rule that rejects it. The order
changes the work only, never the verdict, so a sample is enough for it.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import column, utf8

# Fixed values.
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30

UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
ASCII = bytes(range(128))
#: Documents on which cost and selectivity are measured, about.
SAMPLE_ROWS = 400


class Doc:
    """One text with its features, each computed when first asked for. Null is the empty text."""

    def __init__(self, text: bytes | None):
        self.raw = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.decode()) - sum(map(self.raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(s) for s in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def other_letters(self) -> list[str]:
        """The letters that are not ASCII."""
        return [] if self.raw.isascii() else [c for c in self.raw.translate(None, ASCII).decode() if c.isalpha()]

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER)) + sum(map(str.isupper, self.other_letters))

    @cached_property
    def n_letters(self) -> int:
        """With those of scripts that have no case."""
        return len(self.raw) - len(self.raw.translate(None, UPPER + LOWER)) + len(self.other_letters)

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of `WINDOW` words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
    if len(known) == len(words):
        return 0
    # Equal windows have equal sums, so texts without equal sums have no repeated window.
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sums = ids[:n].copy()
    for k in range(1, WINDOW):
        sums *= np.uint64(0xD6E8FEB86659FD93)
        sums += ids[k : k + n]
    order = np.sort(sums)
    if not (order[1:] == order[:-1]).any():
        return 0
    count: dict[tuple, int] = defaultdict(int)
    windows = list(zip(*(words[k : k + n] for k in range(WINDOW)), strict=True))
    for window in windows:
        count[window] += 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero([count[window] > 1 for window in windows])
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def base_failed(doc: Doc) -> bool:
    return doc.n_words < MIN_WORDS or 100 * doc.n_repeat_words > REPEATED_PERCENT * doc.n_words


#: The two base rules, and what else marks a text as junk.
RULES = (
    Rule("few_words", lambda d: d.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > REPEATED_PERCENT * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("shouting", lambda d: 2 * d.n_upper > d.n_letters),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("word_length", lambda d: d.word_chars > 40 * d.n_words),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[tuple[float, int, int]]:
    """(seconds, rejected, seen) of each rule over about `sample_rows` documents, taken by hash."""
    total = docs.count()
    every = max(1, total // max(1, sample_rows))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            texts = utf8(batch, "text")
            rows = []
            for k, rule in enumerate(rules):
                start = time.perf_counter()
                rejected = sum(bool(rule.rejects(Doc(text))) for text in texts)
                rows.append((k, time.perf_counter() - start, rejected, len(texts)))
            yield pa.RecordBatch.from_pylist([dict(zip(("rule", "seconds", "rejected", "seen"), r)) for r in rows])

    sums = (
        sample.mapInArrow(run, "rule long, seconds double, rejected long, seen long")
        .groupBy("rule")
        .agg(F.sum("seconds"), F.sum("rejected"), F.sum("seen"))
        .collect()  # a row for each rule
    )
    found = {r[0]: (r[1], r[2], r[3]) for r in sums}
    return [found.get(k, (0.0, 0, 0)) for k in range(len(rules))]


def order_rules(rules: tuple[Rule, ...], measured: list[tuple[float, int, int]]) -> tuple[Rule, ...]:
    """Most rejections per second first; rules that reject nothing last, the cheapest of them first."""

    def key(k: int) -> tuple:
        seconds, rejected, seen = measured[k]
        cost = max(seconds, 1e-9)
        # What rejects nothing in the sample still may: half a document.
        return (-max(rejected, 0.5) / cost, k)

    return tuple(rules[k] for k in sorted(range(len(rules)), key=key))


def cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, features: bool = False
) -> DataFrame:
    """doc_id, kept, rejected_by (the rule that ended it, null if kept) for each row of `docs`.

    Reads `doc_id` and `text` only, so other columns may have any name. A null text is the empty
    text, a null id stays null, repeated rows are judged one by one, no rows give no rows. With
    `features`, the base columns of the document follow; they share the work of the rules.
    """
    docs = docs.select("doc_id", "text")
    ordered = order_rules(rules, measure(docs, rules, sample_rows))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for text in utf8(batch, "text"):
                doc = Doc(text)
                by = next((rule.name for rule in ordered if rule.rejects(doc)), None)
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                if features:
                    for name in base:
                        out[name].append(getattr(doc, name))
                    out["base_failed"].append(base_failed(doc))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "kept": pa.array(out.pop("kept"), pa.bool_()), "rejected_by": pa.array(out.pop("rejected_by"), pa.string())}
                | {k: pa.array(v, pa.bool_() if k == "base_failed" else pa.int64()) for k, v in out.items()}
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept boolean, rejected_by string"
    if features:
        schema += "".join(f", {name} long" for name in base) + ", base_failed boolean"
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs`, with all their columns, that no rule rejects."""
    ordered = order_rules(rules, measure(docs, rules))

    def run(batches):
        for batch in batches:
            kept = [not any(rule.rejects(doc) for rule in ordered) for doc in map(Doc, utf8(batch, "text"))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
