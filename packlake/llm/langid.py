"""Language identification: one byte-context tree for each language, and the shortest code wins.

The trees have their own contexts, all that were seen, and their own escape probabilities. Tasks look up
frequent grams, which have a value for each language; the other grams of a text get theirs by a shuffled
join. How many are looked up depends on the number of languages, what their values are does not.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm import ppm
from packlake.llm.common import utf8
from packlake.session import staged

ORDER = 3
#: Values (grams and languages) that are looked up in the tasks, at most; the others are joined.
TABLE_VALUES = 1 << 24
UNKNOWN = "und"
MAYBE_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
SURE_LETTER = re.compile(rb"[A-Za-z]")


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over the rows that have a `text` and a `lang`."""

    def run(batches):
        held: dict[str, ppm.GramCounter] = {}

        def rows():
            for lang, counter in held.items():
                grams, n = counter.take()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())],
                    ["lang", "gram", "n"],
                )

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                held.setdefault(lang, ppm.GramCounter(order)).add(own)
            if sum(c.held for c in held.values()) > ppm.HELD_GRAMS:
                yield from rows()
        yield from rows()

    return (
        texts.select("lang", "text")
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(run, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def overlay(trees: list[tuple[ppm.Walk, np.ndarray]], order: int) -> tuple[ppm.Walk, np.ndarray]:
    """One trie with the contexts of all trees, and a table of nodes by codes by trees."""
    symbols = np.unique(np.concatenate([np.flatnonzero(w.code[: ppm.SYMBOLS + 1] < w.child.shape[1] - 2) for w, _ in trees]))
    width = len(symbols) + 2
    code = np.full(ppm.SYMBOLS + 1, len(symbols), np.int64)
    code[symbols] = np.arange(len(symbols))
    code[ppm.START] = width - 1
    columns = [np.append(w.code[symbols], [w.child.shape[1] - 2, w.child.shape[1] - 1]) for w, _ in trees]
    nodes: list[list[int]] = [[0] * len(trees), [1] * len(trees)]  # what each is in the trees
    child = [np.zeros(width, np.int32), np.zeros(width, np.int32)]
    level = [(1, tuple(1 for _ in trees))]  # node, and its exact place in each tree or 0
    for _ in range(order):
        following = []
        for node, exact in level:
            into = np.array([w.child[at][columns[t]] for t, ((w, _), at) in enumerate(zip(trees, exact, strict=True))])
            for near in np.flatnonzero(into.any(0)):
                if near == width - 2:  # symbols that no training text has
                    continue
                place = tuple(into[:, near].tolist())
                child[node][near] = len(nodes)
                following.append((len(nodes), place))
                nodes.append([p or q for p, q in zip(place, nodes[node], strict=True)])
                child.append(np.zeros(width, np.int32))
        level = following
    at = np.array(nodes)
    table = np.stack([t[at[:, k]][:, columns[k]] for k, (_, t) in enumerate(trees)], axis=2)
    return ppm.Walk(order, code, np.array(child)), np.ascontiguousarray(table)


def has_letter(text: bytes) -> bool:
    if SURE_LETTER.search(text):
        return True
    return bool(MAYBE_LETTER.search(text)) and any(map(str.isalpha, text.decode()))


def train(texts: DataFrame, order: int = ORDER) -> tuple[list[str], ppm.Model | None, tuple[np.ndarray, np.ndarray] | None]:
    """The languages in order of name, their trees, and the frequent grams with their values.

    `texts` has lang and text.
    """
    found = staged(counts(texts, order), "grams")
    langs = sorted(r[0] for r in found.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return [], None, None
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    grams = found.select(number.alias("model"), "gram", "n")
    model = ppm.model_of(grams, order, len(langs))
    return langs, model, model.lookup(ppm.frequent_grams(grams, max(1, TABLE_VALUES // len(langs))))


def identify(
    docs: DataFrame, langs: list[str], model: ppm.Model | None, frequent: tuple[np.ndarray, np.ndarray] | None
) -> DataFrame:
    """doc_id, lang_pred, score for each row of `docs`; reads `doc_id` and `text` only.

    The score is the share of the winner's probability among those of all languages. A null text, one
    without letters and any text when no language was learned is `und`, with the score 0. Of equal
    code lengths the first name wins. Repeated rows are judged one by one, a null id stays null.
    """
    docs = docs.select("doc_id", "text")
    if not langs:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    order = model.order
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        keys, values = sent.value
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = utf8(batch, "text")
            n = len(texts)
            real = [k for k, text in enumerate(texts) if text is not None and has_letter(text)]
            logs, owner, gram, times = ppm.look_up([texts[k] for k in real], order, keys, values)
            rows: list[list[float] | None] = [None] * n
            for k, own in zip(real, logs.tolist(), strict=True):
                rows[k] = own
            g = len(gram)
            owner = np.array(real, np.int64)[owner] if g else owner
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.arange(number, number + n), number + owner])),
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(g, batch.column("doc_id").type)]),
                    pa.concat_arrays([pa.array(rows, kind), pa.nulls(g, kind)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(gram)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times)]),
                ],
                ["row", "doc_id", "logs", "gram", "times"],
            )
            number += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = staged(docs.mapInArrow(run, f"row long, doc_id {kind}, logs array<double>, gram long, times long"), "scores")
    rare = both.where("gram IS NOT NULL").select("row", "gram", "times")
    values = model.values(rare.select("gram").distinct())
    each = rare.join(values, "gram").groupBy("row", "model").agg(F.sum(F.col("times") * F.col("value")).alias("value"))
    # A row for each language.
    rest = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("model", "value"))).alias("rest"))
    logs = F.zip_with("logs", "rest", lambda sure, x: sure + F.coalesce(x["value"], F.lit(0.0)))
    logs = F.when(F.col("rest").isNull(), F.col("logs")).otherwise(logs)
    scored = both.where("gram IS NULL").select("row", "doc_id", "logs").join(rest, "row", "left").select("doc_id", logs.alias("logs"))
    best = F.array_max("logs")
    share = F.aggregate("logs", F.lit(0.0), lambda sum_, x: sum_ + F.pow(F.lit(10.0), F.greatest(x - best, F.lit(-300.0))))
    name = F.get(F.array(*map(F.lit, langs)), F.array_position("logs", best).cast("int") - 1)
    known = F.col("logs").isNotNull()
    return scored.select(
        "doc_id",
        F.when(known, name).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / share).otherwise(0.0).alias("score"),
    )
