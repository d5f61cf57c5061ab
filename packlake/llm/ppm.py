"""Prediction by partial matching over bytes, with frozen statistics.

Spark counts all (order + 1)-grams of the training texts. All their contexts are nodes of the model, so it
grows with the corpus and stays in tables (`Model`). The value of a position depends on its gram alone:
tasks look up the values of frequent grams and hand on the others, which get theirs by a shuffled join.
Grams of 1/m of all positions or more are at most m, so what is sent to the tasks is bounded, and that
bound changes only where a value is looked up, never the value. `build` makes a table of a small trie.

With counts frozen, all of a node's code lengths can be tabulated. Escapes follow method C: a context
seen T times with D different symbols escapes with D / (T + D). After an escape, the next shorter context
excludes the symbols of the one escaped from; as these are among its own symbols, what is left to count
depends on that one context alone. Symbols that the shortest context lacks share the rest evenly.

A text is its bytes with A-Z in lower case, before it start marks (contexts only), after it an end mark.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.session import staged

BITS = 9
MASK = (1 << BITS) - 1
START, END = 256, 257
SYMBOLS = 257  # bytes and the end mark
#: Symbols worked on at once; longer texts are cut, with their context. Bounds memory.
SEGMENT = 1 << 20
#: Different grams a task holds before it hands them on. Bounds memory.
HELD_GRAMS = 3_000_000


def segments(texts: Iterable[bytes | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, the positions where runs of targets start, and the text each run is of.

    Before each run stand the `order` codes of its context; a run ends where the next context starts.
    """
    parts, starts, owner, size = [], [], [], 0
    pad = np.full(order, START, np.int16)
    for k, text in enumerate(texts):
        codes = np.frombuffer((text or b"").lower(), np.uint8).astype(np.int16)
        codes = np.concatenate([pad, codes, np.array([END], np.int16)])
        for at in range(order, len(codes), SEGMENT):
            part = codes[at - order : at + SEGMENT]
            parts.append(part)
            starts.append(size + order)
            owner.append(k)
            size += len(part)
            if size >= SEGMENT:
                yield np.concatenate(parts), np.array(starts), np.array(owner)
                parts, starts, owner, size = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(starts), np.array(owner)


def is_target(codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    found = np.ones(len(codes), bool)
    for k in range(1, order + 1):
        found[starts - k] = False
    return found


def merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def wide_grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The gram at each position: the target in the low bits, then its context, the nearest symbol first."""
    keys = codes.astype(np.int64)
    wide = keys.copy()
    for k in range(1, order + 1):
        wide[k:] |= keys[:-k] << (BITS * k)
    return wide


class GramCounter:
    """Counts of the grams of `wide_grams`."""

    def __init__(self, order: int):
        self.order = order
        self.grams: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, texts: Iterable[bytes | None]) -> None:
        for codes, starts, _ in segments(texts, self.order):
            wide = wide_grams(codes, self.order)
            found, counts = np.unique(wide[is_target(codes, starts, self.order)], return_counts=True)
            self.grams.append(found)
            self.counts.append(counts)
            self.held += len(found)
            if self.held > HELD_GRAMS:
                grams, counts = merged(self.grams, self.counts)
                self.grams, self.counts, self.held = [grams], [counts], len(grams)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        found = merged(self.grams, self.counts)
        self.grams, self.counts, self.held = [], [], 0
        return found


@dataclass(frozen=True)
class Walk:
    """The trie: `child[node, code]` is the node of the context one symbol longer, or 0.

    Node 1 is the empty context; longer contexts have larger numbers. Codes are those of `code`: the
    symbols seen in training, then one for all others, then the start mark.
    """

    order: int
    code: np.ndarray  # symbol to code
    child: np.ndarray

    def plain(self) -> tuple[int, np.ndarray, np.ndarray]:
        """For a broadcast, which tasks read without this package."""
        return self.order, self.code, self.child

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The longest known context before each position of `codes`."""
        width = self.child.shape[1]
        flat = self.child.reshape(-1)
        at = np.ones(len(codes), np.int64)
        best = at.copy()
        for k in range(1, self.order + 1):
            near = np.full(len(codes), width - 1, np.int64)
            near[k:] = codes[:-k]
            at = flat[at * width + near].astype(np.int64)
            np.maximum(best, at, out=best)
        return best


def build(orders: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[Walk, np.ndarray]:
    """The trie and its log10 probabilities by node and code, from the rows of `trie_rows`."""
    symbols = np.unique(grams & MASK) if len(grams) else np.empty(0, np.int64)
    code = np.full(SYMBOLS + 1, len(symbols), np.int64)
    code[symbols] = np.arange(len(symbols))
    width = len(symbols) + 2
    code[START] = width - 1
    unseen = SYMBOLS - len(symbols)
    tables, index, first = [], {}, 1
    child_rows = []
    # Of the shortest context: what an escape from it leads to.
    after = np.zeros((1, width))
    if unseen:
        after[0, len(symbols)] = 1 / unseen
    for k in range(order + 1):
        chosen = orders == k
        own, inverse = np.unique(grams[chosen] >> BITS, return_inverse=True)
        if k == 0 and not len(own):
            own = np.zeros(1, np.int64)
        if not len(own):
            break
        count = np.zeros((len(own), width))
        count[inverse, code[grams[chosen] & MASK]] = counts[chosen]
        seen = count > 0
        total, different = count.sum(1), seen.sum(1)
        if k == 0:
            below = after
            parent = None
        else:
            mask = (1 << (BITS * (k - 1))) - 1
            parent = np.searchsorted(above, own & mask)
            rest = np.where(seen, 0, above_count[parent])
            left, new = rest.sum(1), (rest > 0).sum(1)
            open_end = above_different[parent] < SYMBOLS
            denominator = left + np.where(open_end, new, 0)
            share = np.divide(1, denominator, out=np.zeros(len(own)), where=denominator > 0)[:, None]
            passed = np.where(denominator > 0, np.where(open_end, new, 0) * share[:, 0], 1.0)[:, None]
            below = np.where(above_seen[parent], rest * share, passed * above_below[parent])
        escape = np.where(different < SYMBOLS, different, 0)
        denominator = np.maximum(total + escape, 1e-300)
        chance = np.where(seen, count / denominator[:, None], np.where(total > 0, escape / denominator, 1.0)[:, None] * below)
        with np.errstate(divide="ignore"):
            tables.append(np.log10(chance).astype(np.float32))
        index[k] = (own, first, parent)
        first += len(own)
        above, above_count, above_seen, above_different, above_below = own, count, seen, different, below
    child = np.zeros((first, width), np.int32)
    for k in range(1, len(index)):
        own, base, parent = index[k]
        far = (own >> (BITS * (k - 1))) & MASK
        child[index[k - 1][1] + parent, code[far]] = base + np.arange(len(own))
    probabilities = np.concatenate([np.zeros((1, width), np.float32), *tables])
    return Walk(order, code, child), probabilities


def log_probabilities(texts: list[bytes | None], walk: Walk, table: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text; `table` has nodes by codes, and may have a last axis of models."""
    models = table.shape[2] if table.ndim == 3 else 1
    out = np.zeros((len(texts), models))
    flat = table.reshape(-1, models)
    width = table.shape[1]
    for symbols, starts, owner in segments(texts, walk.order):
        codes = walk.code[symbols]
        index = walk.nodes(codes) * width + codes
        targets = is_target(symbols, starts, walk.order)
        ends = np.append(starts[1:] - walk.order, len(codes))
        for m in range(models):
            value = np.where(targets, flat[index, m], 0).astype(np.float64)
            sums = np.concatenate([[0.0], np.cumsum(value)])
            np.add.at(out[:, m], owner, sums[ends] - sums[starts])
    return out if table.ndim == 3 else out[:, 0]


def trie_rows(grams: DataFrame, order: int, nodes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, gram, n): counts of symbols after the contexts of k = 0 to `order` symbols that are nodes.

    `grams` has (by, gram, n) of the longest contexts. Of each k at most `nodes` contexts are kept for
    each group of `by`, those seen at 1 / nodes of all positions or more, with at most 257 symbols each.
    """
    widths = F.array(*[F.lit((1 << (BITS * (k + 1))) - 1) for k in range(order + 1)])
    each = (
        grams.select(*by, "gram", "n", F.posexplode(widths).alias("k", "mask"))
        .groupBy(*by, "k", F.col("gram").bitwiseAND(F.col("mask")).alias("gram"))
        .agg(F.sum("n").alias("n"))
        .withColumn("context", F.shiftright("gram", BITS))
    )
    positions = grams.groupBy(*by).agg(F.sum("n").alias("positions"))
    # A window's rows are the symbols of one context, 257 at most.
    total = each.withColumn("total", F.sum("n").over(Window.partitionBy(*by, "k", "context")))
    total = total.join(positions, list(by)) if by else total.join(F.broadcast(positions))  # one row
    return total.where((F.col("k") == 0) | (F.col("total") * F.lit(nodes) >= F.col("positions"))).select(*by, "k", "gram", "n")


def mask_of(symbols: Column) -> Column:
    """The bits of the lowest so many symbols."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (symbols * BITS).cast("int")) - F.lit(1).cast("long")


def frequent_grams(grams: DataFrame, most: int) -> DataFrame:
    """(gram): those of 1 / most of all positions or more, of the rows (gram, n) of all models together."""
    positions = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, -(-positions // most))
    return grams.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("gram")


@dataclass(frozen=True)
class Model:
    """Models number 0 to `models` - 1 with all their contexts of 0 to `order` symbols, as staged tables.

    `top` has (model, gram, value) for the longest grams of training, `each` (model, k, gram, n) for those
    of k + 1 symbols. `nodes` has (model, k, context, own, escape, left, passed), log10 of: the denominator
    of a symbol's chance; the escape's chance; the denominator in the next shorter context after it; the
    chance of a further escape there. For the empty context `left` is the number of unseen symbols.
    """

    order: int
    models: int
    top: DataFrame
    each: DataFrame
    nodes: DataFrame

    def values(self, grams: DataFrame) -> DataFrame:
        """(gram, model, value) for distinct grams: log10 of the probability of the last symbol."""
        models = F.explode(F.sequence(F.lit(0), F.lit(self.models - 1))).alias("model")
        asked = staged(grams.select("gram", models), "asked")
        seen = asked.join(self.top, ["model", "gram"]).select("gram", "model", "value")
        return seen.union(self._escaped(asked.join(self.top, ["model", "gram"], "left_anti")))

    def _escaped(self, grams: DataFrame) -> DataFrame:
        """(gram, model, value) of grams that are not in training: down from the longest known context."""
        levels = range(self.order + 1)
        places = grams.select("gram", "model", F.explode(F.sequence(F.lit(0), F.lit(self.order))).alias("k"))
        places = places.withColumn("own_gram", F.col("gram").bitwiseAND(mask_of(F.col("k") + 1)))
        places = places.withColumn("context", F.shiftright("own_gram", BITS))
        each, nodes = self.each.withColumnRenamed("gram", "own_gram"), self.nodes
        # All have the empty context, and the last symbol there: few rows, sent to all tasks.
        empty = (
            places.where("k = 0")
            .join(F.broadcast(each.where("k = 0")), ["model", "k", "own_gram"], "left")
            .join(F.broadcast(nodes.where("k = 0")), ["model", "k", "context"], "left")
        )
        longer = places.where("k > 0").join(each, ["model", "k", "own_gram"], "left").join(nodes, ["model", "k", "context"], "left")
        names = ("n", "own", "escape", "left", "passed")
        found = empty.select("gram", "model", "k", *names).union(longer.select("gram", "model", "k", *names))
        found = found.groupBy("gram", "model").agg(
            *[F.max(F.when(F.col("k") == k, F.col(name))).alias(f"{name}{k}") for k in levels for name in names]
        )
        value = F.lit(-math.log10(SYMBOLS))
        # Of a symbol that is not in context k or longer ones: what follows the escape from it.
        below = -F.col("left0")
        for k in levels:
            if k:
                above = F.col(f"n{k - 1}")
                below = F.when(above.isNotNull(), F.log10(above) - F.col(f"left{k}")).otherwise(F.col(f"passed{k}") + below)
            count = F.col(f"n{k}")
            here = F.when(count.isNotNull(), F.log10(count) - F.col(f"own{k}")).otherwise(F.col(f"escape{k}") + below)
            value = F.when(F.col(f"own{k}").isNotNull(), here).otherwise(value)
        return found.select("gram", "model", value.alias("value"))

    def lookup(self, grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams in order and their values by model, for a broadcast."""
        each = F.sort_array(F.collect_list(F.struct("model", "value")))  # a row for each model
        rows = self.values(grams).groupBy("gram").agg(F.transform(each, lambda x: x["value"].cast("float")).alias("value")).toArrow()
        keys = rows["gram"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        values = rows["value"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        order = np.argsort(keys)
        return keys[order], values.reshape(len(keys), self.models)[order]


def model_of(grams: DataFrame, order: int, models: int = 1) -> Model:
    """The model of (model, gram, n), the staged counts of the longest grams, with no context left out."""
    grams = grams.select("model", "gram", "n")
    # A window's rows are the symbols of one context, 257 at most.
    context = Window.partitionBy("model", F.shiftright("gram", BITS))
    own = F.sum("n").over(context) + open_symbols(F.count("n").over(context))
    top = staged(grams.select("model", "gram", (F.log10("n") - F.log10(own)).alias("value")), "top")
    shorter = grams.select("model", "gram", "n", F.explode(F.sequence(F.lit(0), F.lit(order - 1))).alias("k"))
    shorter = shorter.groupBy("model", "k", F.col("gram").bitwiseAND(mask_of(F.col("k") + 1)).alias("gram")).agg(F.sum("n").alias("n"))
    longest = grams.select("model", F.lit(order).alias("k"), "gram", "n")
    each = staged(shorter.select("model", "k", "gram", "n").union(longest), "grams")

    # Each gram beside the one shorter by the farthest symbol.
    above = each.select("model", (F.col("k") + 1).alias("k"), F.col("gram").alias("up"), F.col("n").alias("n_up"))
    beside = each.withColumn("up", F.col("gram").bitwiseAND(mask_of(F.col("k")))).join(above, ["model", "k", "up"], "left")
    contexts = beside.groupBy("model", "k", F.shiftright("gram", BITS).alias("context")).agg(
        F.sum("n").alias("total"), F.count("n").alias("different"), F.sum("n_up").alias("covered")
    )
    contexts = staged(contexts, "contexts")
    parents = contexts.select(
        "model",
        (F.col("k") + 1).alias("k"),
        F.col("context").alias("up"),
        F.col("total").alias("total_up"),
        F.col("different").alias("different_up"),
    )
    both = contexts.withColumn("up", F.col("context").bitwiseAND(mask_of(F.greatest(F.col("k") - 1, F.lit(0)))))
    both = both.join(parents, ["model", "k", "up"], "left")
    own = F.col("total") + open_symbols(F.col("different"))
    new = F.when(F.col("different_up") < SYMBOLS, F.col("different_up") - F.col("different")).otherwise(0)
    left = F.when(F.col("k") == 0, F.lit(SYMBOLS) - F.col("different")).otherwise(F.col("total_up") - F.col("covered") + new)
    # Where log10 of 0, which is null, would come in, no symbol is left to ask for.
    nodes = both.select(
        "model",
        "k",
        "context",
        F.log10(own).alias("own"),
        (F.log10(open_symbols(F.col("different"))) - F.log10(own)).alias("escape"),
        F.log10(left).alias("left"),
        F.coalesce(F.log10(new) - F.log10(left), F.lit(0.0)).alias("passed"),
    )
    return Model(order, models, top, each, staged(nodes, "nodes"))


def open_symbols(different: Column) -> Column:
    """What an escape counts for: nothing where all symbols were seen."""
    return F.when(different < SYMBOLS, different).otherwise(0)


def look_up(
    texts: list[bytes | None], order: int, keys: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums by text and model of the values of the grams that are in `keys`, and the (text, gram, times) of all others."""
    out = np.zeros((len(texts), values.shape[1]))
    others = [(np.empty(0, np.int64),) * 3]
    for codes, starts, owner in segments(texts, order):
        runs = np.append(starts[1:] - order, len(codes)) - starts
        own = np.repeat(owner, runs)
        found, inverse = np.unique(wide_grams(codes, order)[is_target(codes, starts, order)], return_inverse=True)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            known = keys[at] == found
            value = np.where(known[:, None], values[at], 0)
            for m in range(out.shape[1]):
                out[:, m] += np.bincount(own, value[inverse, m], len(texts))
        else:
            known = np.zeros(len(found), bool)
        if not known.all():
            rest = ~known[inverse]
            pairs, times = np.unique(own[rest].astype(np.int64) * len(found) + inverse[rest], return_counts=True)
            others.append((pairs // len(found), found[pairs % len(found)], times.astype(np.int64)))
    return out, *(np.concatenate(part) for part in zip(*others, strict=True))
