"""Hard negatives by an inverted multi-index: cells of two codebooks, visited by bounds until windows are certain.

Vectors are cut in halves, each with a codebook of its own; a pair of codewords is a cell. By Cauchy and
Schwarz no row of a cell scores more with a query than the two half scores of its codewords and the half
norms of the query times the codewords' radii. For each query a heap over the two sorted sequences of half
bounds gives the cells in falling order of their sum. A first visit of the best cells gives a score that the
result must reach; a second one visits all cells whose bound reaches it, and what is left is certain not to
matter. That is done twice, for the nearest rows of the anchor's label and for the windows below them.

Rows stay in blocks of one cell, anchors travel to the cells they visit in blocks, and a pair of blocks gives
a bounded number of rows. Nothing but codebooks, radii and counts of cells is known to the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.llm.common import column
from packlake.session import Scratch, configure, staged

#: Rows the codebooks are fitted on, and rounds of it. All rows are indexed.
SAMPLE_ROWS, ROUNDS = 20_000, 8
#: Rows a cell should have, and most codewords of a half: the index grows with the rows up to that.
CELL_ROWS, MOST_CODEWORDS = 2000, 256
#: Rows and anchors of a block.
BLOCK, ANCHORS = 2048, 512
#: Share of the rows that the first visit takes.
FIRST = 1 / 8
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Index:
    """Codewords, radii and counts of the cells; at most MOST_CODEWORDS squared numbers."""

    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    size: int

    @property
    def words(self) -> int:
        return len(self.halves[0])

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.size // 2], vectors[:, self.size // 2 :]

    def nearest(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The codeword of each half of each vector, and how far it is."""
        return [_nearest(half, words) for half, words in zip(self.split(vectors), self.halves, strict=True)]

    def cells(self, vector: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, most, least) that its rows can score, the greatest `most` first; only cells with rows."""
        middles, margins = [], []
        for half, words, radii in zip(self.split(vector[None]), self.halves, self.radii, strict=True):
            middles.append(words @ half[0])
            # A little more than exact, for the rounding of sums.
            margins.append(np.linalg.norm(half[0]) * radii * (1 + 1e-9) + 1e-3 + 1e-9 * np.abs(middles[-1]))
        bounds = [m + g for m, g in zip(middles, margins, strict=True)]
        first, second = (np.argsort(-b, kind="stable") for b in bounds)
        heap = [(-(bounds[0][first[0]] + bounds[1][second[0]]), 0, 0)]
        while heap:
            most, i, j = heapq.heappop(heap)
            a, b = first[i], second[j]
            if self.counts[a, b]:
                yield int(a) * self.words + int(b), -most, sum(m[k] - g[k] for m, g, k in zip(middles, margins, (a, b)))
            if j + 1 < self.words:
                heapq.heappush(heap, (-(bounds[0][a] + bounds[1][second[j + 1]]), i, j + 1))
            if not j and i + 1 < self.words:
                heapq.heappush(heap, (-(bounds[0][first[i + 1]] + bounds[1][b]), i + 1, 0))


def _nearest(vectors: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    away = (words**2).sum(1) - 2 * vectors @ words.T
    word = away.argmin(1)
    return word, np.linalg.norm(vectors - words[word], axis=1)


def _codebook(vectors: np.ndarray, n: int) -> np.ndarray:
    words = vectors[:n].copy()
    for _ in range(ROUNDS):
        word, _ = _nearest(vectors, words)
        total = np.zeros_like(words)
        np.add.at(total, word, vectors)
        count = np.bincount(word, minlength=len(words))
        words[count > 0] = total[count > 0] / count[count > 0, None]
    return words


def noisy(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next label."""
    changed = F.pmod(F.col("label") + 1, F.lit(10)).cast("int")
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, changed).otherwise(F.col("label")).alias("label"))


def scaled(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) with whole components floor(256 x), of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    most = 1 << 31

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * 256 >= most)

    taking_part = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad)
    return rows.where(taking_part).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), whole.cast("array<int>").alias("vector"))


def mine(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Anchors, positives and their hard negatives: the columns of SCHEMA.

    `rows` has vec_id, label and embedding. Rows without a label or a vector, or with a component that is null,
    not finite or beyond 2**23, take no part; scores are taken to fit in a long. Anchors are the rows whose id is divisible by `every`. The
    positives of one are the best `positives` rows of its label with another id; for each, the best `negatives`
    rows of other labels that score from `low` to `high` percent of it. Ties go to the smaller id, a null id
    comes last. Of vectors of unequal lengths the longer one's rest counts nothing. Repeated rows are rows of
    their own, also as anchors, but none is a positive of an anchor with its id. No anchors give no rows.
    Other columns are not read.
    """
    spark = configure(rows.sparkSession)
    empty = spark.createDataFrame([], SCHEMA)
    with Scratch(spark) as scratch:
        vectors = scratch.staged(scaled(rows), "vectors")
        n, size = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
        if not n:
            return empty
        blocks, index = _indexed(vectors, n, size, scratch)
        anchors = vectors.where(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id())
        anchors = scratch.staged(anchors, "anchors")

        def found(queries: DataFrame, k: int, same: bool) -> DataFrame:
            best = None
            for last in (False, True):
                needs = queries
                if best is not None:
                    worst = best.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
                    worst = worst.where(F.col("n") >= k).groupBy("anchor").agg(
                        F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least")
                    )
                    needs = queries.join(worst, "anchor", "left")
                visits = _visits(needs, index, n, k, last)
                new = _candidates(visits, blocks, k, same)
                new = new if best is None else new.unionByName(best)
                order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
                ranked = new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                best = scratch.staged(ranked.select("anchor", "slot", "score", "vec_id"), "best")
            return best.withColumn("rank", F.row_number().over(order))

        nothing = F.array().cast("array<long>")
        queries = anchors.select("*", nothing.alias("lows"), nothing.alias("highs"))
        positive = scratch.staged(
            found(queries, positives, True).select("anchor", "rank", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")),
            "positives",
        )
        scores = positive.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
        scores = scores.withColumn("p", F.col("p.positive_score"))
        # Whole scores s in the window: low * p <= 100 * s <= high * p.
        windows = scores.select(
            "anchor",
            F.transform("p", lambda p: _percent(p, low, up=True)).alias("lows"),
            F.transform("p", lambda p: _percent(p, high, up=False)).alias("highs"),
        )
        negative = found(anchors.join(windows, "anchor"), negatives, False)
        negative = negative.select("anchor", "slot", F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        positive = positive.select("anchor", (F.col("rank") - 1).alias("slot"), "positive_id", "positive_score")
        result = negative.join(positive, ["anchor", "slot"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        return staged(result.select(*names), "negatives")


def _percent(p: Column, percent: int, up: bool) -> Column:
    """`percent` hundredths of a whole number, rounded up or down; hundreds apart, so nothing overflows."""
    rest = F.pmod(p, F.lit(100))
    more = rest * percent
    more = more + F.pmod(-more, F.lit(100)) if up else more - F.pmod(more, F.lit(100))
    return F.call_function("div", p - rest, F.lit(100)) * percent + F.call_function("div", more, F.lit(100))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of `size` components, shorter ones filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size).astype(np.float64)
    filled = np.zeros((len(lists), size))
    filled[np.arange(size) < lengths[:, None]] = flat
    return filled


def _indexed(vectors: DataFrame, n: int, size: int, scratch: Scratch) -> tuple[DataFrame, Index]:
    """All rows in blocks of one cell, by falling hash parts where a cell is large; and the index."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE_ROWS).select("vector").toArrow()
    fit = _matrix(sample.column("vector").combine_chunks(), size)
    words = int(min(MOST_CODEWORDS, max(2, round((n / CELL_ROWS) ** 0.5)), len(fit)))
    halves = fit[:, : size // 2], fit[:, size // 2 :]
    index = Index(tuple(_codebook(half, words) for half in halves), ((), ()), np.zeros((words, words), np.int64), size)

    def assign(batches):
        for batch in batches:
            (a, away_a), (b, away_b) = index.nearest(_matrix(batch.column("vector"), size))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (a.astype(np.int32), b.astype(np.int32), away_a, away_b))],
                [*batch.schema.names, "a", "b", "away_a", "away_b"],
            )

    schema = "vec_id long, label int, vector array<int>, a int, b int, away_a double, away_b double"
    assigned = scratch.staged(vectors.mapInArrow(assign, schema), "assigned")
    for k, side in enumerate(("a", "b")):
        radii = np.zeros(words)
        for word, away in assigned.groupBy(side).agg(F.max(f"away_{side}")).collect():
            radii[word] = away
        index.radii = (radii, index.radii[1]) if not k else (index.radii[0], radii)
    counts = assigned.groupBy("a", "b").count()
    for a, b, count in counts.collect():
        index.counts[a, b] = count
    # A large cell is dealt out in parts of about four blocks.
    parts = F.broadcast(counts.select("a", "b", F.ceil(F.col("count") / (4 * BLOCK)).alias("parts")))
    part = F.pmod(F.xxhash64("vec_id", "vector", "label"), F.col("parts"))
    dealt = assigned.join(parts, ["a", "b"]).select(
        (F.col("a") * words + F.col("b")).alias("cell"), part.alias("part"), "vec_id", "label", "vector"
    )
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", F.asc_nulls_last("vec_id"))

    def pack(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def block():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            vectors = _matrix(rows.column("vector").combine_chunks(), size).astype("<i4").tobytes()
            lists = [pa.array([rows.column(c).to_pylist()], pa.list_(t)) for c, t in (("vec_id", pa.int64()), ("label", pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), *lists, pa.array([vectors])], ["cell", "ids", "labels", "rows"])

        for batch in batches:
            cells, parts = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
            change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0)) + 1
            for start, end in zip([0, *change], [*change, len(cells)], strict=True):
                if held and (cells[start], parts[start]) != key:
                    yield block()
                key = cells[start], parts[start]
                while start < end:
                    room = BLOCK - sum(map(len, held))
                    held.append(batch.slice(start, min(room, end - start)))
                    start += room
                    if sum(map(len, held)) == BLOCK:
                        yield block()
        if held:
            yield block()

    return scratch.staged(dealt.mapInArrow(pack, "cell int, ids array<long>, labels array<int>, rows binary"), "blocks"), index


def _visits(queries: DataFrame, index: Index, n: int, k: int, last: bool) -> DataFrame:
    """For each cell the anchors that visit it, in blocks; the first visits, or all others that can matter."""

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), ANCHORS):
                part = batch.slice(start, ANCHORS)
                vectors = _matrix(part.column("vector"), index.size)
                lows, highs = column(part, "lows"), column(part, "highs")
                least = [dict(x or ()) for x in column(part, "least")] if last and "least" in part.schema.names else None
                visitors = defaultdict(list)
                for i, vector in enumerate(vectors):
                    slots = range(len(lows[i]) or 1)
                    # What a row must score to matter: all of them, in the first visit.
                    need, top = min(lows[i], default=-np.inf), max(highs[i], default=np.inf)
                    if least is not None:
                        need = min(max(lows[i][s] if lows[i] else -np.inf, least[i].get(s, -np.inf)) for s in slots)
                    rows = 0
                    for cell, most, lowest in index.cells(vector):
                        if most < need:
                            break
                        seen = rows < FIRST * n
                        rows += index.counts[divmod(cell, index.words)]
                        if seen != last and lowest <= top:
                            visitors[cell].append(i)
                cells = list(visitors)
                chosen = [part.take(pa.array(visitors[c])) for c in cells]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells, pa.int32()),
                        *(
                            pa.array([c.column(name).to_pylist() for c in chosen], pa.list_(kind))
                            for name, kind in (("anchor", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()))
                        ),
                        *(
                            pa.array([c.column(name).to_pylist() for c in chosen], pa.list_(pa.list_(pa.int64())))
                            for name in ("lows", "highs")
                        ),
                        pa.array([vectors[visitors[c]].astype("<i4").tobytes() for c in cells], pa.binary()),
                    ],
                    ["cell", "anchor", "anchor_ids", "anchor_labels", "lows", "highs", "queries"],
                )

    return queries.mapInArrow(
        run,
        "cell int, anchor array<long>, anchor_ids array<long>, anchor_labels array<int>, lows array<array<long>>, "
        "highs array<array<long>>, queries binary",
    )


def _candidates(visits: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """The best `k` rows of each block for each anchor that visits it and each of its windows."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                rows, queries = (np.frombuffer(row[c], "<i4") for c in ("rows", "queries"))
                ids, labels = row["ids"], np.array(row["labels"])
                rows, queries = rows.reshape(len(ids), -1), queries.reshape(len(row["anchor"]), -1)
                # Products of doubles are exact below 2**53.
                most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
                kind = np.float64 if most < 2**53 else np.int64
                scores = (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)
                known = np.array([x is not None for x in ids])
                plain = np.array([0 if x is None else x for x in ids], np.int64)
                for i, anchor in enumerate(row["anchor"]):
                    like = labels == row["anchor_labels"][i]
                    score = scores[i]
                    if same:
                        chosen = np.flatnonzero(like & ~(known & (plain == row["anchor_ids"][i])))
                        for j in _best(score, chosen, k):
                            out.append((anchor, 0, int(score[j]), ids[j]))
                    else:
                        lows, highs = row["lows"][i], row["highs"][i]
                        chosen = np.flatnonzero(~like & (score >= min(lows)) & (score <= max(highs)))
                        chosen = chosen[np.argsort(-score[chosen], kind="stable")]
                        falling = -score[chosen]
                        for slot, (low, high) in enumerate(zip(lows, highs, strict=True)):
                            start = int(np.searchsorted(falling, -high))
                            for j in chosen[start : start + k]:
                                if score[j] >= low:
                                    out.append((anchor, slot, int(score[j]), ids[j]))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "slot", "score", "vec_id"])

    return visits.join(blocks, "cell").mapInArrow(run, "anchor long, slot int, score long, vec_id long")


def _best(score: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """The `k` greatest of the chosen scores; of equal ones those that stand first."""
    if len(chosen) > k:
        least = np.partition(score[chosen], len(chosen) - k)[len(chosen) - k]
        chosen = chosen[score[chosen] >= least]
    return chosen[np.argsort(-score[chosen], kind="stable")][:k]
