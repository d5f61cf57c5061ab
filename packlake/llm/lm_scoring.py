"""Language-model scores: a pretrained byte model (prediction by partial matching) and a word unigram.

All statistics are counted in one pass over the training texts. A second pass scores every text by the
frequent grams and words; the values of the other grams and the counts of the other words come by shuffled
joins. Frequent are words of a fixed share of all tokens and grams of a fixed share of all positions, so
their number is bounded whatever the size of the corpus, and only they are sent to all tasks.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm import ppm
from packlake.llm.common import lower_words, utf8
from packlake.session import staged

ORDER = 4
#: Grams of 1 / GRAMS of all positions or more are looked up in the tasks, so many at most.
GRAMS = 1 << 22
#: Words of 1 / FREQUENT of all tokens or more are looked up in the tasks: so many at most, and none
#: longer than LONGEST bytes.
FREQUENT, LONGEST = 1 << 20, 64
#: The end of a text as a token; no word holds a line feed.
STOP = b"\n"
#: Different words a task holds before it hands them on. Bounds memory.
HELD_WORDS = 500_000


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, gram, n) of a column `text`: counts of tokens (gram is null) and of grams (word is null)."""

    def rows(words: Counter, grams: ppm.GramCounter):
        found, n = grams.take()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*words, *[None] * len(found)], pa.binary()),
                pa.array([*[None] * len(words), *found.tolist()], pa.int64()),
                pa.array([*words.values(), *n.tolist()], pa.int64()),
            ],
            ["word", "gram", "n"],
        )
        words.clear()

    def run(batches):
        words, grams = Counter(), ppm.GramCounter(order)
        for batch in batches:
            texts = utf8(batch, "text")
            for text in texts:
                words.update(lower_words(text))
            words[STOP] += len(texts)
            grams.add(texts)
            if len(words) > HELD_WORDS or grams.held > ppm.HELD_GRAMS:
                yield from rows(words, grams)
        yield from rows(words, grams)

    return texts.select("text").mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, learn: Column, order: int = ORDER, frequent: int = FREQUENT, grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Learns from the rows where `learn` is true; reads `doc_id`, `text` and `held_out` only. A null
    text is the empty text: one end. Repeated rows are scored one by one and count as often, a null id
    stays null. Without training texts all symbols are alike and no token is known.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "held_out")
    found = staged(counts(docs.where(learn), order), "statistics")
    words = found.where("word IS NOT NULL").select("word", "n")
    total, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    scale = 0.1
    unit = math.log10(total + scale * (different + 1))
    least = max(1, -(-total // frequent))
    common = F.expr(f"n >= {least} AND octet_length(word) <= {LONGEST}")
    # At most `frequent` words of at most LONGEST bytes.
    known = {bytes(w): (math.log10(n + scale) - unit, n) for w, n in words.where(common).collect()}
    counted = found.where("gram IS NOT NULL").select(F.lit(0).alias("model"), "gram", "n")
    model = ppm.model_of(counted, order)
    # At most `grams` of them.
    frequent_values = model.lookup(ppm.frequent_grams(counted, grams))
    sent = spark.sparkContext.broadcast((known, *frequent_values))

    def run(batches):
        known, keys, values = sent.value
        number = TaskContext.get().partitionId() << 36
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            texts = utf8(batch, "text")
            tokens, base, sure, owner, rare, times = [], [], [], [], [], []
            for k, text in enumerate(texts):
                own = Counter(lower_words(text))
                own[STOP] += 1
                part, seen = [], 0
                for word, n in own.items():
                    if word in known:
                        part.append(n * known[word][0])
                        seen += n
                    else:
                        owner.append(number + k)
                        rare.append(word)
                        times.append(n)
                tokens.append(own.total())
                base.append(math.fsum(part))
                sure.append(seen)
            scores, gram_owner, gram, gram_times = ppm.look_up(texts, order, keys, values)
            n, m, g = len(texts), len(owner), len(gram)
            ids = np.arange(number, number + n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, np.array(owner, np.int64), number + gram_owner]), pa.int64()),
                    pa.concat_arrays([batch.column("doc_id"), pa.nulls(m + g, kind)]),
                    pa.concat_arrays([batch.column("held_out"), pa.nulls(m + g, pa.bool_())]),
                    pa.concat_arrays([pa.array(tokens, pa.int64()), pa.nulls(m + g, pa.int64())]),
                    pa.concat_arrays([pa.array(sure, pa.int64()), pa.nulls(m + g, pa.int64())]),
                    pa.concat_arrays([pa.array(base, pa.float64()), pa.nulls(m + g, pa.float64())]),
                    pa.concat_arrays([pa.array(scores[:, 0]), pa.nulls(m + g, pa.float64())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(rare, pa.binary()), pa.nulls(g, pa.binary())]),
                    pa.concat_arrays([pa.nulls(n + m, pa.int64()), pa.array(gram)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times, pa.int64()), pa.array(gram_times)]),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_sure", "sure", "score", "word", "gram", "times"],
            )
            number += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = staged(
        docs.mapInArrow(
            run,
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_sure long, sure double, score double, "
            "word binary, gram long, times long",
        ),
        "scores",
    )
    others = (
        both.where("word IS NOT NULL")
        .select("row", "word", "times")
        .join(words.where(~common), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(scale)) - F.lit(unit))).alias("rest"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rest"),
        )
    )
    rare_grams = both.where("gram IS NOT NULL").select("row", "gram", "times")
    values = model.values(rare_grams.select("gram").distinct()).select("gram", "value")
    escaped = rare_grams.join(values, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest_score"))
    return (
        both.where("word IS NULL AND gram IS NULL")
        .drop("word", "gram", "times")
        .join(others, "row", "left")
        .join(escaped, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_sure") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("sure") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
        )
    )
