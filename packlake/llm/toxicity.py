"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence has a logistic score of its words; the sentences of a document
are combined by noisy-or, 1 - prod(1 - p_s), and the likelihood of the document labels is what the
weights are fitted to. The fitted sentence scores then point at the sentences to blame. A word's weight
is the sum of the weights of the word itself and of the 4 and 5 bytes long pieces it has with its start
marked, so that unseen forms of a stem count too.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import utf8

#: A-Z to a-z, sentence ends to a line feed, other ASCII that is no letter to a space.
TABLE = bytes(
    ord("\n") if chr(c) in ".!?\n" else c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
    for c in range(256)
)
#: Labelled documents the weights are fitted to, at most; taken in the order of a hash.
TRAIN_ROWS = 5000
#: A piece needs so many places in that sample (a word once in a sentence) to get a weight.
MIN_PLACES = 6
EPOCHS = 150
#: Words of which a task keeps the weight; forgotten beyond them. Bounds memory.
CACHE_ENTRIES = 1_000_000


def pieces(word: bytes) -> set[bytes]:
    marked = b"^" + word
    return {b"=" + word} | {marked[k : k + n] for n in (4, 5) for k in range(len(marked) - n + 1)}


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]  # of pieces
    bias: float

    def word(self, word: bytes) -> float:
        known = self.weights
        return math.fsum(known[p] for p in pieces(word) if p in known)


class Known(dict):
    """Weights of words, each summed up once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = found = self.model.word(word)
        return found


def sentences(text: bytes | None) -> list[list[bytes]]:
    return [words for part in (text or b"").translate(TABLE).split(b"\n") if (words := part.split())]


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most `limit` labelled documents; `labels` has doc_id and label.

    Rows without an id or a label are left out; of several labels of an id the largest counts.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(*order)
        .limit(limit)
    )
    # `limit` rows of two numbers: the bound of what is broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(limit).select("text", "label")


def fit(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, min_places: int = MIN_PLACES) -> Model:
    """Weights of at least 0 by projected full-batch Adam on the noisy-or likelihood, with an L1 penalty.

    Only evidence for toxicity counts, so long harmless text hides nothing. Pieces that are not twice as
    frequent in documents labelled 1 as overall can carry none and are left out.

    Without rows of both labels the model knows no pieces and gives every sentence the same score.
    """
    labels = np.array([label for _, label in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return Model({}, 0.0 if len(rows) and labels.max() > 0 else -12.0)
    ids: dict[bytes, int] = {}
    word, sentence, document = array("i"), array("i"), array("i")
    for d, (text, _) in enumerate(rows):
        for words in sentences(text.encode() if text else b""):
            own = [ids.setdefault(w, len(ids)) for w in set(words)]
            word.extend(own)
            sentence.extend([len(document)] * len(own))
            document.append(d)
    word, sentence, document = (np.frombuffer(x, np.int32) for x in (word, sentence, document))
    vocabulary: dict[bytes, int] = {}
    owner, piece = array("i"), array("i")
    for w, k in ids.items():
        own = [vocabulary.setdefault(p, len(vocabulary)) for p in pieces(w)]
        piece.extend(own)
        owner.extend([k] * len(own))
    owner, piece = np.frombuffer(owner, np.int32), np.frombuffer(piece, np.int32)
    toxic = (labels > 0)[document[sentence]]
    places = np.bincount(piece, np.bincount(word, minlength=len(ids))[owner], len(vocabulary))
    of_toxic = np.bincount(piece, np.bincount(word, toxic, len(ids))[owner], len(vocabulary))
    used = np.flatnonzero((places >= min_places) & (of_toxic > 2 * toxic.mean() * places))
    renamed = np.full(len(vocabulary), -1, np.int32)
    renamed[used] = np.arange(len(used))
    kept = renamed[piece] >= 0
    owner, piece = owner[kept], renamed[piece[kept]]
    marked = np.zeros(len(ids), bool)
    marked[owner] = True
    word, sentence = word[marked[word]], sentence[marked[word]]
    weights, bias = np.zeros(len(used)), -6.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        of_word = np.bincount(owner, weights[piece], len(ids))
        z = bias + np.bincount(sentence, of_word[word], len(document))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        total = np.bincount(document, np.logaddexp(0, z), len(rows))  # -log(1 - noisy-or)
        factor = np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        slope = factor[document] * p
        by_word = np.bincount(word, slope[sentence], len(ids))
        gradient = np.append(np.bincount(piece, by_word[owner], len(used)) + 0.5, slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = np.maximum(weights - move[:-1], 0), bias - move[-1]
    names = list(vocabulary)
    return Model({names[k]: float(w) for k, w in zip(used, weights, strict=True) if abs(w) > 1e-2}, float(bias))


def score(docs: DataFrame, model: Model, blame: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences, offending (array of start, end, score) for each row of `docs`.

    Offsets are code points, end exclusive; offending sentences are those with a score over `blame`. A text without words, or null, has the score 0. Reads `doc_id` and `text` only.
    """
    docs = docs.select("doc_id", "text")
    bias, blame_z = model.bias, math.log(blame / (1 - blame))

    def run(batches):
        known = Known(model)
        for batch in batches:
            scores, counts, blamed = [], [], []
            for text in utf8(batch, "text"):
                total, n, at, found = 0.0, 0, 0, []
                for part in (text or b"").translate(TABLE).split(b"\n"):
                    if words := part.split():
                        n += 1
                        z = bias + sum(map(known.__getitem__, set(words)))
                        total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                        if z > blame_z:
                            start = len(text[:at].decode())
                            end = start + len(text[at : at + len(part)].decode())
                            found.append({"start": start, "end": end, "score": 1 / (1 + math.exp(-z))})
                    at += len(part) + 1
                scores.append(-math.expm1(-total))
                counts.append(n)
                blamed.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array(counts, pa.int64()),
                    pa.array(blamed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                ],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, score double, n_sentences long, offending array<struct<start: bigint, end: bigint, score: double>>"
    )
