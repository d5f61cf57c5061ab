"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

A document's set is its distinct shingles of words. Equal sets are one from the start. The others are
candidates when a band of their signatures agrees; a candidate pair is compared by batches of signature
bytes and dropped as soon as the posterior probability that its similarity reaches the threshold falls
below the chosen miss probability; what survives is verified exactly on the full texts.

No group is expanded into all its pairs. Each bucket first compares its members with one of them, picked
by a mask of the bucket's own so that buckets differ; the groups found so far are joined up. Only pairs of
one bucket that are still in different groups are then compared, all of them, so no link between
different groups is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import lower_words, utf8
from packlake.llm.components import components
from packlake.session import staged

ROWS, BANDS = 6, 40
#: Two documents of the threshold's similarity share no band with probability (1 - 0.8^6)^40 = 5e-6.
BATCH = 24
#: Posterior probability of being a link below which a pair is dropped.
MISS = 1e-7
WORD = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
#: Words of which a task keeps the hash; forgotten beyond them. Bounds memory.
CACHE_ENTRIES = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def shingle_hashes(text: bytes | None, size: int, known: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in order; a shorter text is one shingle, no words none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    total = mixed(hashes[:n] + np.uint64(width))
    for k in range(1, width):
        total = mixed(total * np.uint64(STEP) + hashes[k : k + n])
    return np.unique(total)


def signature_maker(rows: int = ROWS, bands: int = BANDS):
    """hashes -> (low bytes of the MinHash signature, one 64-bit key for each band)."""
    k = rows * bands
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(WORD)) | np.uint64(1)
    shifts = mixed(np.arange(k + 1, 2 * k + 1, dtype=np.uint64) * np.uint64(WORD))
    numbers = np.arange(bands, dtype=np.uint64)

    def make(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
        least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 512):  # keeps the products in the processor's cache
            np.minimum(least, (hashes[at : at + 512, None] * factors + shifts).min(0), out=least)
        least = mixed(least)
        keys = numbers * np.uint64(STEP)
        for row in least.reshape(bands, rows).T:
            keys = mixed(keys * np.uint64(STEP) + row)
        return (least & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64)

    return make


def prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n, digest, signature, keys); without words n is 0 and the last three are null."""

    def run(batches):
        known, make = WordHashes(), signature_maker()
        for batch in batches:
            out = []
            for text in utf8(batch, "text"):
                hashes = shingle_hashes(text, size, known)
                if len(hashes):
                    out.append((len(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), *make(hashes)))
                else:
                    out.append((0, None, None, None))
            n, digest, signature, keys = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(signature, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n", "digest", "signature", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash binary, n long, digest binary, signature binary, keys array<long>"
    )


def text_hash() -> Column:
    """What tells the rows of one doc_id apart; null texts and empty ones are alike."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def least_matches(percent: int, length: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(bytes compared, matches a pair needs to stay) after each batch.

    A byte agrees with probability s + (1 - s) / 256 for similarity s. With a uniform prior on s, a pair
    is dropped when the posterior probability of s >= percent / 100 is below `miss`.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    agree = s + (1 - s) / 256
    likely = s >= percent / 100
    out = []
    for seen in range(batch, length + 1, batch):
        k = np.arange(seen + 1)[:, None]
        logs = k * np.log(agree) + (seen - k) * np.log1p(-agree)
        weights = np.exp(logs - logs.max(1, keepdims=True))
        out.append((seen, int(np.argmax(weights[:, likely].sum(1) / weights.sum(1) >= miss))))
    return out


def plausible(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (left[a], right[b]) of signatures stay, comparing them batch by batch."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for seen, least in needed:
        matches = matches + (left[a[alive], at:seen] == right[b[alive], at:seen]).sum(1)
        stay = matches >= least
        alive, matches, at = alive[stay], matches[stay], seen
    return alive


def compare_signatures(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that stay."""
    own = sets.select("rep", "n", "signature")
    needed = least_matches(percent, ROWS * BANDS)

    def run(batches):
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in ("x", "y")
            )
            k = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).take(pa.array(plausible(x, y, k, k, needed)))

    # Sets whose sizes differ too much cannot reach the threshold.
    sized = (
        pairs.join(own.toDF("a", "na", "x"), "a")
        .join(own.toDF("b", "nb", "y"), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    )
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        known = WordHashes()
        last: dict[str, tuple[bytes, np.ndarray]] = {}

        def hashes(side: str, text: bytes) -> np.ndarray:
            if side not in last or last[side][0] != text:  # rows come sorted by one side
                last[side] = (text, shingle_hashes(text, size, known))
            return last[side][1]

        for batch in batches:
            found = [
                linked(hashes("x", x), hashes("y", y), percent) for x, y in zip(utf8(batch, "x"), utf8(batch, "y"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return (
        pairs.join(texts.toDF("a", "x"), "a")
        .join(texts.toDF("b", "y"), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(run, "a long, b long")
    )


#: Members of a bucket in one block; larger buckets are compared block by block. Bounds memory.
BLOCK = 512


def compare_blocks(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a block pair that have different labels.

    `members` has (key, i, j, block, rep, label, n, signature, text): block i against block j of the
    bucket `key`. Only links that connect labels not yet connected in the block pair are returned.
    """
    needed = least_matches(percent, ROWS * BANDS)
    ordered = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(rows: list[dict], known: WordHashes):
        i, j = rows[0]["i"], rows[0]["j"]
        left = [k for k, r in enumerate(rows) if r["block"] == i]
        right = left if i == j else [k for k, r in enumerate(rows) if r["block"] == j]
        signature = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint8).reshape(len(rows), -1)
        label = np.unique([r["label"] for r in rows], return_inverse=True)[1]
        n = np.array([r["n"] for r in rows])
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        fit = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        if i == j:
            fit &= a < b
        a, b = a[fit], b[fit]
        alive = plausible(signature, signature, a, b, needed)
        a, b = a[alive], b[alive]
        if not len(a):
            return
        used, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = [shingle_hashes(rows[k]["text"], size, known) for k in used]
        values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(used)), [len(s) for s in sets])
        keep = times[where] > 1
        has = np.zeros((len(used), int((times > 1).sum()) or 1), np.float32)
        has[owner[keep], shared[where[keep]]] = 1
        common = (has @ has.T)[inverse[: len(a)], inverse[len(a) :]].astype(np.int64)
        lengths = np.array([len(s) for s in sets])
        union = lengths[inverse[: len(a)]] + lengths[inverse[len(a) :]] - common
        root = list(range(int(label.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in np.flatnonzero(100 * common >= percent * union):
            x, y = find(label[a[k]]), find(label[b[k]])
            if x != y:
                root[x] = y
                yield rows[a[k]]["rep"], rows[b[k]]["rep"]

    def run(batches):
        known = WordHashes()
        held: list[dict] = []

        def result():
            found = list(compare(held, known)) if len(held) > 1 else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            texts = utf8(batch, "text")
            for row, text in zip(batch.drop_columns(["text"]).to_pylist(), texts, strict=True):
                if held and (row["key"], row["i"], row["j"]) != (held[0]["key"], held[0]["i"], held[0]["j"]):
                    yield result()
                held.append(row | {"text": text})
        if held:
            yield result()

    return ordered.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    A-Z is read in lower case; words are what [\\x20\\x09-\\x0D] separates. A text of fewer words than
    `size` is one shingle; a text without words, or null, has none and is linked with nothing. Two
    documents are linked at 100 * intersection >= percent * union, and component_id is the smallest
    doc_id that links lead to. Rows of one doc_id are one document with several texts. A row with a null
    doc_id is linked with nothing: its component is null and it is kept. Reads `doc_id`, `text` only.
    """
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """`groups` with the columns text_hash and digest (of the set, null without words)."""
    rows = staged(prints(docs, size), "prints")
    named = rows.where("doc_id IS NOT NULL AND n > 0")
    equal = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    first = [named["digest"] == equal["digest"], named["doc_id"] == equal["rep"]]
    sets = staged(named.join(equal, first).select("rep", "n", "signature", "keys"), "sets")
    bands = sets.select(F.explode("keys").alias("key"), "rep")
    # The mask of the bucket's own key makes the choice differ between buckets.
    buckets = bands.groupBy("key").agg(
        F.count("*").alias("m"), F.min(F.col("rep").bitwiseXOR(F.col("key"))).bitwiseXOR(F.col("key")).alias("pivot")
    )
    joint = staged(bands.join(buckets.where("m > 1"), "key"), "buckets")
    candidates = joint.select("rep").distinct()
    texts = staged(
        docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(candidates, "rep", "left_semi"), "texts"
    )
    pairs = joint.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    links = staged(verify(staged(compare_signatures(pairs.distinct(), sets, percent), "pairs"), texts, size, percent), "links")

    label = components(links).toDF("rep", "label")
    labelled = joint.where("m > 2").join(label, "rep", "left").select("key", "rep", "m", F.coalesce("label", "rep").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    full = sets.select("rep", "n", "signature").join(texts, "rep")
    members = (
        labelled.join(open_keys.select("key"), "key", "left_semi")
        .select("key", "rep", "label", block.alias("block"), other.alias("other"))
        .select("key", "rep", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(full, "rep")
    )
    more = staged(compare_blocks(members, size, percent), "links")
    # A doc_id with different texts links the groups of all of them.
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low <> high")
    own = named.select("doc_id", "digest").join(several.select("doc_id"), "doc_id", "left_semi").join(equal, "digest").select("doc_id", "rep")
    final = components(links.union(more).union(own)).toDF("rep", "component")
    linked = (
        named.select("doc_id", "text_hash", "n", "digest")
        .join(equal, "digest")
        .join(final, "rep", "left")
        .select("doc_id", "text_hash", "digest", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = rows.where("doc_id IS NULL OR n = 0").select(
        "doc_id", "text_hash", "digest", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Rows up to which a table of ids and hashes, some 60 bytes each, is sent to all executors.
BROADCAST_ROWS = 500_000


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, that near-duplicates leave: of each group the document
    with the smallest id.

    Rows go that have words and an id that is not the smallest of its group, and of the rows of one id with
    one set of shingles all but one: that with the least hash of its text, of equal texts any one, since
    they are the same document. Rows of one id with different sets all stay, as do rows with a null id or
    without words.
    """
    found = staged(grouped(docs, size, percent).where("doc_id IS NOT NULL AND n_shingles > 0"), "groups")
    gone = found.where("NOT kept").select("doc_id", "text_hash")
    first = found.where("kept").groupBy("doc_id", "digest").agg(F.min("text_hash").alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1"), "repeated")
    again = found.where("kept").join(first, ["doc_id", "digest"])
    gone = gone.union(again.where("text_hash <> first").select("doc_id", "text_hash")).distinct()
    gone = staged(gone.toDF("_gone_id", "_gone_hash"), "gone")

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    same = (docs["doc_id"].cast("long") == F.col("_gone_id")) & (text_hash() == F.col("_gone_hash"))
    kept = docs.join(few(gone), same, "left_anti")
    once = again.where("text_hash = first").groupBy("doc_id", "text_hash").count().where("count > 1")
    if once.isEmpty():
        return kept
    # Rows of one id and one text: the same document several times.
    once = few(staged(once.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")), "once"))
    same = (kept["doc_id"].cast("long") == F.col("_gone_id")) & (text_hash() == F.col("_gone_hash"))
    repeated = kept.join(once, same, "left_semi").withColumn("_hash", text_hash())
    return kept.join(once, same, "left_anti").union(repeated.dropDuplicates(["doc_id", "_hash"]).drop("_hash"))
