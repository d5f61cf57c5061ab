"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.llm import (
    conversations,
    decontaminate,
    hard_negatives,
    html_extract,
    langid,
    lm_scoring,
    neardup,
    packing,
    pieces,
    quality,
    secrets,
    toxicity,
    warc,
)
from packlake.llm.common import is_held_out, remainder, table
from packlake.session import shared_dir


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~is_held_out("doc_id", 5))
    labels = labels.select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit([tuple(r) for r in toxicity.training_rows(docs, labels).collect()])
    return toxicity.score(docs, model).select(
        "doc_id",
        is_held_out("doc_id", 5).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
        "offending",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), size=4, percent=80)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(
        table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the base rules; then the ledger of that run is there for a second one with all rules,
    which scans the pairs of blobs and rules that it lacks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    folder = shared_dir(spark, "ledger")
    secrets.update(docs, rules=secrets.RULES)[1].write.parquet(folder)
    addressed, new = secrets.update(docs, folder, rules=secrets.ALL_RULES)
    found = secrets.findings(addressed, secrets.read_ledger(spark, folder).unionByName(new), rules=secrets.ALL_RULES)
    base = [rule.kind for rule in secrets.RULES]

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base_spans = named(F.filter("found", lambda s: s["kind"].isin(*base)))
    return found.select(
        F.col("path").alias("doc_id"), *map(count, base), F.sha2(base_spans, 256).alias("base_sha256"), named("found").alias("spans")
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Only ids with a remainder are learned from; a null id has none.
    docs = docs.select("doc_id", "text", is_held_out("doc_id", 10).alias("held_out"))
    return lm_scoring.score(docs, learn=remainder("doc_id", 10) != 0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, *langid.train(docs.where(remainder("doc_id", 4) != 2)))
    return found.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(table(spark, sf_dir, "documents"), features=True)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.noisy(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_packing": op4_packing,
    "op5_html": op5_html,
    "op6_warc": op6_warc,
    "op7_secrets": op7_secrets,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_pieces": op12_pieces,
    "op13_hard_negatives": op13_hard_negatives,
}
