"""The pipeline on a small corpus with one case for each stage, against plain code."""

import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def prose(seed, n=60):
    return " ".join(f"{'abcdefghij'[(k * seed) % 10] * (1 + k % 5)}{seed * k % 97}x" for k in range(n))


PASSAGE = " ".join(f"question{k}" for k in range(30))


def corpus():
    base = prose(3)
    return [
        (1, base), (2, base + " more"), (3, base), (4, prose(7) + " " + PASSAGE), (5, prose(11) + ' password="hunter2hunter2"'),
        (6, "too short"), (7, None), (8, prose(13) + " #### $$$$ %%%% ####"), (9, prose(17)), (9, prose(17)),
    ]


def test_pipeline(spark, tmp_path):
    rows = [(k, t, "en", "src", len(t or ""), "extra") for k, t in corpus()]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names.replace(" long", "").replace(" string", "").split(", ")
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen == [[1, 2, 3, 4, 5, 9, 9], [1, 4, 5, 9], [1, 5, 9], [1, 5, 9]]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts == {1: prose(3), 5: prose(11) + ' [SECRET]"', 9: prose(17)}
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = ids_of(texts[r.doc_id])
        assert r.doc_tokens == len(ids)
        part = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        pieces.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: list(range(len(ids_of(t)))) for d, t in texts.items()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
