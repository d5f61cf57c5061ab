"""Pieces by the agenda: the library's ids of whole texts, and of odd ones."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from packlake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "▁", "▁▁▁a", "a▁ b", " x", "x ", "\n\n a\t\r\n", "a  b\n c", "<s> </s> <0x0A> <unk>", "\0", "é́ x😀",
    "全角　文字", "a" * 3000, "ab" * 500 + " " * 100 + "\n" * 50, "supercalifragilistic" * 9, " x y", "😀" * 40,
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_odd_texts(vocabulary, library):
    found = pieces.Encoder(vocabulary)(ODD)
    assert [f[0] for f in found] == library.encode(ODD)
    assert all(f[2] for f in found)
    assert [f[1] for f in found] == [",".join(map(str, ids)) for ids in library.encode(ODD)]


@given(st.lists(st.text(st.sampled_from("abcdeé ▁\n\tthin.,!0💡ß"), max_size=80), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text(vocabulary, library, texts):
    assert [f[0] for f in pieces.Encoder(vocabulary)(texts)] == library.encode(texts)


@given(st.text(st.sampled_from("aehinrst▁ ."), min_size=1, max_size=pieces.SHORT))
@settings(max_examples=150, deadline=None)
def test_heap_and_matrix_agree(vocabulary, segment):
    (ids,) = vocabulary.together([segment])
    assert list(ids) == vocabulary.spelled([vocabulary.ids.get(s, -1 - ord(s[0])) for s in vocabulary.queued(segment)])


def test_small_table_of_segments(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 4)
    encoder, texts = pieces.Encoder(vocabulary), ["one two three four", "two five " * 5, "one " * 30]
    for _ in range(3):
        assert [f[0] for f in encoder(texts)] == library.encode(texts)
    assert all(len(s) <= 4 for s in encoder.known)


def test_disagreement_is_reported(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    encoder(["some words"])
    encoder.wrong.add("▁words")
    assert [f[2] for f in encoder(["other words", "other"])] == [False, True]


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    other = tmp_path / "unigram.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(other))


def test_rows(spark, library, monkeypatch):
    rows = [(k, text, "clash") for k, text in enumerate(ODD)] + [(None, None, "x"), (3, ODD[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted(pieces.encode(docs, MODEL).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(found) == len(rows) and all(r["agrees"] for r in found)
    for row in found:
        text = ODD[row["doc_id"]] if row["doc_id"] is not None else ""
        assert row["ids"] == library.encode(text) and row["decoded"] == library.decode(row["ids"])
    digests = {r["doc_id"]: r for r in pieces.digests(docs, MODEL).collect()}
    for k, text in enumerate(ODD):
        ids = library.encode(text)
        assert digests[k]["n_tokens"] == len(ids)
        assert digests[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert not pieces.encode(docs, MODEL).collect() and not pieces.digests(docs, MODEL).collect()


def test_query_has_the_ids_of_whole_texts(spark, library):
    """All documents of the smallest tables, against the library text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, MODEL).collect()}
    for doc_id, text in docs.collect():
        assert found[doc_id] == library.encode(text or "")
