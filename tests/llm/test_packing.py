"""Packing: every id once, sequences without gaps, ids as the tokenizer gives them."""

import random
import zlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packlake.llm import packing

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
FULL = Tokenizer.from_file(FILES[0])
ENCODER = packing.Encoder(*FILES)


def ids(text):
    return [*FULL.encode(text or "", add_special_tokens=False).ids, 0]


def raw(values):
    return b"".join(i.to_bytes(4, "little") for i in values)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB é\n\t .!'s1  \x1c字<|>")), max_size=40))
def test_encoder(text):
    assert ENCODER(text) == raw(ids(text)[:-1])


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b\nc", "x  y", " lead", "trail ", "a\n\nb", "a\r\nb", "don't 've 12ab", "​ a \u0085 b", ""])
def test_encoder_cases(text):
    assert ENCODER(text) == raw(ids(text)[:-1])


def check(rows, pieces):
    """`pieces` hold the ids of `rows` (doc_id, ids), each once, in sequences without gaps."""
    want = {d: i for d, i in rows}
    got = {}
    sequences = {}
    for r in pieces:
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and 0 < r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(raw(own[r.start : r.start + r.length]))
        got.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sorted(p) for d, p in got.items()} == {d: list(range(len(i))) for d, i in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding at all


@pytest.mark.parametrize("max_open", [packing.MAX_OPEN, 3])
def test_pack(spark, max_open):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "caté", "xyzzy", "a\nb", "12"], k=rng.randrange(0, 900))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate([None, "", *texts, "long " * 20_000])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string").repartition(3)
    pieces = packing.pack(docs, *FILES, max_open=max_open).collect()
    check([(d, ids(t)) for d, t in rows], pieces)
    assert packing.pack(docs.limit(0), *FILES).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    pieces = packing.pack(docs, *FILES).collect()
    assert sum(r.length for r in pieces if r.doc_id is None) == 2 * len(ids("a b"))
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 * len(ids("c"))


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(1)
    closed = []
    packer = packing.Packer(closed.append, window=16)
    for k in range(500):
        before = packer.count.copy()
        n = rng.randrange(1, 16)
        packer.add(k, b"\0\0\0\0" * n)
        squares = []
        for level in range(0, 17 - n):
            if level and not before[level]:
                continue
            after = before.copy()
            if level:
                after[level] -= 1
            if level + n < 16:
                after[level + n] += 1
            squares.append(int((after**2).sum()))
        assert int((packer.count**2).sum()) == min(squares)
    packer.close()
    assert sum(len(p[2]) // 4 for w in closed for p in w) == sum(w for w in [len(p[2]) // 4 for s in closed for p in s])
