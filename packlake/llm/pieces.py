"""SentencePiece encoding with merge-type vocabularies by a score-ordered agenda, and decoding.

A text is cut where no piece of the vocabulary can reach across, so each segment has ids of its own. In a
segment, an agenda holds the adjacent pairs of symbols that together are a piece, best score first and of
equal scores the leftmost; the first pair is merged, its new neighbours join the agenda, and entries whose
symbols have changed meanwhile are gone. The agendas of short segments are the rows of a matrix, whose
first entries are found and merged together; a longer segment has a heap. In every Arrow batch the
sentencepiece library encodes the segments that were not met before and decodes the ids of all texts;
`agrees` says whether both are as expected.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain, filterfalse
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packlake.llm.common import column

SPACE = "▁"
#: Segments a task keeps with their ids; the table is emptied beyond them. Longer segments are not kept.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: Segments of more characters have a heap; of the others, so many are merged together.
SHORT, TOGETHER = 48, 8192
NEVER = np.iinfo(np.int32).max
#: No symbol; below all characters that are no piece.
NONE = -(1 << 30)
#: Characters of text that are encoded, checked and decoded together.
BATCH_CHARS = 4_000_000


class Vocabulary:
    """What the agenda needs of a model file: pieces that can be merged, with their rank and id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = model.SentencePiece
        text, train = model.normalizer_spec, model.trainer_spec
        if (
            train.model_type != train.BPE
            or not train.byte_fallback
            or train.treat_whitespace_as_suffix
            or text.precompiled_charsmap
            or text.remove_extra_whitespaces
            or not text.escape_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        ):
            raise ValueError("only merge-type vocabularies with byte fallback and plain text are known")
        self.prefix = SPACE if text.add_dummy_prefix else ""
        self.library = SentencePieceProcessor(model_file=path)
        model.normalizer_spec.add_dummy_prefix = False
        self.bare_library = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.ranks = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        # The same for symbols by number: of characters, of pairs, and of what a pair becomes.
        self.size = len(model.pieces)
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)  # a character that is no piece
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = k
        pairs = {
            self.ids[piece[:cut]] * self.size + self.ids[piece[cut:]]: k
            for piece, k in self.ids.items()
            for cut in range(1, len(piece))
            if piece[:cut] in self.ids and piece[cut:] in self.ids
        }
        self.pair = np.array([*sorted(pairs), NEVER * self.size], np.int64)
        self.becomes = np.array([*(pairs[k] for k in sorted(pairs)), -1], np.int64)
        scores = sorted(set(self.ranks.values()))
        place = dict(zip(scores, range(len(scores)), strict=True))
        self.rank = np.full(self.size + 1, NEVER, np.int32)  # the last one: no piece, -1
        for piece, k in self.ids.items():
            self.rank[k] = place[self.ranks[piece]]
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        joined = [p for p in self.ids if len(p) > 1]
        # Characters that are in no longer piece stand alone; where no piece has a space mark after
        # another character, a segment ends before a space mark.
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in joined))
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            self.segments = re.compile(f"[{alone}]|[^{alone}]+" if alone else r"[\s\S]+")
        else:
            self.segments = re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def merge(self, segments: list[str]) -> list[tuple[int, ...]]:
        """The ids of segments."""
        found: list = [None] * len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(sizes, kind="stable")
        n_short = int((sizes <= SHORT).sum())
        short = order[:n_short].tolist()
        for start in range(0, len(short), TOGETHER):
            chosen = short[start : start + TOGETHER]
            for k, ids in zip(chosen, self.together([segments[k] for k in chosen]), strict=True):
                found[k] = ids
        for k in order[n_short:].tolist():
            found[k] = tuple(self.spelled([self.ids.get(s, -1 - ord(s[0])) for s in self.queued(segments[k])]))
        return found

    def spelled(self, symbols: list[int]) -> list[int]:
        """Characters that are no piece become the ids of their bytes."""
        return [i for k in symbols for i in ([k] if k >= 0 else map(self.bytes.get, chr(-1 - k).encode()))]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols become, -1 where they are no piece."""
        wanted = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.searchsorted(self.pair, wanted)
        return np.where(self.pair[at] == wanted, self.becomes[at], -1)

    def together(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of segments of about one length. A row holds the symbols of a segment and the rank of what each
        and the next one become; the least rank, of equal ones the first, is the head of its agenda."""
        sizes = np.array([len(s) for s in segments])
        width = int(sizes.max()) + 1
        filled = np.arange(width) < sizes[:, None]
        symbols = np.full((len(segments), width), NONE, np.int64)
        symbols[filled] = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        rank = self.rank[self.joined(symbols[:, :-1], symbols[:, 1:])]
        ids: list = [None] * len(segments)
        rows = np.arange(len(segments))
        while len(rows):
            head = rank.argmin(axis=1)
            going = rank[np.arange(len(rows)), head] < NEVER
            for k, row in zip(rows[~going].tolist(), symbols[~going].tolist(), strict=True):
                row = row[: row.index(NONE)]
                ids[k] = tuple(row if min(row) >= 0 else self.spelled(row))
            rows, symbols, rank, head = rows[going], symbols[going], rank[going], head[going]
            every = np.arange(len(rows))
            merged = self.joined(symbols[every, head], symbols[every, head + 1])
            symbols[every, head] = merged
            # All rows lose the second symbol of their pair; the last column only holds NONE.
            stays = np.ones(symbols.shape, bool)
            stays[every, head + 1] = False
            symbols = symbols[stays].reshape(len(rows), symbols.shape[1] - 1)
            rank = rank[stays[:, 1:]].reshape(len(rows), rank.shape[1] - 1)
            rank[every, head] = self.rank[self.joined(merged, symbols[every, head + 1])]
            inner = np.flatnonzero(head)
            at = head[inner]
            rank[inner, at - 1] = self.rank[self.joined(symbols[inner, at - 1], merged[inner])]
        return ids

    def queued(self, segment: str) -> list[str]:
        """Symbols of a segment; the agenda is a heap of (rank, left symbol, size of the pair)."""
        n, find = len(segment), self.ranks.get
        symbols = list(segment)
        following = list(range(1, n + 1))
        before = list(range(-1, n))
        pairs = enumerate(map(find, map(add, segment, segment[1:])))
        agenda = [(rank, left, 2) for left, rank in pairs if rank is not None]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            right = following[left]
            piece = symbols[left]
            # Either symbol was merged with another meanwhile.
            if not piece or right == n or len(piece) + len(symbols[right]) != size:
                continue
            symbols[left] = piece = piece + symbols[right]
            symbols[right] = ""
            following[left] = right = following[right]
            before[right] = left
            if right < n and (rank := find(piece + symbols[right])) is not None:
                heappush(agenda, (rank, left, size + len(symbols[right])))
            if (left := before[left]) >= 0 and (rank := find(symbols[left] + piece)) is not None:
                heappush(agenda, (rank, left, size + len(symbols[left])))
        return [symbol for symbol in symbols if symbol]


class Encoder:
    """Texts to ids, with a bounded table of segments that were met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: segment to its ids, and to these as text
        self.known: dict[str, tuple[int, ...]] = {}
        self.listed: dict[str, str] = {}
        #: segments of which the library has other ids
        self.wrong: set[str] = set()

    def learn(self, segments: list[str]) -> None:
        own = self.vocabulary.merge(segments)
        expected = self.vocabulary.bare_library.encode(segments, num_threads=1)
        self.wrong.update(s for s, a, b in zip(segments, own, expected, strict=True) if a != tuple(b))
        self.known.update(zip(segments, own, strict=True))
        self.listed.update(zip(segments, [",".join(map(str, ids)) for ids in own], strict=True))

    def __call__(self, texts: list[str]) -> list[tuple[list[int], str, bool]]:
        """Ids, ids as text joined by commas, and whether the library has the same, of each text."""
        cut, prefix = self.vocabulary.segments.findall, self.vocabulary.prefix
        segments = [cut(prefix + text.replace(" ", SPACE)) if text else [] for text in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
            self.listed.clear()
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(segments))))
        self.learn(new)
        ids_of, listed_of, found = self.known.__getitem__, self.listed.__getitem__, []
        for these in segments:
            ids = list(chain.from_iterable(map(ids_of, these)))
            found.append((ids, ",".join(map(listed_of, these)), not self.wrong or self.wrong.isdisjoint(these)))
        for segment in new:
            if len(segment) > CACHE_CHARS:
                del self.known[segment], self.listed[segment]
        return found


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded, agrees) of every row of `docs`, by its columns doc_id and text.

    `decoded` is the library's decoding of the ids, `agrees` is whether the library has the same ids and
    the decoded text is the text. A null or empty text has no ids and decodes to the empty text. Repeated
    rows and null ids give a row each, no rows give no rows; other columns, whatever their names, are not
    read. Texts are taken whole: a batch is closed by its characters, so the longest text bounds memory.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for doc_ids, ids, _, decoded, agrees in _texts(batches, model):
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                ["doc_id", "ids", "decoded", "agrees"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """`encode` with hashes in the place of ids and texts: (doc_id, n_tokens, ids_sha256, decoded_sha256, agrees)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sha256(texts):
        return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())

    def run(batches):
        for doc_ids, ids, listed, decoded, agrees in _texts(batches, model):
            counts = pa.array(list(map(len, ids)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, counts, sha256(listed), sha256(decoded), pa.array(agrees, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
            )

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _texts(batches, model: str):
    """(doc ids, ids, ids as text, decoded, agrees) of slices of at most about BATCH_CHARS characters."""
    vocabulary = Vocabulary(model)
    encoder = Encoder(vocabulary)
    for batch in batches:
        texts = [text or "" for text in column(batch, "text")]
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            part = texts[start:end]
            ids, listed, same = zip(*encoder(part), strict=True)
            decoded = vocabulary.library.decode(list(ids), num_threads=1)
            agrees = [s and d == t.replace(SPACE, " ") for s, d, t in zip(same, decoded, part, strict=True)]
            yield batch.column("doc_id").slice(start, end - start), ids, listed, decoded, agrees
            start = end
