"""Sum-of-squares online packing of token sequences into windows.

A document longer than a window fills whole windows; what is left goes to the fill level h that
minimises the sum over levels of (number of open windows at that level) squared, which one array of
counts by level decides. A task packs the rows it reads, in their order, so nothing is shuffled.
When a task ends, or too many windows are open, the open ones are emptied and their pieces laid end
to end, cut freely, into full windows; the last remainder becomes windows whose sizes are powers of two.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from packlake.llm.common import column

WINDOW = 1024
#: Open windows a task keeps; beyond it, they are laid end to end. Bounds memory.
MAX_OPEN = 8192
#: Entries of a task's cache of encoded words; it is emptied beyond them. Bounds memory.
CACHE_ENTRIES = 400_000
SPECIAL = "<|endoftext|>"


class Encoder:
    """Text to its ids as little-endian unsigned 32-bit values; None or empty text to none.

    A text is cut before each space and line feed into words, " word" or "\\nword". Where no other white
    space stands at a cut, it is always a boundary of the tokenizer's pre-tokens, so each word has its
    own ids, which are kept in a cache; other texts are encoded whole. Ids come from a byte-pair encoder
    of the tokenizer's own vocabulary, in texts with the special token from the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values(), default=0) + 1, np.int64)
        for token, k in table.items():
            self.sizes[k] = len(token)
        self.path, self.full, self.load = tokenizer, None, Tokenizer.from_file
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if SPECIAL in text:
            self.full = self.full or self.load(self.path)
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> bool:
        """Puts the ids of words into the cache, unless one of them depends on its neighbours."""
        for word in words:
            body = word[1:] if word[:1] == "\n" else word
            if not body or body != body.strip():
                return False
        texts = [word if word[0] == "\n" else " " + word for word in words]
        ids = np.array(self.plain.encode_ordinary("".join(texts)), "<u4")
        ends = np.cumsum([len(text.encode()) for text in texts])
        cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()]
        raw = ids.tobytes()
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        self.known.update(zip(words, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        return True

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text or text[0].isspace():
            return self.whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            if not self.learn([w for w, ids in zip(words, found) if ids is None]):
                return self.whole(text)
            found = list(map(self.known.get, words))
            if None in found:  # the cache was emptied meanwhile
                return self.whole(text)
        if not first or first != first.strip():
            return self.whole(text)
        return self.whole(first) + b"".join(found)


class Packer:
    """Pieces are (document, start, ids, document length); closed windows go to `emit(pieces)`."""

    def __init__(self, emit, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.emit, self.window, self.max_open = emit, window, max_open
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def add(self, doc, ids: bytes) -> None:
        n, size = len(ids) // 4, self.window
        whole = n - n % size
        for start in range(0, whole, size):
            self.emit([(doc, start, ids[4 * start : 4 * (start + size)], n)])
        if rest := n - whole:
            self.place(rest, (doc, whole, ids[4 * whole :], n))

    def place(self, rest: int, piece: tuple) -> None:
        size, count = self.window, self.count
        # Change of the sum of squares for each level h that can take the piece; level `size` is never
        # open, so a window that becomes full adds nothing, and one that is new takes nothing away.
        change = count[rest:] - count[: size + 1 - rest]
        usable = count[: size + 1 - rest] > 0
        usable[0] = True
        change = np.where(usable, 2 * change + 2, np.iinfo(np.int64).max)
        change[0] -= 1
        change[-1] -= 1
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
        if level:
            pieces = self.open[level].pop()
            count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + rest == size:
            self.emit(pieces)
        else:
            self.open[level + rest].append(pieces)
            count[level + rest] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.close(last=False)

    def close(self, last: bool = True) -> None:
        """Empties all open windows into full ones; the remainder goes back to its level, or if `last`
        into windows of the powers of two it is made of."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0
        total = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.window] * (total // self.window)
        left = total % self.window
        if last:
            sizes += [1 << k for k in reversed(range(self.window.bit_length())) if left >> k & 1]
        elif left:
            sizes.append(left)
        todo = iter(pieces)
        piece = next(todo, None)
        for size in sizes:
            taken, room = [], size
            while room:
                doc, start, ids, n = piece
                cut = min(room, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * cut], n))
                room -= cut
                piece = (doc, start + cut, ids[4 * cut :], n) if 4 * cut < len(ids) else next(todo, None)
            if size == self.window or last:
                self.emit(taken)
            else:
                self.open[size].append(taken)
                self.count[size] += 1
                self.n_open += 1


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then the id 0, so a null or empty text is that id alone. Repeated rows
    are packed one by one, a null id stays null, no rows give no rows. Reads `doc_id` and `text` only.
    A sequence's id holds its task's number, so it is the same when a lost task runs again.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches):
        encode = Encoder(tokenizer, ranks, pattern)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        arrow = None

        def emit(pieces):
            nonlocal number
            at = 0
            for doc, start, ids, n in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, number, at))
                at += len(ids) // 4
            number += 1

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, arrow if k == 0 else pa.int64()) for k, c in enumerate(columns)], list(names)
            )

        packer = Packer(emit, window, max_open)
        for batch in batches:
            arrow = batch.column("doc_id").type
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                packer.add(doc, encode(text) + b"\0\0\0\0")
            if rows:
                yield flush()
        packer.close()
        if rows:
            yield flush()

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in names[1:]))
