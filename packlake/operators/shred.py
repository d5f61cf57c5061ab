"""XML parts to a table of tokens, and its validity test.

What needs the order of a document is folded while its part is tokenised (`operators.folds`); the rest
is filters over single tokens. So tokens are not brought together again after they have left the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.operators.folds import FOLDS, Fold

EVENT_SCHEMA = (
    "package string, path string, seq int, event string, qname string, local string, "
    "depth int, attrs array<struct<name:string,value:string>>, text string"
)
_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW_EVENT = pa.schema(
    [
        ("package", pa.string()),
        ("path", pa.string()),
        ("seq", pa.int32()),
        ("event", pa.string()),
        ("qname", pa.string()),
        ("local", pa.string()),
        ("depth", pa.int32()),
        ("attrs", _ATTRS),
        ("text", pa.string()),
    ]
)
_FLUSH_ROWS = 20_000
#: Parts up to this size that a task has met are remembered, this many of them: packages share most metadata parts.
SMALL_BYTES, SMALL_ENTRIES = 2048, 1024
_BOMS = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}


def _new_parser():
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.ordered_attributes = True
    # Entities that are not predefined are dropped, neither expanded nor an error.
    parser.UseForeignDTD(True)
    parser.DefaultHandler = lambda data: None
    return parser


def _utf8(data: bytes) -> bytes:
    encoding = _BOMS.get(data[:2])
    return data.decode(encoding).encode("utf-8") if encoding else data


class _Tokens:
    """Collects the tokens of one part; `keep` limits Start/Empty/End to some local names.

    Folds see each token when it is certain: a start tag waits for what follows, which may be the end
    of an empty element.
    """

    def __init__(
        self, data: bytes, keep: frozenset[str] | None, with_text: bool, folds: tuple[str, ...]
    ):
        self.data, self.keep, self.with_text = data, keep, with_text
        self.folds = [FOLDS[name](self.found) for name in folds]
        self.readers = [fold.text for fold in self.folds if type(fold).text is not Fold.text]
        # By qualified name: the local name, whether its tokens are kept, and what the folds do with it. A part
        # has few names and many tags.
        self.known: dict[str, tuple[str, bool, list[Callable]]] = {}
        #: The last start tag, while it may still be an empty element.
        self.waiting: tuple[list[Callable], str, list[str]] | None = None
        self.rows: list[tuple] = []
        self.seq = self.depth = 0
        self.opened = False  # the last callback was a start tag
        self.in_cdata = False
        self.parser = parser = _new_parser()
        parser.StartElementHandler = self.start
        parser.EndElementHandler = self.end
        # Text is always watched, to tell `<a></a>` from `<a>x</a>`.
        parser.CharacterDataHandler = self.text if with_text or folds else self.touch
        parser.StartCdataSectionHandler = self.cdata_start
        parser.EndCdataSectionHandler = self.cdata_end

    def about(self, qname):
        local = qname.rsplit(":", 1)[-1]
        told = [fold.element for fold in self.folds if local in fold.names]
        found = self.known[qname] = (local, self.keep is None or local in self.keep, told)
        return found

    def found(self, event: str, number: int, fields: list[tuple[str, str]], text: str | None):
        self.rows.append((number, event, None, None, 0, fields, text))

    def told(self):
        if self.waiting is not None:
            elements, local, attrs = self.waiting
            self.waiting = None
            for element in elements:
                element("Start", local, attrs)

    def start(self, qname, attrs):
        if self.waiting is not None:
            self.told()
        local, kept, elements = self.known.get(qname) or self.about(qname)
        if elements:
            self.waiting = (elements, local, attrs)
        if kept:
            self.rows.append((self.seq, "Start", qname, local, self.depth, list(zip(attrs[::2], attrs[1::2])), None))
        self.seq += 1
        self.depth += 1
        self.opened = True

    def end(self, qname):
        self.depth -= 1
        local, kept, elements = self.known[qname]
        if self.opened:
            self.opened = False
            at = self.parser.CurrentByteIndex
            if self.data[at - 2 : at] == b"/>":
                if kept:
                    row = self.rows.pop()
                    self.rows.append((row[0], "Empty", *row[2:]))
                if elements:
                    attrs = self.waiting[2]
                    self.waiting = None
                    for element in elements:
                        element("Empty", local, attrs)
                return
            if self.waiting is not None:
                self.told()
        if kept:
            self.rows.append((self.seq, "End", qname, local, self.depth, [], None))
        self.seq += 1
        for element in elements:
            element("End", local, ())

    def text(self, data):
        self.opened = False
        if not self.in_cdata:
            if self.waiting is not None:
                self.told()
            for read in self.readers:
                read(data)
            if self.with_text:
                self.rows.append((self.seq, "Text", None, None, self.depth, [], data))
            self.seq += 1

    def done(self):
        self.told()
        for fold in self.folds:
            fold.done()

    def touch(self, data):
        self.opened = False

    def cdata_start(self):
        self.opened = False
        self.in_cdata = True

    def cdata_end(self):
        self.in_cdata = False


def _at_end(error: expat.ExpatError) -> bool:
    """Input that just ends, without a root or within one, is no error; a cut tag is."""
    return error.code == expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS]


def _tokenise(
    data: bytes, keep: frozenset[str] | None, with_text: bool, folds: tuple[str, ...]
) -> Iterator[list[tuple] | str]:
    """Lists of tokens in document order; then, for a malformed part, why it is."""
    try:
        data = _utf8(data)
        tokens = _Tokens(data, keep, with_text, folds)
        if b"<" not in data:  # no root, only text
            if text := data.decode("utf-8-sig"):
                tokens.text(text)
            tokens.done()
            yield tokens.rows
            return
        step = 1 << 20
        view = memoryview(data)
        for at in range(0, len(data), step):
            tokens.parser.Parse(bytes(view[at : at + step]), False)
            if len(tokens.rows) >= _FLUSH_ROWS:
                # The last token stays: its own end tag may still turn it into `Empty`.
                yield tokens.rows[:-1]
                tokens.rows = tokens.rows[-1:]
        # What is still held back goes to the handlers at once: held text would be lost where the part just ends.
        tokens.parser.buffer_text = False
        try:
            tokens.parser.Parse(b"", True)
        except expat.ExpatError as error:
            if not _at_end(error):
                raise
        tokens.done()
        yield tokens.rows
    except (expat.ExpatError, UnicodeError) as error:
        yield str(error)


def tokens_of(data: bytes, names: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """`(local name, alternating names and values)` of the elements of one small part, none if it is malformed."""
    found: list[tuple[str, list[str]]] = []
    for tokens in _tokenise(data, frozenset(names), False, ()):
        if isinstance(tokens, str):
            return []
        for _, event, _, local, _, attrs, _ in tokens:
            if event in ("Start", "Empty"):
                found.append((local, [x for pair in attrs for x in pair]))
    return found


def shred_xml(
    parts: DataFrame,
    names: list[str] | None = None,
    with_text: bool = True,
    folds: tuple[str, ...] = (),
    only_at: dict[str, str] | None = None,
) -> DataFrame:
    """`(package, path, content[, read_error])` to tokens Start/Empty/End/Text, or one Error row.

    `names` keeps element tokens with these local names only: the projection a query needs,
    applied while tokenising. `folds` add the rows of these `operators.folds`; those in `only_at` of the part
    with that path alone. Empty elements are told from start tags. CDATA, comments and
    processing instructions give no row. A part that ends before its root does, or has none, keeps
    the tokens up to there. A null `content` gives an Unread row with its `read_error`, or none.
    """
    keep = frozenset(names) if names is not None else None
    only_at = only_at or {}
    common = tuple(fold for fold in folds if fold not in only_at)
    special = {path: tuple(fold for fold in folds if only_at.get(fold, path) == path) for path in only_at.values()}

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(SMALL_ENTRIES)
        def small(content: bytes, chosen: tuple[str, ...]) -> list[list[tuple] | str]:
            return list(_tokenise(content, keep, with_text, chosen))

        held = _Held()
        for batch in batches:
            packages, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, key in enumerate(zip(packages, paths, strict=True)):
                content = batch.column(2)[row].as_py()
                if content is None:
                    problem = batch.column(3)[row].as_py()
                    if problem is not None:
                        held.add(key, [(0, "Unread", None, None, 0, [], problem)])
                    continue
                # What a part gives is kept back, as Arrow batches, until the part is known to be sound.
                mark, parked = held.mark(), []
                chosen = special.get(key[1], common)
                if len(content) <= SMALL_BYTES:
                    found = small(content, chosen)
                else:
                    found = _tokenise(content, keep, with_text, chosen)
                for tokens in found:
                    if isinstance(tokens, str):
                        held.cut(mark)
                        parked = []
                        held.add(key, [(0, "Error", None, None, 0, [], tokens)])
                        continue
                    held.add(key, tokens)
                    if len(held.rows) >= _FLUSH_ROWS:
                        before, own = held.split(mark)
                        if before.rows:
                            yield before.batch()
                        if own.rows:
                            parked.append(own.batch())
                        held = _Held()
                        mark = held.mark()
                yield from parked
        if held.rows:
            yield held.batch()

    known = "read_error" in parts.columns
    read_error = F.col("read_error") if known else F.lit(None).cast("string").alias("read_error")
    content = F.col("content").cast("binary").alias("content")
    return parts.select("package", "path", content, read_error).mapInArrow(shred, EVENT_SCHEMA)


class _Held:
    """Tokens that have not left the task yet, and the parts they are of, with their numbers of tokens."""

    def __init__(self, parts: list[tuple[tuple[str, str], int]] = (), rows: list[tuple] = ()):
        self.parts, self.rows = list(parts), list(rows)

    def add(self, key: tuple[str, str], tokens: list[tuple]) -> None:
        if tokens:
            self.parts.append((key, len(tokens)))
            self.rows.extend(tokens)

    def mark(self) -> tuple[int, int]:
        return len(self.parts), len(self.rows)

    def cut(self, mark: tuple[int, int]) -> None:
        del self.parts[mark[0] :]
        del self.rows[mark[1] :]

    def split(self, mark: tuple[int, int]) -> tuple[_Held, _Held]:
        parts, rows = mark
        return _Held(self.parts[:parts], self.rows[:rows]), _Held(self.parts[parts:], self.rows[rows:])

    def batch(self) -> pa.RecordBatch:
        keys, counts = zip(*self.parts)
        at = pa.array(np.repeat(np.arange(len(keys)), counts))
        arrays = [pa.array(values, pa.string()).take(at) for values in zip(*keys)]
        fields = list(_ARROW_EVENT)[len(arrays) :]
        arrays += [pa.array(values, field.type) for values, field in zip(zip(*self.rows), fields, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_EVENT)


def found_rows(events: DataFrame, event: str) -> DataFrame:
    """Rows of one fold."""
    return events.filter(F.col("event") == event)


def part_failures(events: DataFrame) -> DataFrame:
    """Parts that could not be read or are not well-formed."""
    unread = events.filter(F.col("event") == "Unread").select(
        "package", "path", F.concat(F.col("path"), F.lit(": "), F.col("text")).alias("message")
    )
    return unread.unionByName(xml_errors(events))


def xml_errors(events: DataFrame) -> DataFrame:
    """Parts that are not well-formed."""
    return events.filter(F.col("event") == "Error").select(
        "package",
        "path",
        F.concat(F.col("path"), F.lit(": malformed XML: "), F.col("text")).alias("message"),
    )


def parse_error(data: bytes) -> str | None:
    """Why `data` is malformed, by the rules of `shred_xml`; null if it is not."""
    try:
        data = _utf8(data)
        if b"<" in data:
            _new_parser().Parse(data, True)
        else:
            data.decode("utf-8")
    except expat.ExpatError as error:
        return None if _at_end(error) else str(error)
    except UnicodeError as error:
        return str(error)
    return None


def _parse_errors(contents: pd.Series) -> pd.Series:
    return contents.map(lambda data: None if data is None else parse_error(data))


def xml_error(content: Column | str) -> Column:
    """Why `content` is not well-formed XML; null if it is, or is null. Row-local."""
    content = F.col(content) if isinstance(content, str) else content
    return F.pandas_udf(_parse_errors, "string")(content.cast("binary"))


def validate_xml(parts: DataFrame) -> DataFrame:
    """`(package, path, valid, message)` for every part given."""
    return parts.select("package", "path", xml_error("content").alias("_error")).select(
        "package",
        "path",
        F.col("_error").isNull().alias("valid"),
        F.concat(F.col("path"), F.lit(": malformed XML: "), F.col("_error")).alias("message"),
    )
