"""What document operators take from one part, gathered while it is tokenised.

A fold sees the tokens of a part in document order and keeps the little state its question needs, so
titles, texts, strings and cells leave the tokeniser whole: tokens are neither written nor moved. Its
rows have the columns of the token table, with an event of their own, a number, fields and a text.
"""

from __future__ import annotations

from collections.abc import Callable


#: Cells of a worksheet that a report shows.
SAMPLE_CELLS = 20


def attribute(attrs: list[str], name: str) -> str | None:
    """The rule of `functions.xml.xml_attr`, over alternating names and values."""
    local = name.rsplit(":", 1)[-1]
    second = None
    for k in range(0, len(attrs), 2):
        own = attrs[k]
        if own == name:
            return attrs[k + 1]
        if second is None and own.rsplit(":", 1)[-1] == local and (":" not in name or ":" in own):
            second = attrs[k + 1]
    return second


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


class Fold:
    #: Local names of the elements it sees; text is seen by all.
    names: frozenset[str] = frozenset()

    def __init__(self, emit: Callable[..., None]):
        self.emit = emit

    def element(self, event: str, local: str, attrs: list[str]) -> None:
        """`event` is Start, Empty or End."""

    def text(self, data: str) -> None:
        """A piece of character data outside CDATA sections."""

    def done(self) -> None:
        """The part has ended, perhaps before its root."""


class Titles(Fold):
    """Title: text after the title mark of each closed top-level shape that has one, with the shape's number."""

    names = frozenset(("sp", "ph"))
    inside = shape = 0
    marked = False
    pieces: list[str] = []

    def element(self, event, local, attrs):
        if local == "ph":
            kind = attribute(attrs, "type") if event != "End" else None
            if kind is not None and ascii_lower(kind) in ("title", "ctrtitle") and self.inside > 0:
                self.marked = True
        elif event == "Start":
            self.inside += 1
            if self.inside == 1:
                self.shape, self.marked, self.pieces = self.shape + 1, False, []
        elif event == "End":
            self.inside -= 1
            if self.inside == 0 and self.marked:
                self.emit("Title", self.shape, [], "".join(self.pieces))
                self.marked = False

    def text(self, data):
        if self.marked:
            self.pieces.append(data)


class Whole(Fold):
    """Whole: all text of the part; parts without text give no row."""

    def __init__(self, emit):
        super().__init__(emit)
        self.pieces: list[str] = []

    def text(self, data):
        self.pieces.append(data)

    def done(self):
        if self.pieces:
            self.emit("Whole", 0, [], "".join(self.pieces))


class Paragraphs(Fold):
    """Counts: start tags of paragraphs (`<p/>` is none) and tables."""

    names = frozenset(("p", "tbl"))
    paragraphs = tables = 0

    def element(self, event, local, attrs):
        if local == "p":
            self.paragraphs += event == "Start"
        else:
            self.tables += event != "End"

    def done(self):
        self.emit("Counts", 0, [("paragraphs", str(self.paragraphs)), ("tables", str(self.tables))], None)


class Headings(Fold):
    """Heading: each stretch that a paragraph start opens and a paragraph end closes, with its last style."""

    names = frozenset(("p", "pStyle", "t"))
    inside = in_text = False
    stretch = 0
    style: str | None = None
    pieces: list[str] = []

    def element(self, event, local, attrs):
        if local == "t":
            if event == "End":
                self.in_text = False
            elif event == "Start" and self.inside:
                self.in_text = True
        elif local == "pStyle":
            if event != "End":
                self.style = attribute(attrs, "w:val")
        elif event != "Empty":
            if self.inside and event == "End" and self.style is not None:
                self.emit("Heading", self.stretch, [("style", self.style)], "".join(self.pieces))
            self.inside = event == "Start"
            self.stretch, self.style, self.pieces = self.stretch + 1, None, []

    def text(self, data):
        if self.inside and self.in_text:
            self.pieces.append(data)


class Strings(Fold):
    """String: text of each closed `si`, numbered from 0; a nested one repeats the inner text."""

    names = frozenset(("si", "t"))
    inside = in_text = False
    closed = 0

    def __init__(self, emit):
        super().__init__(emit)
        self.pieces: list[str] = []
        self.ends: list[int] = []

    def element(self, event, local, attrs):
        if local == "t":
            if event == "End":
                self.in_text = False
            elif event == "Start" and self.inside:
                self.in_text = True
        elif event == "Start":
            self.done()
            self.inside = True
        elif event == "End":
            self.inside = False
            self.ends.append(self.closed)
            self.closed += 1

    def text(self, data):
        if self.in_text:
            self.pieces.append(data)

    def done(self):
        for number in self.ends:
            self.emit("String", number, [], "".join(self.pieces))
        self.pieces, self.ends = [], []


class Cells(Fold):
    """Cell: reference, type, formula and value of each closed or empty cell, numbered from 1.

    Text belongs to the last of `v`, `f`, `t` opened inside a cell and not closed since.
    """

    names = frozenset(("c", "v", "f", "t"))
    inside = False
    field = ""
    number = 0
    head: list[tuple[str, str]] = []

    def __init__(self, emit):
        super().__init__(emit)
        self.values: list[str] = []
        self.formulas: list[str] = []

    def cell(self, head, values, formulas):
        self.number += 1
        if formulas:
            head = [*head, ("f", "".join(formulas))]
        self.emit("Cell", self.number, head, "".join(values))

    def element(self, event, local, attrs):
        if local == "c":
            if event == "End":
                if self.inside:
                    self.cell(self.head, self.values, self.formulas)
                self.inside = False
                return
            if len(attrs) == 2 and attrs[0] == "r":  # as most cells have it
                head = [("r", attrs[1])]
            else:
                kind = attribute(attrs, "t")
                head = [("r", attribute(attrs, "r") or "")] + ([("t", kind)] if kind is not None else [])
            if event == "Empty":
                self.cell(head, [], [])
            else:
                self.inside, self.head, self.values, self.formulas = True, head, [], []
        elif event == "End":
            self.field = ""
        elif event == "Start" and self.inside:
            self.field = "f" if local == "f" else "v"

    def text(self, data):
        if self.inside and self.field == "v":
            self.values.append(data)
        elif self.inside and self.field == "f":
            self.formulas.append(data)


class Formulas(Cells):
    """Cell: as Cells, of those with a formula alone; all are numbered."""

    def cell(self, head, values, formulas):
        if formulas:
            super().cell(head, values, formulas)
        else:
            self.number += 1


class Sheet(Cells):
    """Sheet: last declared range, numbers of cells and of formulas of a part with any of them, which takes
    no row for each cell; Cell: as Cells, of the first `shown` alone."""

    names = Cells.names | {"dimension"}
    shown = 0
    formula_count = 0
    declared = False
    range: str | None = None

    def cell(self, head, values, formulas):
        self.formula_count += bool(formulas)
        if self.number < self.shown:
            super().cell(head, values, formulas)
        else:
            self.number += 1

    def element(self, event, local, attrs):
        if local != "dimension":
            super().element(event, local, attrs)
        elif event != "End":
            self.declared, self.range = True, attribute(attrs, "ref")

    def done(self):
        if self.declared or self.number:
            fields = [("cells", str(self.number)), ("formulas", str(self.formula_count))]
            self.emit("Sheet", 0, fields, self.range)


class Shown(Sheet):
    """Sheet with the cells that a report shows."""

    shown = SAMPLE_CELLS


class Names(Fold):
    """Name: attributes and text of each closed defined name, numbered from 1."""

    names = frozenset(("definedName",))
    inside = False
    number = 0
    attrs: list[str] = []
    pieces: list[str] = []

    def element(self, event, local, attrs):
        if event == "Start":
            self.inside, self.attrs, self.pieces = True, attrs, []
        elif event == "End" and self.inside:
            self.inside = False
            self.number += 1
            known = [(name, attribute(self.attrs, name)) for name in ("name", "localSheetId")]
            self.emit("Name", self.number, [pair for pair in known if pair[1] is not None], "".join(self.pieces))

    def text(self, data):
        if self.inside:
            self.pieces.append(data)


class Styles(Fold):
    """Style: id, parent and own outline level of each closed style, numbered from 1; the text is its name."""

    names = frozenset(("style", "basedOn", "outlineLvl", "name"))
    number = 0
    fields: dict[str, str | None] | None = None

    def element(self, event, local, attrs):
        if local == "style":
            if event != "End":
                self.fields = {"styleId": attribute(attrs, "w:styleId")}
            if event != "Start" and self.fields is not None:
                self.number += 1
                name = self.fields.pop("name", None)
                self.emit("Style", self.number, [(k, v) for k, v in self.fields.items() if v is not None], name)
                self.fields = None
        elif self.fields is not None and event != "End":
            self.fields[local] = attribute(attrs, "w:val")


class Outlines(Headings):
    """Outline: as Heading, of every paragraph with a style or an outline level of its own."""

    names = frozenset(("p", "pStyle", "outlineLvl", "t"))
    outline: str | None = None

    def element(self, event, local, attrs):
        if local == "outlineLvl":
            if event != "End":
                self.outline = attribute(attrs, "w:val")
            return
        if local == "p" and event == "End" and self.inside:
            fields = [(k, v) for k, v in (("style", self.style), ("outlineLvl", self.outline)) if v is not None]
            if fields:
                self.emit("Outline", self.stretch, fields, "".join(self.pieces))
            self.style = None  # so that the heading is not told as well
        if local == "p" and event != "Empty":
            self.outline = None
        super().element(event, local, attrs)


class Links(Fold):
    """Link: each hyperlink and field, numbered by where it starts; `depth` counts those open around it.

    A field's instruction lies between its begin and separate marks, its text between separate and end;
    text of an inner link belongs to all around it. A field may end outside of the element it began in, so
    ends close the last open one of their kind; what is not closed in the part has `closed` 0, marks
    without a field are nothing.
    """

    names = frozenset(("hyperlink", "fldSimple", "fldChar", "instrText", "t"))
    number = 0
    reading: str | None = None

    def __init__(self, emit):
        super().__init__(emit)
        self.open: list[dict] = []

    def begin(self, kind: str, in_text: bool, **fields: str | None) -> None:
        self.number += 1
        self.open.append(
            {"kind": kind, "number": self.number, "depth": len(self.open) + 1, "in_text": in_text}
            | {"fields": fields, "instruction": [], "text": []}
        )

    def last(self, kind: str) -> dict | None:
        return next((link for link in reversed(self.open) if link["kind"] == kind), None)

    def close(self, link: dict, closed: bool = True) -> None:
        instruction = "".join(link["instruction"])
        fields = {"kind": link["kind"].lower(), "depth": str(link["depth"]), "closed": str(int(closed))} | link["fields"]
        if instruction:
            fields["instruction"] = instruction
        text = "".join(link["text"])
        self.emit("Link", link["number"], [(k, v) for k, v in fields.items() if v is not None], text)

    def end(self, kind: str) -> None:
        if link := self.last(kind):
            self.open.remove(link)
            self.close(link)

    def element(self, event, local, attrs):
        if local in ("t", "instrText"):
            self.reading = local if event == "Start" else None
        elif local == "hyperlink":
            if event != "End":
                self.begin("Hyperlink", True, id=attribute(attrs, "r:id"), anchor=attribute(attrs, "w:anchor"))
            if event != "Start":
                self.end("Hyperlink")
        elif local == "fldSimple":
            if event != "End":
                self.begin("Simple", True, instruction=attribute(attrs, "w:instr"))
            if event != "Start":
                self.end("Simple")
        elif event != "End":
            mark = attribute(attrs, "w:fldCharType")
            if mark == "begin":
                self.begin("Field", False)
            elif mark == "separate" and (link := self.last("Field")):
                link["in_text"] = True
            elif mark == "end":
                self.end("Field")

    def text(self, data):
        if self.reading == "t":
            for link in self.open:
                if link["in_text"]:
                    link["text"].append(data)
        elif self.reading == "instrText":
            field = self.last("Field")
            if field and not field["in_text"]:
                field["instruction"].append(data)

    def done(self):
        for link in self.open:
            self.close(link, closed=False)
        self.open = []


FOLDS: dict[str, type[Fold]] = {
    "titles": Titles,
    "whole": Whole,
    "paragraphs": Paragraphs,
    "headings": Headings,
    "strings": Strings,
    "cells": Cells,
    "formulas": Formulas,
    "sheet": Sheet,
    "shown": Shown,
    "names": Names,
    "styles": Styles,
    "outlines": Outlines,
    "links": Links,
}
