"""Merged and named ranges, formulas, inheritance, fields and hyperlinks."""

import random

import pytest
import pyarrow as pa
from helpers import one, rels_xml, rows, xml_parts
from pyspark.sql import functions as F

from packlake.operators import formulas, inheritance, links, ranges
from packlake.operators import index as I
from packlake.operators import presentation as S
from packlake.operators import workbook as W
from packlake.plans import adapters as A
from packlake.plans.queries import QUERIES


@pytest.mark.parametrize(
    "text, want",
    [
        ("A1", (1, 1, 1, 1)),
        ("$b$2:AA10", (2, 2, 10, 27)),
        ("D9:B2", (2, 2, 9, 4)),
        ("A:C", (1, 1, 1048576, 3)),
        ("$3:5", (3, 1, 5, 16384)),
        ("XFD1048576", (1048576, 16384, 1048576, 16384)),
        ("XFE1", None),
        ("A1048577", None),
        ("A0", None),
        ("A", None),
        ("7", None),
        ("A1:B", None),
        ("A1:2", None),
        ("", None),
        ("Sheet!A1", None),
        (None, None),
    ],
)
def test_rectangle(spark, text, want):
    df = spark.createDataFrame([(text,)], "r string").select(ranges.rectangle("r").alias("at"))
    got = df.first()["at"]
    assert (tuple(got) if got else None) == want


def test_column_letters_and_numbers(spark):
    df = spark.range(1, 16385).select("id", ranges.column_letters("id").alias("l"))
    df = df.select("id", "l", ranges.column_number(F.col("l")).alias("n"))
    assert df.filter("id <> n").count() == 0
    known = dict(rows(df.filter("id in (1, 26, 27, 52, 53, 702, 703, 16384)"), "id", "l"))
    assert known == {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA", 16384: "XFD"}


POINTS, AREAS = "k string, row_no int, column_no int, id int", "k string, top int, first_column int, bottom int, last_column int, area int"


def test_contained_is_the_theta_join(spark):
    draw = random.Random(7)
    points = [(draw.choice("ab"), draw.randint(1, 90), draw.randint(1, 30), k) for k in range(400)]
    areas = []
    for k in range(60):
        top, left = draw.randint(1, 90), draw.randint(1, 30)
        areas.append((draw.choice("abc"), top, left, top + draw.choice([0, 1, 7, 8, 60]), left + draw.choice([0, 2, 9, 25]), k))
    areas += [("a", 1, 1, 1048576, 16384, 60), ("b", 1, 3, 1048576, 3, 61), ("a", 5, 1, 5, 16384, 62)]
    want = sorted((p[3], a[5]) for p in points for a in areas if p[0] == a[0] and a[1] <= p[1] <= a[3] and a[2] <= p[2] <= a[4])
    found = ranges.contained(spark.createDataFrame(points, POINTS), spark.createDataFrame(areas, AREAS), ["k"])
    assert rows(found, "id", "area") == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_contained_hot_sheet_and_empty(spark):
    points = spark.range(20000).selectExpr("'a' k", "cast(id + 1 as int) row_no", "1 column_no", "cast(id as int) id")
    areas = spark.createDataFrame([("a", 1, 1, 1048576, 1, 1), ("a", 100, 1, 100, 1, 2)], AREAS)
    assert ranges.contained(points, areas, ["k"]).count() == 20001
    assert ranges.contained(points, areas.limit(0), ["k"]).count() == 0
    assert ranges.contained(points.limit(0), areas, ["k"]).count() == 0


def book(spark, sheet, names="", package="p"):
    """Cells, sheets and tokens of a workbook with one sheet `S x` and a second one that is empty."""
    workbook = (
        f'<workbook><sheets><sheet name="S x" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets><definedNames>{names}</definedNames></workbook>'
    )
    parts = xml_parts(
        spark,
        (package, "/xl/workbook.xml", workbook),
        (package, "/xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>"),
    )
    rel_parts = xml_parts(
        spark,
        (package, "/xl/_rels/workbook.xml.rels", rels_xml(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "worksheets/sheet2.xml"))),
    ).selectExpr("*", "1 as ord", "substring(path, 2) as archive_name")
    rels = I.parse_relationships(I.relationship_tokens(rel_parts), I.relationship_parts(rel_parts.drop("content")))
    from packlake.operators.shred import shred_xml

    events = ranges.range_tokens(parts).cache()
    sheets = W.workbook_sheets(shred_xml(parts, names=["sheet"], with_text=False), rels).cache()
    return W.worksheet_cells(events).cache(), sheets, events


def cell(at, formula):
    return f'<c r="{at}"><f>{formula}</f></c>'


def test_merged_ranges(spark):
    sheet = '<c r="A1"/><c r="B2"/><c r="C3"/><c r="?"/><mergeCell ref="A1:B2"/><mergeCell ref="B2:C3"/><mergeCell ref="bad"/>'
    cells, _, events = book(spark, sheet)
    found = ranges.merged_anchors(cells, ranges.merged_ranges(events))
    assert [tuple(r) for r in found.select("reference", "ref", "anchor", "is_anchor").orderBy("ord").collect()] == [
        ("A1", "A1:B2", "A1", True), ("B2", "A1:B2", "A1", False), ("C3", "B2:C3", "B2", False), ("?", None, None, None)
    ]


def test_defined_names(spark):
    names = (
        '<definedName name="one">\'S x\'!$A$1</definedName><definedName name="two">Two!A:A,\'S x\'!B2:C3</definedName>'
        '<definedName name="none">SUM(Two!A1)</definedName><definedName name="const">5</definedName>'
        '<definedName name="quote">\'it\'\'s\'!A1</definedName><definedName name="far">[1]Two!A1</definedName>'
    )
    cells, sheets, events = book(spark, '<c r="A1"/><c r="C2"/>', names)
    found = ranges.defined_names(events)
    assert rows(found, "name", "sheet", "ref") == [
        ("one", "S x", "$A$1"), ("quote", "it's", "A1"), ("two", "S x", "B2:C3"), ("two", "Two", "A:A")
    ]
    assert rows(ranges.named_cells(cells, found, sheets), "name", "ref") == [("one", "$A$1"), ("two", "B2:C3")]


@pytest.mark.parametrize(
    "formula, want",
    [
        ("A1+$B$2", ["A1", "B2"]),
        ("SUM(A1:B2,C3)", ["A1:B2", "C3"]),
        ("LOG10(A1)", ["A1"]),
        ('"A1"&amp;B2&amp;"""C3"""', ["B2"]),
        ("Two!A1+'S x'!B2:C3", ["2A1", "B2:C3"]),
        ("[1]Two!A1+Lost!B2", []),
        ("A:A+3:4", ["A:A", "3:4"]),
        ("area+AREA*local", ["D1:D4", "E5"]),
        ("A1B+x.A1+A1.5", []),
        ("tax(A1)", ["A1"]),
    ],
)
def test_references(spark, formula, want):
    names = (
        "<definedName name=\"Area\">'S x'!$D$1:$D$4</definedName><definedName name=\"local\">Two!A1</definedName>"
        "<definedName name=\"LOCAL\" localSheetId=\"0\">'S x'!E5</definedName>"
    )
    cells, sheets, events = book(spark, cell("Z9", formula), names)
    found = formulas.formula_references(cells, sheets, ranges.defined_names(events))
    letters = [
        F.concat(ranges.column_letters("first_column"), F.col("top")).alias("a"),
        F.concat(ranges.column_letters("last_column"), F.col("bottom")).alias("b"),
    ]
    got = set()
    for path, a, b, top, bottom, first, last in rows(found.select("ref_path", *letters, "top", "bottom", "first_column", "last_column")):
        name = a if a == b else f"{a}:{b}"
        if bottom - top > 10**6:
            name = "A:A"
        if last - first > 10**4:
            name = f"{top}:{bottom}"
        got.add(("2" if path.endswith("sheet2.xml") else "") + name)
    assert got == set(want)


@pytest.mark.parametrize("local", [10**6, 0])
def test_levels_and_cycles(spark, local):
    sheet = "".join(
        [cell("A1", "1+1"), cell("A2", "A1+B9"), cell("A3", "SUM(A1:A2)"), cell("C1", "C2"), cell("C2", "C3"), cell("C3", "C1")]
        + [cell("D1", "C1+A1"), cell("E1", "E1"), cell("F1", "Two!A1"), '<c r="B9"><v>3</v></c>', cell("?", "A3")]
    )
    cells, sheets, _ = book(spark, sheet)
    found = formulas.formula_levels(cells, formulas.formula_references(cells, sheets), local_links=local)
    got = {r[0]: r[1:] for r in rows(found.join(cells.select("path", "ord", "reference"), ["path", "ord"]).select("reference", "level", "in_cycle"))}
    assert got == {
        "A1": (1, False), "A2": (2, False), "A3": (3, False), "C1": (None, True), "C2": (None, True), "C3": (None, True),
        "D1": (None, True), "E1": (None, True), "F1": (1, False), "?": (4, False),
    }


def test_long_chain_of_formulas(spark):
    sheet = cell("A1", "1") + "".join(cell(f"A{k}", f"A{k - 1}+1") for k in range(2, 1500))
    cells, sheets, _ = book(spark, sheet)
    found = formulas.formula_levels(cells, formulas.formula_references(cells, sheets))
    assert found.filter("level <> ord").count() == 0 and found.count() == 1499


def test_no_formulas(spark):
    cells, sheets, _ = book(spark, '<c r="A1"><v>1</v></c>')
    assert rows(formulas.formula_levels(cells, formulas.formula_references(cells, sheets))) == []
    assert rows(formulas.formula_levels(cells.limit(0), formulas.formula_references(cells.limit(0), sheets))) == []


CHAIN = "package string, id string, parent string, v int"


def test_inheritance(spark):
    nodes = [("p", f"n{k}", f"n{k - 1}" if k else None, 7 if k == 0 else 9 if k == 30 else None) for k in range(100)]
    nodes += [("p", "x", "y", None), ("p", "y", "x", 5), ("p", "self", "self", None), ("p", "into", "x", None)]
    nodes += [("p", "lost", "gone", None), ("q", "n99", "n98", None), ("p", None, "n3", None)]
    nodes += [("hot", "root", None, 1)] + [("hot", f"leaf{k}", "root", None) for k in range(3000)]
    found = {r[:2]: r[2:] for r in rows(inheritance.inherited(spark.createDataFrame(nodes, CHAIN), ["v"]).select("package", "id", "v", "depth", "in_cycle").na.fill({"id": "null"}))}
    assert found["p", "n29"] == (7, 29, False) and found["p", "n99"] == (9, 99, False)
    assert found["p", "x"] == found["p", "y"] == found["p", "into"] == (5, None, True)
    assert found["p", "self"] == (None, None, True)
    assert found["p", "lost"] == (None, 0, False) and found["q", "n99"] == (None, 0, False) and found["p", "null"] == (7, 4, False)
    assert found["hot", "leaf2999"] == (1, 1, False)
    assert rows(inheritance.inherited(spark.createDataFrame([], CHAIN), ["v"])) == []


def test_heading_by_inherited_style(spark):
    styles = (
        '<w:styles><w:style w:styleId="Base"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>'
        '<w:style w:styleId="Mine"><w:basedOn w:val="Base"/><w:name w:val="my head"/></w:style>'
        '<w:style w:styleId="Text"><w:basedOn w:val="Base"/><w:pPr><w:outlineLvl w:val="9"/></w:pPr></w:style><w:style/></w:styles>'
    )
    def p(style, text, own=""):
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{own}</w:pPr><w:t>{text}</w:t></w:p>'
    body = p("Mine", "found") + p("Text", "body") + p("Lost", "no") + p("Text", "own", '<w:outlineLvl w:val="0"/>') + p("Mine", " ")
    body += '<w:p><w:pPr><w:outlineLvl w:val="3"/></w:pPr><w:t>plain</w:t></w:p>'
    parts = xml_parts(spark, ("p", "/word/document.xml", f"<w:document>{body}</w:document>"), ("p", "/word/styles.xml", styles))
    found = inheritance.styled_outline(inheritance.style_tokens(parts))
    assert [tuple(r) for r in found.orderBy("ord").select("style", "level", "inherited_from", "text").collect()] == [
        ("Mine", 2, "Base", "found"), ("Text", 1, None, "own"), (None, 4, None, "plain")
    ]


def test_fields_and_hyperlinks(spark):
    def mark(kind):
        return f'<w:fldChar w:fldCharType="{kind}"/>'
    body = (
        '<w:hyperlink r:id="r1"><w:t>one </w:t><w:hyperlink w:anchor="in"><w:t>two</w:t></w:hyperlink></w:hyperlink>'
        + mark("end") + mark("separate")
        + mark("begin") + "<w:instrText> HYPER</w:instrText><w:instrText>LINK \"http://x y\" \\o z</w:instrText>" + mark("separate")
        + "<w:t>a</w:t>" + mark("begin") + "<w:instrText>PAGE</w:instrText>" + mark("separate") + "<w:t>1</w:t>" + mark("end") + "<w:t>b</w:t>" + mark("end")
        + '<w:fldSimple w:instr=" NUMPAGES "><w:t>9</w:t></w:fldSimple><w:hyperlink r:id="gone"/>'
        + mark("begin") + "<w:instrText>TOC</w:instrText>" + mark("separate") + "<w:t>open</w:t>"
    )
    parts = xml_parts(spark, ("p", "/word/document.xml", f"<w:document>{body}</w:document>"))
    rels = spark.createDataFrame(
        [("p", "/word/document.xml", "r1", 1, "http://t", None, "External"), ("p", "/word/document.xml", "r1", 2, "x", "/x", "Internal")],
        "package string, source string, id string, rel_ord int, target string, resolved_target string, target_mode string",
    )
    found = links.document_links(links.link_tokens(parts), rels)
    assert [tuple(r)[2:] for r in found.orderBy("ord").collect()] == [
        (1, "hyperlink", 1, True, None, "http://t", "one two"),
        (2, "hyperlink", 2, True, None, "#in", "two"),
        (3, "field", 1, True, "HYPERLINK", "http://x y", "a1b"),
        (4, "field", 2, True, "PAGE", None, "1"),
        (5, "simple", 1, True, "NUMPAGES", None, "9"),
        (6, "hyperlink", 1, True, None, None, ""),
        (7, "field", 1, False, "TOC", None, "open"),
    ]
    assert rows(links.document_links(links.link_tokens(parts.limit(0)), rels)) == []


def test_parts_that_just_end_keep_their_text(spark):
    for text, want in [("<a><b>one</b> tail text", "one tail text"), ("<a>only tail", "only tail"), ("<a>x]\r", "x]\n"), ("<a>é", "é")]:
        parts = xml_parts(spark, ("p", "/a.xml", text))
        assert one(S.all_text(S.text_tokens(parts)).select("text")) == (want,), text


def test_title_of_a_shape_that_never_closes(spark):
    sheet = '<p:sld><p:sp><p:ph type="title"/><a:t>never</a:t>'
    parts = xml_parts(spark, ("p", "/s.xml", sheet))
    from packlake.operators.shred import found_rows, shred_xml

    assert found_rows(shred_xml(parts, names=[], folds=("titles",)), "Title").count() == 0


def test_levels_of_many_packages_in_one_task(spark):
    """Packages are told apart within a task, and none is a group of its own."""
    from packlake.operators.formulas import _level_batches

    links = [("a", "c:1", "c:2"), ("b", "c:1", "c:2"), ("b", "c:2", "c:3"), ("c", "c:1", "c:2"), ("c", "c:2", "c:1")]
    table = pa.table(dict(zip(("package", "before", "after"), zip(*links))))
    # A package may lie across batches.
    found = [tuple(row.values()) for batch in _level_batches(iter(table.to_batches(max_chunksize=2))) for row in batch.to_pylist()]
    assert sorted(found) == [("a", "c:1", 1), ("a", "c:2", 2), ("b", "c:1", 1), ("b", "c:2", 2), ("b", "c:3", 3)]


def test_placed_follows_rectangle(spark):
    from packlake.operators.ranges import RECTANGLE, placed, rectangle

    refs = "A1 $B$2:D9 d9:b2 A:C 3:5 ABC XFD1048576 XFE1 A1048577 A0 A1:B 5 A1:3 AAA1 ZZ9:A1".split() + ["", " a1 ", "A1:A1", None, ":"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, ref string")
    whole = rows(df.withColumn("at", rectangle("ref")).filter("at is not null").select("i", "at.*"))
    assert rows(placed(df, "ref"), "i", *RECTANGLE) == whole
    # The pattern is not evaluated once more for a pushed filter.
    plan = placed(df, "ref").filter("top = bottom")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Generate")[1]


def test_links_and_relationships_are_read_in_one_pass(spark):
    folder = "/root/testdata/sf0.001"
    found = QUERIES["document_links"](spark, folder)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    files = A.linked_files(A.Tables(spark, folder))
    assert rows(A.file_names(files, ".rels")) == rows(A.file_parts(files, ".rels").drop("content").select("package", "ord", "path", "archive_name"))


@pytest.mark.parametrize("local", [10**6, 40])
def test_levels_need_no_links_of_packages_with_few(spark, local, monkeypatch):
    """A package is ordered in its task without a row for each link, if it cannot have many; with few of those it
    might have, it is ordered by its links. Columns to go along, ranges told twice, areas of several columns."""
    sums = [cell("A1", "1")] + [cell(f"A{k}", f"SUM($A$1:A{k - 1})+A1") for k in range(2, 7)]
    sheet = "".join(sums + [cell("C1", "A1+$A$1+SUM(D2:A2)"), cell("B1", "C9"), cell("C9", "B1:B1"), cell("D1", "SUM(B:C)"), cell("?", "Two!A1")])
    cells, sheets, _ = book(spark, sheet)
    made = []
    links = formulas.formula_links
    monkeypatch.setattr(formulas, "formula_links", lambda *given: made.append(given) or links(*given))
    references = formulas.formula_references(cells, sheets, distinct=False)
    found = formulas.formula_levels(cells, references, local_links=local, keep=("reference", "formula"))
    got = {r[0]: r[1:] for r in rows(found, "reference", "level", "in_cycle", "formula")}
    want = {f"A{k}": (k, False) for k in range(1, 7)} | {"C1": (3, False), "B1": (None, True), "C9": (None, True), "D1": (None, True), "?": (1, False)}
    assert {k: v[:2] for k, v in got.items()} == want and got["B1"][2] == "C9"
    assert len(made) == (local == 40)


def test_only_formulas_leave_the_tokeniser(spark):
    parts = xml_parts(spark, ("p", "/xl/worksheets/sheet1.xml", f'<s><c r="A1"><v>1</v></c>{cell("B1", "A1")}<c r="C1"/>{cell("D1", "B1")}</s>'))
    found = rows(W.worksheet_cells(ranges.range_tokens(parts, cells="formulas")), "ord", "reference", "formula")
    assert found == [(2, "B1", "A1"), (4, "D1", "B1")]
