from helpers import one, packages, rels_xml, rows, xml_parts, zip_bytes
from pyspark.sql import functions as F

from packlake.functions.xml import xml_attr
from packlake.limits import SCREEN, Limits
from packlake.operators import index as I
from packlake.operators import presentation as S
from packlake.operators import shred as X
from packlake.operators import summary
from packlake.operators import word as D
from packlake.operators import workbook as W
from packlake.operators.report import bounded_lines, numbered
from packlake.session import staged
from packlake.sources.packages import explode_packages


def test_attributes(spark):
    parts = xml_parts(
        spark, ("p", "/a", '<x id="plain" r:id="a&amp;b"/>'), ("p", "/b", '<x r:id="fallback"/>'), ("p", "/c", '<x id="v"/>')
    )
    events = X.shred_xml(parts)
    assert rows(events, "path", "event", xml_attr("attrs", "r:id"), xml_attr("attrs", "id")) == [
        ("/a", "Empty", "a&b", "plain"),
        ("/b", "Empty", "fallback", "fallback"),
        ("/c", "Empty", None, "v"),
    ]


def test_tokens(spark):
    xml = "<?xml version='1.0'?><a><b/><c></c><d x='/'></d><!-- n --><e>1<![CDATA[no]]>&amp;&nope;2</e></a>"
    events = X.shred_xml(xml_parts(spark, ("p", "/x", xml))).orderBy("seq").collect()
    got = [(r["event"], r["local"], r["depth"], r["text"]) for r in events]
    text = "".join(t for e, _, _, t in got if e == "Text")
    assert text == "1&2"
    assert [g[:3] for g in got if g[0] != "Text"] == [
        ("Start", "a", 0),
        ("Empty", "b", 1),
        ("Start", "c", 1),
        ("End", "c", 1),
        ("Start", "d", 1),
        ("End", "d", 1),
        ("Start", "e", 1),
        ("End", "e", 1),
        ("End", "a", 0),
    ]


def test_utf16_and_kept_names(spark):
    data = "<a><b/>é</a>".encode("utf-16")
    events = X.shred_xml(xml_parts(spark, ("p", "/x", data)), names=["b"])
    assert rows(events, "event", F.coalesce("local", F.lit("")), F.coalesce("text", F.lit(""))) == [
        ("Empty", "b", ""),
        ("Text", "", "é"),
    ]


def test_many_tokens_keep_their_order(spark):
    n = 50_000
    xml = "<r>" + "".join(f"<c>{i}</c><e/>" for i in range(n)) + "</r>"
    events = X.shred_xml(xml_parts(spark, ("p", "/x", xml)))
    counted = events.groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in counted} == {
        "Start": n + 1, "End": n + 1, "Empty": n, "Text": n,
    }
    assert events.agg(F.count_distinct("seq")).first()[0] == events.count()


def test_malformed_parts_are_named(spark):
    parts = xml_parts(
        spark,
        ("p", "/ppt/presentation.xml", "<root><item></root>"),
        ("p", "/xl/sharedStrings.xml", "<sst><si><t>bad</sst>"),
        ("p", "/ok.xml", "<a/>"),
    )
    got = {r["path"]: (r["valid"], r["message"]) for r in X.validate_xml(parts).collect()}
    assert got["/ok.xml"] == (True, None)
    assert got["/ppt/presentation.xml"][1].startswith("/ppt/presentation.xml: malformed XML")
    assert not got["/xl/sharedStrings.xml"][0]
    assert X.shred_xml(parts).filter("path <> '/ok.xml'").select("event").distinct().collect()[0][0] == "Error"


def test_all_text(spark):
    events = S.text_tokens(xml_parts(spark, ("p", "/x", "<root>one &amp; &lt;two&gt;</root>")))
    assert one(S.all_text(events), "text") == ("one & <two>",)
    assert one(S.all_text(events, Limits(text_chars=5)), "text") == ("one &",)


WORD = """<w:document xmlns:w="word"><w:body>
  <w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Overview</w:t></w:r></w:p>
  <w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl/>{more}</w:body></w:document>"""


def test_word(spark):
    plain = D.word_tokens(xml_parts(spark, ("p", "/word/document.xml", WORD.format(more=""))))
    assert one(D.word_counts(plain), "paragraphs", "tables") == (2, 1)
    assert one(D.heading_outline(plain), "level", "text") == (1, "Overview")
    style = '<w:pPr><w:pStyle w:val="{}"/></w:pPr>'.format
    more = (
        "<w:p/><a:p xmlns:a='a'/>"
        # A nested paragraph drops the text around it.
        f"<w:p>{style('Heading2')}<w:t>outer</w:t><w:p>{style('Heading3')}<w:t> in  ner </w:t></w:p><w:t>rest</w:t></w:p>"
        f"<w:p>{style('Heading+4')}<w:t>pl</w:t><w:t>us</w:t></w:p>"
        f"<w:p>{style('Heading-1')}<w:t>no</w:t></w:p><w:p>{style('heading1')}<w:t>no</w:t></w:p>"
        f"<w:p>{style('Heading99999999999999999999')}<w:t>no</w:t></w:p>"
        f"<w:p>{style('Heading5')}<w:t> </w:t></w:p><w:tbl><w:tr/></w:tbl>"
    )
    tokens = D.word_tokens(xml_parts(spark, ("p", "/word/document.xml", WORD.format(more=more))))
    assert rows(D.heading_outline(tokens), "ord", "level", "text") == [
        (1, 1, "Overview"),
        (2, 3, "in ner"),
        (3, 4, "plus"),
    ]
    assert one(D.word_counts(tokens), "paragraphs", "tables") == (9, 2)


def test_worksheet(spark):
    sheet = """<worksheet xmlns:r="relationships"><dimension ref="A1:B2"/><sheetData><row>
      <c r="A1" t="inlineStr"><is><t>Hello</t></is></c>
      <c r="B1"><f>SUM(A2:A3)</f><v>3</v></c></row></sheetData></worksheet>"""
    events = W.cell_tokens(xml_parts(spark, ("p", "/s", sheet)))
    cells = W.worksheet_cells(events)
    assert rows(cells, "ord", "reference", "value") == [(1, "A1", "Hello"), (2, "B1", "3")]
    assert one(cells.filter("formula is not null"), "formula") == ("SUM(A2:A3)",)
    assert one(W.sheet_stats(events, cells), "range", "n_cells", "formula_count") == ("A1:B2", 2, 1)


def test_worksheet_state(spark):
    sheet = (
        "<s><v>out</v><c r='A1'><v>1</v>tail<f/><v>2</v></c>between<c/><c r='A3'><f></f><v>3</v></c>"
        "<c r='A4'><f>x</f></c><dimension ref='B'/><dimension/></s>"
    )
    events = W.cell_tokens(xml_parts(spark, ("p", "/s", sheet)))
    cells = W.worksheet_cells(events)
    got = [(r["ord"], r["reference"], r["value"], r["formula"]) for r in cells.orderBy("ord").collect()]
    assert got == [(1, "A1", "12", None), (2, "", "", None), (3, "A3", "3", None), (4, "A4", "", "x")]
    # The last dimension counts, also one without range; formulas count beyond the cell cap.
    stats = one(W.sheet_stats(events, cells, Limits(summary_items=2)), "n_cells", "formula_count")
    assert stats == (2, 1)
    assert W.sheet_stats(events, cells).first()["range"] is None
    assert rows(W.cell_sample(cells, 3), "line") == [("  A1 = 12",), ("  A3 = 3",)]


def test_shared_strings(spark):
    xml = "<sst><si><t>World</t></si><si/><si><r><t>a</t></r><x>no</x><r><t>b&amp;</t></r></si><si></si><t>out</t></sst>"
    strings = W.shared_strings(W.string_tokens(xml_parts(spark, ("p", "/xl/sharedStrings.xml", xml))))
    assert rows(strings, "idx", "value") == [(0, "World"), (1, "ab&"), (2, "")]
    cells = spark.createDataFrame(
        [("p", t, v) for t, v in [("s", "0"), ("s", "+1"), ("s", "7"), ("s", "x"), ("s", " 0"), ("n", "0"), (None, "0"), ("s", "18446744073709551615"), ("s", "18446744073709551616"), ("s", "")]],
        "package string, cell_type string, value string",
    ).withColumn("n", F.monotonically_increasing_id())
    got = {(r["cell_type"], v): r["value"] for r, v in zip(
        W.resolve_shared(cells, strings).orderBy("n").collect(),
        ["0", "+1", "7", "x", " 0", "0n", "0none", "max", "over", "empty"],
    )}
    assert got == {
        ("s", "0"): "World", ("s", "+1"): "ab&", ("s", "7"): "", ("s", "x"): "x", ("s", " 0"): " 0",
        ("n", "0n"): "0", (None, "0none"): "0", ("s", "max"): "", ("s", "over"): "18446744073709551616",
        ("s", "empty"): "",
    }


def test_slide_titles(spark):
    ph = "<p:ph type='{}'/>".format

    def slide(*shapes):
        return "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<p:sp>{s}</p:sp>" for s in shapes) + "</p:sld>"

    parts = xml_parts(
        spark,
        ("p", "/1", slide("<a:t>noise</a:t>", f"<a:t>before</a:t>{ph('TITLE')}<a:t>My </a:t><a:t>Title</a:t>")),
        ("p", "/2", slide(f"{ph('title')}<a:t> </a:t>", f"<p:ph type='ctrTitle'></p:ph><a:t>Second</a:t>")),
        ("p", "/3", slide(f"{ph('body')}<a:t>text</a:t>")),
        # A placeholder in a nested shape makes the whole top-level shape a title.
        ("p", "/4", slide(f"<a:t>a</a:t><p:sp>{ph('title')}</p:sp><a:t>b</a:t>")),
    )
    assert rows(S.slide_title(S.title_tokens(parts)), "path", "title") == [
        ("/1", "My Title"),
        ("/2", "Second"),
        ("/4", "b"),
    ]


def _summaries(spark, *named):
    df = packages(spark, *named)
    index = I.build_index(staged(explode_packages(df), "entries"))
    opened = explode_packages(df, with_content=True, only_markup=True)
    tokens = staged(summary.summary_tokens(I.part_contents(opened)), "tokens")
    return summary.document_summaries(
        staged(index["parts"], "parts"), staged(index["relationships"], "rels"), tokens
    )


def _deck(slide, notes=b"<n>Speak  up</n>", extra=()):
    return zip_bytes(
        [
            ("ppt/presentation.xml", b'<p xmlns:r="r"><sldId id="1" r:id="r1"/><sldId r:id="none"/></p>'),
            ("ppt/_rels/presentation.xml.rels", rels_xml(("r1", "slide", "../odd/place.bin"))),
            ("odd/place.bin", slide),
            ("odd/_rels/place.bin.rels", rels_xml(("n", "notesSlide", "notes"), ("i", "image", "http://x", "External"))),
            ("odd/notes", notes),
            *extra,
        ]
    )


TITLE = b'<s xmlns:p="p"><p:sp><ph type="title"/><t>Hi</t></p:sp></s>'


def test_presentation_report(spark):
    lines, failed = _summaries(
        spark, ("good", _deck(TITLE)), ("bad", _deck(b"<s></t>")), ("ends", _deck(b"<s>")), ("media", _deck(b"\x89PNG")), ("lost", _deck(TITLE, extra=()).replace(b"odd/notes", b"odd/nopes"))
    )
    # A part that just ends is read as far as it goes.
    assert [r["text"] for r in lines.filter("package = 'ends'").orderBy("line").collect()][4] == "1. (untitled)"
    good = lines.filter("package = 'good'").orderBy("line")
    got = [(r["text"], r["link_start"], r["link_target"]) for r in good.collect()]
    assert got == [
        ("PowerPoint summary", None, None),
        ("", None, None),
        ("Slides: 1", None, None),
        ("", None, None),
        ("1. Hi", None, None),
        ("   Part: /odd/place.bin", 9, "/odd/place.bin"),
        ("   Images: 1", None, None),
        ("   Notes: /odd/notes — Speak up", 10, "/odd/notes"),
    ]
    reasons = {r["package"]: r["message"] for r in failed.collect()}
    assert set(reasons) == {"bad", "media", "lost"}
    assert "/odd/place.bin: malformed XML" in reasons["bad"]
    assert reasons["lost"].endswith("part not found: /odd/notes")
    assert reasons["media"].endswith("/odd/place.bin: malformed XML: no element found")


def test_word_and_excel_reports(spark):
    word = zip_bytes([("word/document.xml", WORD.format(more="").encode())])
    plain = zip_bytes([("word/document.xml", b"<d/>")])
    book = zip_bytes(
        [
            ("xl/workbook.xml", b'<w xmlns:r="r"><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></w>'),
            ("xl/_rels/workbook.xml.rels", rels_xml(("r1", "sheet", "/any/where.dat"))),
            ("xl/sharedStrings.xml", b"<sst><si><t>shared</t></si></sst>"),
            ("any/where.dat", b"<s>" + b"".join(b'<c r="A%d" t="s"><v>0</v></c>' % i for i in range(22)) + b"</s>"),
        ]
    )
    lines, failed = _summaries(spark, ("word", word), ("plain", plain), ("book", book))
    assert failed.count() == 0
    text = {}
    for r in lines.orderBy("package", "line").collect():
        text.setdefault(r["package"], []).append(r["text"])
    assert text["word"] == [
        "Word summary", "", "Document: /word/document.xml", "Paragraphs: 2", "Tables: 1", "Images: 0",
        "", "Heading outline", "    Overview",
    ]
    assert text["plain"][3:] == ["Paragraphs: 0", "Tables: 0", "Images: 0", "", "Heading outline", "  (none)"]
    assert text["book"][:9] == [
        "Excel summary", "", "Workbook: /xl/workbook.xml", "Sheets: 2", "", "- One",
        "  Worksheet: /any/where.dat", "  Range: unknown", "  Cells: 22",
    ]
    assert text["book"][10:30] == [f"  A{i} = shared" for i in range(20)]
    assert text["book"][30:] == ["  ... 2 more cells", "", "- Two", "  Worksheet part: unavailable"]


def test_bounded_lines(spark):
    many = spark.range(8192).select(F.lit("p").alias("package"), F.col("id").alias("line"), F.lit("summary line").alias("text"))
    assert bounded_lines(many).count() == 8192
    assert bounded_lines(many, SCREEN).count() == 4096
    numbers = numbered(many.withColumn("target", F.lit(None).cast("string")), "line", limits=Limits(summary_lines=6000))
    assert bounded_lines(numbers, Limits(summary_lines=10_000)).count() == 6000
    lines = spark.createDataFrame(
        [("p", 0, "two\nlines", None), ("p", 1, "say abc", "abc"), ("p", 2, "ééé", "é"), ("p", 3, "gone", None)],
        "package string, line int, text string, target string",
    )
    got = bounded_lines(lines, Limits(summary_bytes=23)).orderBy("line").collect()
    assert [(r["line"], r["text"], r["link_start"], r["link_end"]) for r in got] == [
        (0, "two\nlines", None, None),
        (2, "say abc", 4, 7),
        (3, "éé…", 0, 1),
    ]
    assert len(bounded_lines(lines, Limits(summary_lines=2)).collect()) == 1


def test_nothing_is_cut_without_a_limit(spark):
    n = 16_500
    strings = "<sst>" + "".join(f"<si><t>s{k}</t></si>" for k in range(n)) + "</sst>"
    sheet = "<s>" + "".join(f'<c r="A{k}" t="s"><v>{n - 1}</v></c>' for k in range(4200)) + "</s>"
    found = W.shared_strings(W.string_tokens(xml_parts(spark, ("p", "/xl/sharedStrings.xml", strings))))
    events = W.cell_tokens(xml_parts(spark, ("p", "/s", sheet)))
    cells = W.worksheet_cells(events)
    assert one(W.sheet_stats(events, cells), "n_cells") == (4200,)
    assert one(W.sheet_stats(events, cells, SCREEN), "n_cells") == (4096,)
    assert rows(W.resolve_shared(cells, found).select("value").distinct()) == [(f"s{n - 1}",)]
    assert W.shared_strings(W.string_tokens(xml_parts(spark, ("p", "/x", strings))), SCREEN).count() == 16_384
    long = "x " * 20_000
    text = S.all_text(S.text_tokens(xml_parts(spark, ("p", "/t", f"<t>{long}</t>"))))
    assert one(text.select(F.char_length("text").alias("n")), "n") == (40_000,)
    heading = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>{long}</w:t></w:p>'
    outline = D.heading_outline(D.word_tokens(xml_parts(spark, ("p", "/word/document.xml", WORD.format(more=heading * 4100)))))
    assert outline.count() == 4101 and outline.agg(F.max(F.char_length("text"))).first()[0] == 39_999


def test_input_that_just_ends(spark):
    parts = xml_parts(spark, ("p", "/empty", b""), ("p", "/open", "<a><b>x</b>"), ("p", "/note", "<!-- c -->"), ("p", "/text", "only text"), ("p", "/cut", "<a><b"), ("p", "/wrong", "<a></b>"))
    assert {r["path"]: r["valid"] for r in X.validate_xml(parts).collect()} == {
        "/empty": True, "/open": True, "/note": True, "/text": True, "/cut": False, "/wrong": False,
    }
    events = X.shred_xml(parts)
    assert rows(events.filter("path = '/open'"), "seq", "event") == [(0, "Start"), (1, "Start"), (2, "Text"), (3, "End")]
    assert rows(events.filter("event = 'Error'"), "path") == [("/cut",), ("/wrong",)]
    book = zip_bytes([
        ("xl/workbook.xml", b'<w xmlns:r="r"><sheet name="One" r:id="r1"/></w>'),
        ("xl/_rels/workbook.xml.rels", rels_xml(("r1", "sheet", "s.xml"))),
        ("xl/sharedStrings.xml", b""),
        ("xl/s.xml", b'<s><c r="A1"><v>7</v></c>'),
    ])
    lines, failed = _summaries(spark, ("book", book))
    assert failed.count() == 0 and "  A1 = 7" in [r["text"] for r in lines.collect()]


def test_a_malformed_part_gives_nothing_else(spark):
    broken = "<r>" + "<e>x</e>" * 15_000 + "</wrong>"
    parts = xml_parts(spark, ("p", "/a", "<a/>"), ("p", "/b", broken), ("p", "/c", "<c/>")).coalesce(1)
    assert rows(X.shred_xml(parts), "path", "event") == [("/a", "Empty"), ("/b", "Error"), ("/c", "Empty")]


def test_summary_folds_of_one_part_run_there_alone(spark):
    body = "<a><p><pStyle w:val='Heading1'/><r><t>x</t></r></p><si><t>y</t></si></a>"
    paths = ("/word/document.xml", "/xl/sharedStrings.xml", "/z.xml")
    parts = xml_parts(spark, *[("p", path, body) for path in paths]).withColumn("is_dir", F.lit(False))
    found = rows(summary.summary_tokens(parts).filter("local is null and event <> 'Whole'"), "path", "event", "text")
    assert found == [("/word/document.xml", "Counts", None), ("/word/document.xml", "Heading", "x"), ("/xl/sharedStrings.xml", "String", "y")]


def test_diagnostics_need_no_texts(spark):
    """The same failures from tokens without the rows that only reports read."""
    slide = '<p:sld xmlns:p="p"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><t>text</t></p:sp></p:sld>'
    bodies = {"good": slide, "bad": slide.replace("</p:sld>", "</p:lost>"), "lost": None}
    blobs = []
    for name, body in bodies.items():
        files = [
            ("ppt/presentation.xml", b'<p xmlns:r="r"><sldIdLst><sldId r:id="a"/></sldIdLst></p>'),
            ("ppt/_rels/presentation.xml.rels", rels_xml(("a", "slide", "s.xml"))),
        ]
        blobs.append((name, zip_bytes(files + ([("ppt/s.xml", body.encode())] if body else []))))
    given = staged(packages(spark, *blobs), "packages")
    index = I.build_index(staged(explode_packages(given), "entries"))
    contents = I.part_contents(explode_packages(given, with_content=True, only_markup=True))
    found = []
    for reports in (True, False):
        tokens = staged(summary.summary_tokens(contents, reports), "tokens")
        failed = summary.document_summaries(index["parts"], index["relationships"], tokens)[1]
        found.append(rows(failed.orderBy("package"), "package", "message"))
    assert found[0] == found[1] and {package for package, _ in found[0]} >= {"bad"}
    assert tokens.filter("event NOT IN ('Start', 'Empty', 'End', 'Error')").count() == 0


def test_sheet_facts_without_a_row_for_each_cell(spark):
    from packlake.operators.folds import SAMPLE_CELLS

    many = "".join(f'<c r="A{n}"><v>{n}</v></c>' for n in range(1, 101))
    sheets = {
        "/many": f'<w><dimension ref="A1"/><dimension ref="A1:A100"></dimension>{many}<c r="B1"><f>A1</f></c><c r="B2"><f/><v>x</v></c></w>',
        "/range": '<w><dimension ref="A1"/><dimension/></w>',
        "/cells": '<w><c r="A1"/><c r="A2"><f></f></c><v>outside</v><c r="A3"><v>1</v><f>B<![CDATA[no]]>1</f></c></w>',
        "/none": "<w><row/></w>",
        "/bad": "<w><c/></v>",
    }
    parts = xml_parts(spark, *[("p", path, xml) for path, xml in sheets.items()])
    events = W.cell_tokens(parts)
    cells = W.worksheet_cells(events)
    facts = W.sheet_tokens(parts)
    for limits in (Limits(), SCREEN, Limits(summary_items=2)):
        assert rows(W.sheet_stats(facts, limits=limits).orderBy("path")) == rows(W.sheet_stats(events, cells, limits).orderBy("path"))
    assert rows(facts.orderBy("path"), "path", "event") == [
        ("/bad", "Error"), ("/cells", "Sheet"), ("/many", "Sheet"), ("/range", "Sheet"),
    ]
    shown = W.shown_tokens(parts)
    assert shown.filter("event = 'Cell' AND path = '/many'").count() == SAMPLE_CELLS
    assert rows(W.cell_sample(W.worksheet_cells(shown)).orderBy("path", "ord")) == rows(W.cell_sample(cells).orderBy("path", "ord"))
    assert rows(W.sheet_stats(shown).orderBy("path")) == rows(W.sheet_stats(facts).orderBy("path"))
