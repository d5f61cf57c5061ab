import struct

import pytest
from helpers import one, rows, zip_bytes
from pyspark.sql import functions as F

from packlake.functions import media as M
from packlake.limits import SCREEN, Limits
from packlake.operators import details, preview, search, tree
from packlake.streaming.packages import index_stream, stream_packages
from packlake.streaming.requests import current_requests, latest_wins


def parts_of(spark, *paths):
    return spark.createDataFrame(
        [("p", p, "Directory" if d else "Xml") for p, d in paths], "package string, path string, kind string"
    )


PATHS = [("/[Content_Types].xml", 0), ("/ppt", 1), ("/ppt/slides", 1), ("/ppt/slides/a.xml", 0), ("/ppt-x.xml", 0)]


def test_directory_entries_merge_with_their_children(spark):
    nodes = tree.tree_nodes(parts_of(spark, *PATHS))
    assert rows(nodes.filter("parent is null"), "node") == [("/[Content_Types].xml",), ("/ppt",), ("/ppt-x.xml",)]
    assert rows(nodes.filter("parent = '/ppt'"), "node", "depth", "name", "is_leaf") == [("/ppt/slides", 2, "slides", False)]
    assert rows(tree.branch_nodes(nodes), "node") == [("/ppt",), ("/ppt/slides",)]


def test_filters_keep_ancestors_and_subtrees(spark):
    nodes = tree.tree_nodes(parts_of(spark, ("/a/b/c.xml", 0), ("/a/b/d.xml", 0), ("/a/x/d.png", 0), ("/z", 0)))
    assert rows(tree.filter_tree(nodes, "C.X"), "node") == [("/a",), ("/a/b",), ("/a/b/c.xml",)]
    assert rows(tree.filter_tree(nodes, "a/B"), "node") == [("/a",), ("/a/b",), ("/a/b/c.xml",), ("/a/b/d.xml",)]
    assert tree.filter_tree(nodes, "").count() == nodes.count()
    matches = spark.createDataFrame([("p", "/a/b"), ("p", "/nope")], "package string, path string")
    assert rows(tree.filter_tree_matches(nodes, matches), "node", "is_leaf") == [
        ("/a", False), ("/a/b", False), ("/a/b/c.xml", True), ("/a/b/d.xml", True),
    ]


def contents_of(spark, *rows_):
    return spark.createDataFrame(
        [("p", path, kind, len(c), bytearray(c)) for path, kind, c in rows_],
        "package string, path string, kind string, size bigint, content binary",
    )


def test_content_search(spark):
    parts = contents_of(
        spark,
        ("/b", "Binary", b"x" * 8190 + b"needle"),
        ("/a", "Xml", b"some needle"),
        ("/c", "Xml", b"Needle"),
        ("/d", "Directory", b"needle"),
        ("/e", "Binary", b"\xff\x00needle\xfe"),
        ("/f", "Binary", b"needle" + b"." * 9000),
    )
    limits = Limits(entry_bytes=8196)
    found = search.search_content(parts, ["needle", "", "Need"], limits)
    assert rows(found, "needle", "path") == [("Need", "/c"), ("needle", "/a"), ("needle", "/b"), ("needle", "/e")]
    capped = search.search_content(parts, ["needle"], Limits(search_hits=2))
    assert rows(capped, "path") == [("/a",), ("/b",)]
    assert search.search_content(parts, [""]).count() == 0
    whole = "n" * 300
    assert search.search_content(contents_of(spark, ("/a", "Xml", b"n" * 299)), [whole]).count() == 0
    with pytest.raises(ValueError):
        search.search_content(parts, [whole], SCREEN)
    assert rows(search.search_paths(parts, "/A"), "path", "rank") == [("/a", 0)]
    assert search.search_paths(parts, "").count() == 0


def test_search_cap_is_applied_before_the_shuffle(spark):
    parts = contents_of(spark, ("/a", "Xml", b"x"))
    plan = search.search_content(parts, ["x"], SCREEN)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_relationship_lines(spark):
    long = "/" + "t" * 60
    rels = spark.createDataFrame(
        [("p", "/s", 1, "r1", "http://x/image", "t", long, "Internal"), ("p", "/s", 2, "r2", "plain", "http://w", None, "External")],
        "package string, source string, rel_ord bigint, id string, relationship_type string, target string, resolved_target string, target_mode string",
    )
    got = {(r["direction"], r["id"] if "id" in r else r["rel_ord"]): r for r in details.relationship_lines(rels).collect()}
    out = got["outgoing", 1]
    assert out["line"] == f"  r1  {long[:48]}… (image)"
    assert (out["link_start"], out["link_end"], out["link_target"]) == (6, 55, long)
    assert got["outgoing", 2]["line"] == "  r2  http://w (external) (plain)" and got["outgoing", 2]["link_start"] is None
    assert got["incoming", 1]["line"] == "  r1  /s (image)" and ("incoming", 2) not in got


def previews(spark, *rows_):
    df = spark.createDataFrame(
        [("p", "/" + n, n, t, len(c), 9, bytearray(c)) for n, t, c in rows_],
        "package string, path string, archive_name string, content_type string, size bigint, compressed_size bigint, content binary",
    )
    return {r["path"][1:]: (r["preview_kind"], r["preview_text"], r["preview_error"]) for r in preview.build_previews(df).collect()}


def test_previews(spark):
    vba = "application/vnd.ms-office.vbaProject"
    custom = "application/vnd.openxmlformats-officedocument.customXmlProperties+xml"
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 10, 20)
    got = previews(
        spark,
        ("custom.json", "application/json", b'{"answer":42}'),
        ("bad.json", None, b"{"),
        ("raw.json", None, b"\xff"),
        ("notes.txt", None, b"\xef\xbb\xbfhello\nworld"),
        ("bell.txt", None, b"\x07"),
        ("empty.txt", None, b""),
        ("payload.bin", None, bytes([0, 1, 65])),
        ("empty.bin", None, b""),
        ("font.ttf", None, b"\x00\x01\x02"),
        ("embeddings/object.bin", vba, b"\x00\x01"),
        ("customXml/item1.data", custom, b"<root><a/></root>"),
        ("broken.xml", None, b"<root><item></root>"),
        ("pic.PNG", "application/xml", png),
        ("nopic.png", None, b"png"),
    )
    assert got["custom.json"] == ("Json", '{\n  "answer": 42\n}', None)
    assert got["bad.json"][:2] == ("Json", "{")
    assert got["raw.json"] == ("Error", None, "JSON is not valid UTF-8")
    assert got["notes.txt"][:2] == ("PlainText", "hello\nworld")
    assert got["empty.txt"][:2] == ("PlainText", "")
    assert got["bell.txt"][0] == "Info" and "Binary data" in got["bell.txt"][1]
    assert got["payload.bin"][1] == "00000000  00 01 41                                          |..A|\n"
    assert got["empty.bin"][:2] == ("Hex", "")
    assert "Category:   Font" in got["font.ttf"][1] and "MIME type:  font/ttf" in got["font.ttf"][1]
    assert got["embeddings/object.bin"][0] == "Info" and "OLE/VBA object" in got["embeddings/object.bin"][1]
    assert got["customXml/item1.data"][:2] == ("Xml", "<root>\n  <a/>\n</root>")
    assert got["broken.xml"][0] == "Error" and got["broken.xml"][2].startswith("XML preview failed")
    assert got["pic.PNG"][0] == "Image"
    assert got["nopic.png"][0] == "Error"


def xml_pretty(spark, xml, limits=Limits()):
    df = spark.createDataFrame([("p", "/x", bytearray(xml.encode()))], "package string, path string, content binary")
    return one(preview.xml_pretty(df, limits), "text", "error")


def test_xml_indentation(spark):
    xml = "<?xml version='1.0'?><!DOCTYPE a><a x='>'><b>t<i/>u</b><!-- c --><c><![CDATA[<z>]]></c ></a>"
    assert xml_pretty(spark, xml)[0] == (
        "<?xml version='1.0'?>\n<!DOCTYPE a>\n<a x='>'>\n  <b>t<i/>u</b>\n  <!-- c -->\n  <c><![CDATA[<z>]]></c>\n</a>"
    )


def test_xml_of_other_bytes(spark):
    def pretty(xml):
        df = spark.createDataFrame([("p", "/x", bytearray(xml))], "package string, path string, content binary")
        return one(preview.xml_pretty(df), "text", "error")

    assert pretty(b"<a>\xe9<b/></a>") == ("<a>\ufffd<b/>\n</a>", None)
    assert pretty(b"") == ("", None) and pretty(b"<!-- c -->") == ("<!-- c -->", None)
    assert pretty(b"<a><b>") == ("<a>\n  <b>", None)
    assert pretty(b"<a></b>")[1].startswith("XML preview failed: /x: malformed XML")


def test_xml_pretty_moves_nothing(spark):
    parts = contents_of(spark, ("/a", "Xml", b"<a/>"))
    assert "Exchange" not in preview.xml_pretty(parts)._jdf.queryExecution().executedPlan().toString()


def test_xml_amplification_is_refused(spark):
    depth = 4096
    text, error = xml_pretty(spark, "<root>" + "<item>" * depth + "</item>" * depth + "</root>")
    assert text is None and "formatted XML preview exceeds 4194304 byte limit" in error


def test_hex_dump_limit(spark):
    df = spark.createDataFrame([("p", "/x", bytearray(range(40)))], "package string, path string, content binary")
    assert preview.hex_dump(df).count() == 3
    limits = Limits(hex_bytes=20)
    lines = preview.hex_dump(df, limits).orderBy("line").collect()
    assert [r["text"][:8] for r in lines] == ["00000000", "00000010"]
    assert lines[1]["text"] == "00000010  10 11 12 13                                       |....|"
    notice = df.select(M.truncation_notice("content", limits)).first()[0]
    assert notice == "[preview truncated: showing 20 of 40 bytes]"


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b":1,"a":2,"b":3}', '{\n  "a": 2,\n  "b": 3\n}'),
        ("[]", "[]"),
        ("[1,[],{}]", "[\n  1,\n  [],\n  {}\n]"),
        ("1e3", "1000.0"),
        ("0.00001", "0.00001"),
        ("0.0000012", "1.2e-6"),
        ("1e16", "1e16"),
        ("1.5e300", "1.5e300"),
        ("123456789012345.6", "123456789012345.6"),
        ("18446744073709551616", "1.8446744073709552e19"),
        ('"é\\n\\u0041"', '"é\\nA"'),
        ("NaN", None),
        ("1e999", None),
        ("{'a':1}", None),
        ("", None),
        ('"\\ud800"', None),
        ("-0", "-0.0"),
        ("[" * 128 + "]" * 128, None),
    ],
)
def test_json(text, want):
    got = preview.pretty_json(text)
    assert got == want


def test_image_headers(spark):
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x00\x00\x00\x00" + (399).to_bytes(3, "little") + (299).to_bytes(3, "little")
    lossless = b"RIFF\x00\x00\x00\x00WEBPVP8L\x00\x00\x00\x00\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")
    lossy = b"RIFF\x00\x00\x00\x00WEBPVP8 \x00\x00\x00\x00\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 64, 32)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc4\x00\x03\x00\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 5, 7) + b"\x01"
    bmp = b"BM" + b"\x00" * 12 + struct.pack("<Iii", 40, 3, -4)
    gif = b"GIF89a" + struct.pack("<HH", 9, 8)
    big = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 8192, 8192)
    wide = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 8193, 1)
    cases = {
        "a.webp": (webp, 400, 300), "b.webp": (lossless, 100, 50), "c.webp": (lossy, 64, 32), "d.JPG": (jpeg, 7, 5),
        "e.bmp": (bmp, 3, 4), "f.gif": (gif, 9, 8), "g.png": (big, 8192, 8192), "h.png": (wide, 8193, 1), "i.jpg": (b"\xff\xd8", None, None),
    }
    df = spark.createDataFrame(
        [("p", "/" + n, n, bytearray(c)) for n, (c, _, _) in cases.items()],
        "package string, path string, archive_name string, content binary",
    )
    got = {r["path"][1:]: r for r in preview.image_guard(df).collect()}
    for name, (_, width, height) in cases.items():
        assert (got[name]["width"], got[name]["height"]) == (width, height), name
    assert "pixel limit" in got["g.png"]["error"] and "dimensions" in got["h.png"]["error"]
    assert "header" in got["i.jpg"]["error"] and got["a.webp"]["error"] is None


def test_stale_requests_are_discarded(spark):
    schema = "key string, request_id int, path string"
    results = spark.createDataFrame([("a", 1, "/a.xml"), ("b", 2, "/a.xml"), ("c", 2, "/a.xml")], schema)
    requests = spark.createDataFrame([(k, i) for k in "abc" for i in (1, 2)], "key string, request_id int")
    selected = spark.createDataFrame([("a", "/a.xml"), ("b", "/b.xml"), ("c", "/a.xml")], "key string, path string")
    assert one(latest_wins(requests, results, selected), "key") == ("c",)
    assert rows(current_requests(results), "key", "request_id") == [("a", 1), ("b", 2), ("c", 2)]


def test_streamed_files_are_indexed_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()

    def arrive(name, *files):
        (tmp_path / "in" / name).write_bytes(zip_bytes([(f, b"<a/>") for f in files]))

    def run():
        index_stream(stream_packages(spark, source), out, progress).awaitTermination()
        return rows(spark.read.parquet(f"{out}/parts"), F.substring_index("package", "/", -1), "path")

    arrive("a.docx", "x.xml")
    arrive("b.xlsx", "y.xml", "y/z.xml")
    first = run()
    assert first == [("a.docx", "/x.xml"), ("b.xlsx", "/y.xml"), ("b.xlsx", "/y/z.xml")]
    arrive("c.pptx", "w.xml")
    assert run() == first + [("c.pptx", "/w.xml")]


def test_hex_lines_slice_what_is_made_once(spark):
    from packlake.functions.media import hex_lines

    content = bytes(range(256)) + b"end"
    df = spark.createDataFrame([(bytearray(content),), (bytearray(b""),), (None,)], "content binary")

    def line(at):
        chunk = content[at : at + 16]
        digits = "".join(f"{b:02x} " for b in chunk).ljust(48)
        shown = "".join(chr(b) if 32 <= b < 127 else "." for b in chunk)
        return f"{at:08x}  {digits[:24]} {digits[24:]} |{shown}|"

    lines = [r[0] for r in df.select(hex_lines("content")).collect()]
    assert lines == [[line(at) for at in range(0, len(content), 16)], [], []]
