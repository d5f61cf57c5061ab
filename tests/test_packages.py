import io
import os
import random
import warnings
import zipfile

import pyarrow as pa
from helpers import one, packages, rels_xml, rows, zip_bytes

from packlake.limits import Limits
from packlake.operators import index as I
from packlake.operators import details, summary
from packlake.operators.shred import shred_xml
from packlake.session import staged
from packlake.sources.packages import (
    bounded_read,
    explode_packages,
    package_errors,
    read_part,
    scan_packages,
    search_packages,
)
from packlake.sources.sinks import read_index, write_index


def test_bounded_read_trusts_no_declared_size():
    for stored in (True, False):
        for declared in (3, 0, 2, 100):
            blob = zip_bytes([("a", b"abc")], declared=declared, stored=stored)
            import io

            info = zipfile.ZipFile(io.BytesIO(blob)).infolist()[0]
            data, error = bounded_read(blob, info, 2)
            assert data is None and error, (stored, declared)
            if declared <= 10:
                assert bounded_read(blob, info, 10) == (b"abc", None)


def test_damage_is_a_row_not_a_failure(spark):
    good = zip_bytes([("a.xml", b"<a/>")])
    df = packages(spark, ("bad", b"no archive"), ("empty", b""), ("good", good), ("cut", good[:-30]))
    entries = explode_packages(df, with_content=True)
    assert {r["package"] for r in package_errors(entries).collect()} == {"bad", "empty", "cut"}
    assert one(entries.filter("ord >= 0"), "package", "content") == ("good", bytearray(b"<a/>"))


def test_corrupt_entry_has_read_error(spark):
    blob = bytearray(zip_bytes([("a", b"hello")], stored=True))
    at = blob.index(b"hello")
    blob[at] = ord("j")
    entries = explode_packages(packages(spark, ("p", bytes(blob))), with_content=True)
    assert one(entries, "content", "read_error") == (None, "invalid checksum")


def test_archive_limits(spark):
    limits = Limits(entry_count=3, total_bytes=100)
    df = packages(
        spark,
        ("count", zip_bytes([(str(i), b"") for i in range(4)])),
        # An ignored and a colliding entry count too.
        ("ignored", zip_bytes([("/", b"x")], declared=101)),
        ("colliding", zip_bytes([("part.xml", b"x"), ("./part.xml", b"x")], declared=51)),
        ("fits", zip_bytes([("a", b"x"), ("b", b"x")], declared=50)),
    )
    found = dict(rows(package_errors(explode_packages(df, limits=limits)), "package", "message"))
    assert set(found) == {"count", "ignored", "colliding"}
    assert found["count"] == "archive has 4 entries; limit is 3"
    assert "uncompressed size" in found["ignored"]
    # The same rule over a table of entries.
    entries = explode_packages(df)
    assert {r["package"] for r in I.archive_limits(entries, limits).collect()} == set(found)


def test_copies_are_counted_alike(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice(["a", "b", "/", "..", ".", "\\"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        blob = zip_bytes([(n, b"") for n in names])
    entries = explode_packages(packages(spark, ("p", blob)))
    named = I.depth_guard(I.named_entries(entries))
    for pick in (I.first_entries, I.collisions):
        assert rows(pick(named), "ord") == rows(pick(named.drop("copy")), "ord")


def test_names_depth_and_collisions(spark):
    deep = "directory/" * 64 + "file.xml"
    blob = zip_bytes(
        [("a.xml", b"1"), ("./a.xml", b"2"), ("x/../a.xml", b"3"), (deep, b""), ("./", b""), ("d/", b"")]
    )
    index = I.build_index(explode_packages(packages(spark, ("p", blob))))
    assert rows(index["parts"], "path", "ord", "kind") == [("/a.xml", 0, "Xml"), ("/d", 5, "Directory")]
    messages = [r["warning"] for r in index["diagnostics"].collect()]
    assert sum("maximum depth of 64" in m for m in messages) == 1
    assert sum("collides with" in m for m in messages) == 2
    assert sum("traversal-like" in m for m in messages) == 1


TYPES = (
    b'<Types><Default Extension="DAT" ContentType="application/x+xml"/>'
    b'<Default Extension="rels" ContentType="application/r+xml"/>'
    b'<Override PartName="/b/pic" ContentType="IMAGE/x"/>'
    b'<Override PartName="/b/pic.dat" ContentType="text/plain"/></Types>'
)


def test_index_of_a_package(spark):
    blob = zip_bytes(
        [
            ("[Content_TYPES].xml", TYPES),
            ("_rels/.rels", rels_xml(("r1", "main", "b/doc.dat"), ("r2", "web", "http://x", "external"))),
            ("b/_rels/doc.dat.rels", rels_xml(("r1", "image", "pic"), ("r2", "lost", "none.xml"), ("r3", "up", "../b"))),
            ("b/_rels/broken.xml.rels", b'<Relationships><Relationship Id="rId1" Type="type"/></Relationships>'),
            ("b/_rels/cut.xml.rels", b"<Relationships></x>"), ("b/_rels/end.xml.rels", b"<Relationships>"),
            ("odd/x.RELS", b"<Relationships/>"),
            ("b/doc.dat", b"<x/>"),
            ("b/pic", b"?"),
            ("b/pic.dat", b"?"),
        ]
    )
    index = I.build_index(staged(explode_packages(packages(spark, ("p", blob))), "entries"))
    kinds = {r["path"]: (r["kind"], r["content_type"]) for r in index["parts"].collect()}
    assert kinds["/b/doc.dat"] == ("Xml", "application/x+xml")
    assert kinds["/b/pic"] == ("Image", "IMAGE/x")
    assert kinds["/b/pic.dat"] == ("Binary", "text/plain")
    assert kinds["/_rels/.rels"] == ("Xml", "application/r+xml")
    rels = index["relationships"]
    assert rows(rels, "source", "id", "resolved_target", "target_mode") == [
        ("/", "r1", "/b/doc.dat", "Internal"),
        ("/", "r2", None, "External"),
        ("/b/doc.dat", "r1", "/b/pic", "Internal"),
        ("/b/doc.dat", "r2", "/b/none.xml", "Internal"),
        ("/b/doc.dat", "r3", "/b", "Internal"),
    ]
    assert rels.orderBy("rel_ord").first()["source"] == "/"
    found = {r["part"]: (r["severity"], r["message"]) for r in index["diagnostics"].collect()}
    assert found["/b/_rels/broken.xml.rels"][0] == "Error"
    assert "Target" in found["/b/_rels/broken.xml.rels"][1]
    assert found["/b/_rels/cut.xml.rels"][0] == "Error"
    assert found["/odd/x.RELS"] == ("Warning", "could not determine relationship source")
    # A link to a part or an implied folder can be followed, one to neither cannot.
    assert one(details.dangling_relationships(rels, index["parts"]), "id") == ("r2",)
    requests = spark.createDataFrame(
        [("p", "/b"), ("p", "/b/pic"), ("p", "/none")], "package string, path string"
    )
    assert rows(I.is_directory(requests, index["parts"]), "path", "is_directory") == [
        ("/b", True),
        ("/b/pic", False),
        ("/none", False),
    ]
    full = details.part_details(index["parts"], rels, index["diagnostics"])
    facts = {r["path"]: r for r in full.collect()}
    assert (facts["/b/doc.dat"]["n_out"], facts["/b/doc.dat"]["n_in"]) == (3, 1)
    assert facts["/b"]["kind_label"] == "Directory" and facts["/b"]["content_type"] == "N/A"
    assert facts["/b/pic"]["n_warnings"] == 3


def test_malformed_content_types_are_discarded(spark):
    blob = zip_bytes([("[Content_Types].xml", TYPES[:-3]), ("a.dat", b"")])
    index = I.build_index(explode_packages(packages(spark, ("p", blob))))
    assert rows(index["parts"], "path", "content_type") == [
        ("/[Content_Types].xml", None),
        ("/a.dat", None),
    ]
    assert one(index["diagnostics"], "stage", "part") == ("content-types", "/[Content_Types].xml")


def test_metadata_has_its_own_limit(spark):
    big = rels_xml(("r1", "main", "x" * 200))
    blob = zip_bytes([("_rels/.rels", big), ("x.xml", b"<x/>")])
    limits = Limits(metadata_bytes=100)
    for with_content in (True, False):
        entries = explode_packages(packages(spark, ("p", blob)), with_content=with_content, limits=limits)
        index = I.build_index(entries, limits)
        assert index["relationships"].count() == 0
        message = one(index["diagnostics"], "stage", "part", "message")
        assert message == ("relationships", "/_rels/.rels", f"entry declares {len(big)} bytes; limit is 100")


def test_read_part_opens_only_what_is_asked(spark):
    blob = zip_bytes([("a.xml", b"<a/>"), ("b.xml", b"<bb/>")])
    df = packages(spark, ("p", blob), ("q", blob))
    parts = I.dedupe_first_wins(explode_packages(df))
    requests = spark.createDataFrame(
        [("p", "/a.xml"), ("p", "/none"), ("q", "/b.xml")], "package string, path string"
    )
    got = {(r["package"], r["path"]): r for r in read_part(df, parts, requests, limit=4).collect()}
    assert got["p", "/a.xml"]["content"] == b"<a/>"
    assert got["p", "/none"]["read_error"] == "part not found: /none"
    assert got["q", "/b.xml"]["read_error"] == "entry declares 5 bytes; limit is 4"


def test_files_on_disk_and_index_sink(spark, tmp_path):
    source = tmp_path / "corpus" / "deep"
    source.mkdir(parents=True)
    (source / "a.docx").write_bytes(zip_bytes([("x.xml", b"<x/>")]))
    (source / "b.pptx").write_bytes(zip_bytes([("y.xml", b"<y/>")] * 1))
    (source / "c.txt").write_bytes(b"no package")
    found = scan_packages(spark, str(tmp_path / "corpus"))
    assert found.count() == 2
    small = scan_packages(spark, str(tmp_path / "corpus"), max_bytes=10)
    # Packages over the size are rows without content, and a diagnostic of the index.
    assert small.count() == 2 and small.filter("content is null").count() == 2
    told = I.build_index(explode_packages(small.select("package", "content")))["diagnostics"]
    assert rows(told, "severity", "stage", "message") == [("Error", "index", "package is too large to open")] * 2
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan
    index = I.build_index(explode_packages(found.select("package", "content")))
    write_index({k: index[k] for k in ("parts", "diagnostics")}, str(tmp_path / "out"), buckets=4)
    assert rows(read_index(spark, str(tmp_path / "out"), "parts"), "path") == [("/x.xml",), ("/y.xml",)]


def test_format_precedence(spark):
    parts = spark.createDataFrame(
        [("a", "/word/document.xml"), ("a", "/ppt/presentation.xml"), ("b", "/xl/workbook.xml"), ("c", "/x")],
        "package string, path string",
    )
    assert rows(summary.detect_format(parts).filter("format is not null")) == [("a", "ppt"), ("b", "excel")]
    assert summary.detect_format(parts).filter("format is null").count() == 1


def test_search_packages(spark):
    big = b"needle" + b"." * 9000 + b"Late"
    files = [("b/x.bin", big), ("b//x.bin", b"other"), ("a.xml", b"<a>needle \xff</a>"), ("d/", b""), ("c", b"none"), ("../e", b"other")]
    df = packages(spark, ("p", zip_bytes(files)), ("damaged", b"PK"), ("lying", zip_bytes(files[:1], declared=5)))
    found = search_packages(df, ["needle", "other", "Late", ""])
    assert rows(found, "package", "needle", "path") == [
        ("lying", "Late", "/b/x.bin"), ("lying", "needle", "/b/x.bin"),
        ("p", "Late", "/b/x.bin"), ("p", "needle", "/a.xml"), ("p", "needle", "/b/x.bin"), ("p", "other", "/e"),
    ]
    # An entry that is larger than it says is searched up to the limit, one that says so is not read.
    limited = search_packages(df, ["needle", "Late"], Limits(entry_bytes=100))
    assert rows(limited, "package", "needle", "path") == [("lying", "needle", "/b/x.bin"), ("p", "needle", "/a.xml")]
    assert rows(search_packages(df, ["needle"], Limits(search_hits=1)), "package", "path") == [("lying", "/b/x.bin"), ("p", "/a.xml")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_packages_over_the_size_limit_are_reported(spark, tmp_path):
    small, large = zip_bytes([("a", b"x")]), zip_bytes([("a", b"x" * 5000)], stored=True)
    (tmp_path / "small.docx").write_bytes(small)
    (tmp_path / "large.docx").write_bytes(large)
    found = explode_packages(scan_packages(spark, str(tmp_path), max_bytes=1000))
    assert sorted((r["package"].rsplit("/", 1)[1], r["ord"]) for r in found.collect()) == [("large.docx", -1), ("small.docx", 0)]
    assert [r["message"] for r in package_errors(found).collect()] == ["package is too large to open"]


def test_metadata_parts_are_tokenised_in_one_pass(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(I, "shred_xml", lambda *args, **how: passes.append(how) or shred_xml(*args, **how))
    types = b"<Types><Default Extension='xml' ContentType='t/x'/><Relationship Id='no'/></Types>"
    blob = zip_bytes([("[Content_Types].xml", types), ("_rels/.rels", rels_xml(("a", "t", "x.xml"))), ("x.xml", b"<x/>")])
    index = I.build_index(staged(explode_packages(packages(spark, ("p", blob))), "entries"))
    assert rows(index["relationships"], "id", "resolved_target") == [("a", "/x.xml")] and index["diagnostics"].count() == 0
    assert rows(index["parts"].filter("path = '/x.xml'"), "content_type") == [("t/x",)] and len(passes) == 1


def test_what_packages_share_is_deflated_and_parsed_once(spark, monkeypatch):
    from packlake.operators import shred
    from packlake.sources import packages as P

    class Here:
        """A table whose task function is called in this process."""

        columns = ("package", "path", "content")

        def __init__(self, batch):
            self.batch = batch

        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):
            return [row for batch in task(iter([self.batch])) for row in batch.to_pylist()]

    def counted(module, name):
        calls, plain = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *given: calls.append(given) or plain(*given))
        return calls

    deflated, parsers = counted(P, "_deflated"), counted(shred, "_new_parser")
    own = ["<a>%d</a>" % n for n in range(5)] + ["<a>" + "é" * 3000 + "</a>"] * 2
    files = [[{"name": "same.xml", "content": "<s><t/></s>"}, {"name": "ü.xml", "content": text}] for text in own] + [[]]
    table = pa.table({"package": [str(n) for n in range(8)], "files": files})
    packed = P.pack_zip(Here(table.to_batches()[0]))
    assert len(deflated) == 1 + 5 + 2
    for row, given in zip(packed, files, strict=True):
        with zipfile.ZipFile(io.BytesIO(row["content"])) as found:
            assert found.testzip() is None
            assert [(i.filename, found.read(i).decode()) for i in found.infolist()] == [(f["name"], f["content"]) for f in given]

    bad = "<s><t></s>"
    contents = [b"<s><t/></s>", bad.encode(), b"<u/>"] * 3
    table = pa.table({"package": [str(n) for n in range(9)], "path": ["/x"] * 9, "content": contents})
    events = shred.shred_xml(Here(table.to_batches()[0]))
    assert len(parsers) == 3
    assert [(e["package"], e["event"], e["local"]) for e in events[:5]] == [
        ("0", "Start", "s"), ("0", "Empty", "t"), ("0", "End", "s"), ("1", "Error", None), ("2", "Empty", "u"),
    ]
    assert [{**e, "package": ""} for e in events[:5]] * 3 == [{**e, "package": ""} for e in events]


def test_entries_without_markup_stay_unread(spark):
    """Small entries are inflated before their first byte is looked at, large ones after it."""
    contents = [b"<a/>", b"", b"PNG", b" <a/>" + bytes(200_000), os.urandom(200_000)]
    blob = zip_bytes([(f"{n}.xml", content) for n, content in enumerate(contents)])
    found = explode_packages(packages(spark, ("p", blob)), with_content=True, only_markup=True).orderBy("ord").collect()
    no = "malformed XML: no element found"
    assert [r["read_error"] for r in found[:4]] == [None, None, no, None]
    assert [r["content"] for r in found[:4]] == [contents[0], b"", None, contents[3]]
    assert contents[4][:1] in (b"<", b"\xef", b"\xff", b"\xfe", b" ", b"\t", b"\n", b"\r") or found[4]["read_error"] == no
