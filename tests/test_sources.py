"""Ranged reads of package files, many needles, compound files, previews of packages."""

import io
import os
import struct
import zipfile

import pytest
from helpers import packages, rows, zip_bytes
from pyspark.sql import functions as F

from packlake.limits import Limits
from packlake.operators.preview import preview_packages
from packlake.sources import compound
from packlake.sources.datasource import PackageReader, read_packages, write_packages
from packlake.sources.packages import Ranges, explode_packages, search_packages

NOISE = os.urandom(3_000_000)


def large_package():
    return zip_bytes([("noise.bin", NOISE), ("word/document.xml", b"<small/>"), ("more.bin", NOISE)], stored=True)




def test_bytes_read_for_one_small_part():
    blob = large_package()
    reader = PackageReader({"path": "/x", "content": "all"})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("archive_name",), "word/document.xml")])) == []
    file = Ranges(io.BytesIO(blob))
    (row,) = reader.entries("p", file)
    assert row[2] == "word/document.xml" and row[6] == b"<small/>"
    assert file.bytes_read < 70_000 < len(blob) / 50
    nothing = PackageReader({"path": "/x", "content": "none"})
    file = Ranges(io.BytesIO(blob))
    assert len(list(nothing.entries("p", file))) == 3 and file.bytes_read < 70_000


def test_source_has_the_rows_of_explode(spark, tmp_path):
    blobs = [("a.docx", zip_bytes([("x.xml", b"<x/>"), ("[Content_Types].xml", b"<Types/>"), ("d/", b""), ("x.xml", b"2")]))]
    blobs += [("b.docx", b"no package"), ("c.xlsx", large_package()), ("d.docx", b"")]
    given = packages(spark, *blobs)
    assert write_packages(given, f"{tmp_path}/corpus") == 4
    for content, how in [("metadata", {}), ("all", {"with_content": True})]:
        found = read_packages(spark, f"{tmp_path}/corpus", content=content)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, explode_packages(given, **how).collect()), key=str)
    assert read_packages(spark, f"file://{tmp_path}/corpus").count() == found.count()
    assert read_packages(spark, f"{tmp_path}/corpus", glob="*.pptx").count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    write_packages(packages(spark, ("a.docx", zip_bytes([("x.xml", b"<x/>"), ("y.bin", b"12345")]))), f"{tmp_path}/c")
    found = read_packages(spark, f"{tmp_path}/c", content="all")
    for kept, want in [
        (F.col("archive_name").endswith(".bin"), ["y.bin"]),
        (F.col("archive_name").startswith("x"), ["x.xml"]),
        (F.col("archive_name").contains("."), ["x.xml", "y.bin"]),
        (F.col("size") > 4, ["y.bin"]),
        (F.col("ord").isin(0, 7), ["x.xml"]),
        ((F.col("package") == "a.docx") & (F.col("size") < 5), ["x.xml"]),
        (F.upper("archive_name") == "X.XML", ["x.xml"]),  # stays with Spark
    ]:
        assert [r[0] for r in rows(found.filter(kept), "archive_name")] == want
    with pytest.raises(Exception):
        read_packages(spark, f"{tmp_path}/c", content="some").count()


def test_ten_thousand_needles(spark):
    text = "abcabd needle-00042x needle-9999 über " * 3
    blob = zip_bytes([("a.txt", text.encode()), ("b.txt", b""), ("c.bin", bytes(range(256)))])
    needles = [f"needle-{k:05}" for k in range(10_000)] + ["abc", "ab", "bcab", "a", "über", "ü", "\x80", "", "abc"]
    found = search_packages(packages(spark, ("p", blob)), needles)
    want = {(n, "/a.txt") for n in needles if n and n.encode() in text.encode()}
    want |= {(n, "/c.bin") for n in needles if n and n.encode() in bytes(range(256))}
    assert set(rows(found, "needle", "path")) == want and found.count() == len(want)
    passes = search_packages(packages(spark, ("p", blob)), needles, needle_bytes=20_000)
    assert rows(passes) == rows(found)
    assert search_packages(packages(spark, ("p", blob)), [""]).count() == 0


def test_hit_limit_and_long_needles(spark):
    blob = zip_bytes([(f"{k}.txt", b"x") for k in range(9)])
    assert search_packages(packages(spark, ("p", blob)), ["x"], Limits(search_hits=4)).count() == 4
    with pytest.raises(ValueError):
        search_packages(packages(spark, ("p", blob)), ["x" * 300], Limits(search_chars=256))


def compound_file(*names, fat=(0xFFFFFFFD, 0xFFFFFFFE), first=1):
    """A header, one allocation table and directory sectors of four entries each."""
    entries = b""
    for name in names:
        raw = name.encode("utf-16-le")
        entries += raw.ljust(64, b"\0") + struct.pack("<HB", len(raw) + 2, 2) + b"\0" * 61
    entries = entries.ljust(-(-max(len(entries), 1) // 512) * 512, b"\0")
    head = compound.MAGIC + b"\0" * 22 + struct.pack("<HH", 9, 6) + b"\0" * 10 + struct.pack("<II", 1, first)
    head = head.ljust(68, b"\0") + struct.pack("<II", 0xFFFFFFFE, 0) + struct.pack("<I", 0) + struct.pack("<I", 0xFFFFFFFF) * 108
    return head + b"".join(struct.pack("<I", f) for f in fat).ljust(512, b"\xff") + entries


@pytest.mark.parametrize(
    "blob, want",
    [
        (compound_file("Root Entry", "EncryptedPackage", "EncryptionInfo"), "package is encrypted"),
        (compound_file("Root Entry", "WordDocument"), "legacy text document, not a package"),
        (compound_file("Root Entry", "Workbook"), "legacy workbook, not a package"),
        (compound_file("Root Entry", "PowerPoint Document"), "legacy presentation, not a package"),
        (compound_file("Root Entry", "a", "b", "c", "Book", fat=(0xFFFFFFFD, 2, 0xFFFFFFFE)), "legacy workbook, not a package"),
        (compound_file("Root Entry"), "compound file, not a package"),
        (compound_file("Root Entry", "x", fat=(0xFFFFFFFD, 1)), "damaged compound file: chain of directory sectors loops"),
        (compound_file("Root Entry", fat=(0xFFFFFFFD, 90)), "damaged compound file: sector 90 lies beyond the end"),
        (compound.MAGIC, "damaged compound file: "),
        (b"PK", None),
    ],
)
def test_compound_files(blob, want):
    got = compound.problem(blob)
    assert got == want or want and want.endswith(": ") and got.startswith(want)


def test_compound_file_in_the_scan(spark, tmp_path):
    given = packages(spark, ("a.docx", compound_file("Root Entry", "EncryptedPackage")))
    assert rows(explode_packages(given), "ord", "read_error") == [(-1, "package is encrypted")]
    write_packages(given, f"{tmp_path}/c")
    assert rows(read_packages(spark, f"{tmp_path}/c"), "read_error") == [("package is encrypted",)]


def test_previews_of_packages(spark):
    types = b'<Types><Default Extension="dat" ContentType="text/xml"/><Override PartName="/O.BIN" ContentType="application/json"/></Types>'
    broken = bytearray(zip_bytes([("a.xml", b"<a><b/></a>")]))
    broken[40] ^= 0xFF
    blob = zip_bytes(
        [("[content_types].XML", types), ("x.dat", b"<a><b/></a>"), ("O.BIN", b"[1]"), ("d/", b""), ("t.txt", b"hi"), ("t.txt", b"ho"), ("i.png", b"?")]
    )
    found = {r[:2]: r[2:] for r in rows(preview_packages(packages(spark, ("p", blob), ("q", bytes(broken)), ("r", b"none"))))}
    assert found["p", "/x.dat"] == ("Xml", "<a>\n  <b/>\n</a>", None)
    assert found["p", "/O.BIN"][:2] == ("Json", "[\n  1\n]") and found["p", "/t.txt"][:2] == ("PlainText", "hi")
    assert found["p", "/i.png"][0] == "Error" and found["p", "/[content_types].XML"][0] == "Xml"
    assert found["q", "/a.xml"][0] == "Error" and found["q", "/a.xml"][2]
    assert len(found) == 6
    plan = preview_packages(packages(spark, ("p", blob)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert rows(preview_packages(packages(spark, ("p", blob)).limit(0))) == []
    assert zipfile.ZipFile(io.BytesIO(blob)).namelist()[3] == "d/"


def test_widest_webp_of_a_package_is_shown(spark, tmp_path):
    from packlake.plans.queries import QUERIES

    # Key 2707 has a width of 8192, which is the limit; key 2708 is over it.
    part = spark.createDataFrame([(2707, "n", 5), (2708, "n", 5)], "p_partkey long, p_name string, p_size int")
    part.write.parquet(str(tmp_path / "part.parquet"))
    found = rows(QUERIES["preview_packages"](spark, str(tmp_path)).filter("path in ('/i.png', '/w.webp')"), "package", "path", "preview_kind")
    assert found == [(f"m{k}", path, kind) for k, kind in ((2707, "Image"), (2708, "Error")) for path in ("/i.png", "/w.webp")]


def test_a_row_for_each_part_with_its_needles(spark):
    from packlake.sources.packages import part_needles

    blob = zip_bytes([("a.xml", b"one two"), ("b.xml", b"two"), ("c.xml", b"one of"), ("b.xml", b"one")])
    given = packages(spark, ("p", blob), ("q", zip_bytes([("a.xml", b"x")])), ("bad", b"no package"))
    needles = ["two", "one", "", "two", "wo"]
    for most in (1 << 20, 3):  # in one pass, in several
        found = part_needles(given, needles, needle_bytes=most)
        got = {(r["package"], r["path"]): sorted(r["needles"]) for r in found.collect()}
        assert got == {("p", "/a.xml"): ["one", "two", "wo"], ("p", "/b.xml"): ["two", "wo"], ("p", "/c.xml"): ["one"]}
        assert found.count() == 3 and search_packages(given, needles, needle_bytes=most).count() == 6


def test_small_files_are_one_read(tmp_path, monkeypatch):
    from packlake.sources import datasource

    (tmp_path / "a.docx").write_bytes(zip_bytes([("x.xml", b"<x/>"), ("y.xml", b"<y/>")]))
    (tmp_path / "b.docx").write_bytes(large_package())
    given = []
    monkeypatch.setattr(datasource, "Ranges", lambda file: given.append(file) or Ranges(file))
    reader = PackageReader({"path": str(tmp_path), "content": "all"})
    rows_of = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["package"], r["archive_name"]) for r in rows_of] == [
        ("b.docx", "noise.bin"), ("b.docx", "word/document.xml"), ("b.docx", "more.bin"), ("a.docx", "x.xml"), ("a.docx", "y.xml"),
    ]
    assert [isinstance(file, io.BytesIO) for file in given] == [False, True]
