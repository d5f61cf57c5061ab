import random

import pytest
from helpers import value
from pyspark.sql import functions as F

from packlake.functions import paths as P
from packlake.functions import text as T


@pytest.mark.parametrize(
    "raw, want",
    [
        ("/a\\\\b/../c", "a/c"),
        ("../../x", "x"),
        ("a/./b//c/", "a/b/c"),
        ("./", ""),
        ("..", ""),
        ("a/..b/...", "a/..b/..."),
        ("plain/name.xml", "plain/name.xml"),
        ("a\\..\\b", "b"),
    ],
)
def test_normalize(spark, raw, want):
    assert value(spark, P.normalize_path("x"), x=raw) == want


def test_normalize_random_names(spark):
    def model(path):
        out = []
        for piece in path.replace("\\", "/").split("/"):
            if piece == "..":
                out[-1:] = []
            elif piece not in ("", "."):
                out.append(piece)
        return "/".join(out)

    rng = random.Random(7)
    names = ["".join(rng.choice(["a", "b", "/", "\\", ".", "..", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = df.select("x", P.normalize_path("x").alias("v"), P.unsafe_name("x").alias("u")).collect()
    for row in got:
        assert row["v"] == model(row["x"]), repr(row["x"])
        unsafe = ".." in row["x"].split("/") or row["x"].startswith("/") or "\\" in row["x"]
        assert row["u"] == unsafe, repr(row["x"])


@pytest.mark.parametrize(
    "name, is_dir, want",
    [
        ("custom.XML", False, "Xml"),
        ("media/PHOTO.JpEg", False, "Image"),
        ("_rels/.rels", False, "Binary"),
        ("a.rels", False, "Xml"),
        ("x/", True, "Directory"),
        ("noext", False, "Binary"),
        ("a.xml/b", False, "Binary"),
        ("a.xml/.", False, "Xml"),
    ],
)
def test_kind_by_name(spark, name, is_dir, want):
    assert value(spark, P.classify_kind("x", F.lit(is_dir)), x=name) == want


@pytest.mark.parametrize(
    "content_type, want",
    [
        ("application/vnd.openxmlformats-officedocument.presentationml.slide+xml", True),
        ("application/xml", True),
        ("Text/XML ; charset=utf-8", True),
        ("application/json", False),
        ("image/png", False),
        ("a+xml;b", True),
    ],
)
def test_xml_content_types(spark, content_type, want):
    assert value(spark, P.is_xml_content_type("x"), x=content_type) is want


@pytest.mark.parametrize(
    "path, want",
    [
        ("_rels/.rels", "/"),
        ("_rels/a.xml.rels", "/a.xml"),
        ("ppt/_rels/presentation.xml.rels", "/ppt/presentation.xml"),
        ("a/_rels/b/_rels/c.rels", "/a/_rels/b/c"),
        ("ppt/_rels/x.RELS", None),
        ("misc/x.rels", None),
        ("a/_rels/.rels", "/a/"),
    ],
)
def test_relationship_source(spark, path, want):
    assert value(spark, P.relationship_source("x"), x=path) == want


@pytest.mark.parametrize(
    "source, target, want",
    [
        ("/ppt/presentation.xml", "slides/slide1.xml", "/ppt/slides/slide1.xml"),
        ("/ppt/slides/slide1.xml", "../media/i.png", "/ppt/media/i.png"),
        ("/", "word/document.xml", "/word/document.xml"),
        ("/a/b", "/x/../y", "/y"),
        ("/a/b", "..\\c", "/c"),
        ("/a/b", "#frag", "/a/#frag"),
    ],
)
def test_resolve_target(spark, source, target, want):
    assert value(spark, P.resolve_target("s", "t"), s=source, t=target) == want


def test_ancestors_and_labels(spark):
    assert value(spark, P.ancestors("x"), x="/a/b/c") == ["/a", "/a/b", "/a/b/c"]
    assert value(spark, P.type_label("x"), x="http://x/y/slide") == "slide"
    assert value(spark, P.extension_label("x", F.lit(False)), x="/_rels/.rels") == "Binary/unsupported"
    assert value(spark, P.default_extension("x"), x="/a.B/c") == "b/c"


def test_text_functions(spark):
    assert value(spark, T.clean_text("x"), x=" a  b\t\nc\x85") == "a b c"
    assert value(spark, T.clean_text("x", 3), x="a  bc d") == "a b"
    assert value(spark, T.compact_text("x", 3), x="abcd") == "abc…"
    assert value(spark, T.compact_text("x", 4), x="abcd") == "abcd"
    assert value(spark, T.ascii_lower("x"), x="AÉİ") == "aÉİ"
    for n, want in [(0, ""), (1, "a"), (2, "a"), (3, "aé"), (4, "aé"), (6, "aé"), (7, "aé😀"), (99, "aé😀")]:
        assert value(spark, T.byte_prefix("x", n), x="aé😀") == want
