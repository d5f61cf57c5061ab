"""Reachability, orphans and directory totals."""

import random

from helpers import rows

from packlake.operators import graph as graph_module
from packlake.operators.graph import orphan_parts, package_roots, reachable_parts
from packlake.operators.tree import directory_totals
from packlake.plans.adapters import Tables, graph_relationships

PARTS = "package string, path string, kind string"
RELS = "package string, source string, resolved_target string, target_mode string"


def graph(spark, links, extra=(), package="p", outside=()):
    nodes = sorted({n for link in links for n in link if n != "/"} | set(extra))
    parts = spark.createDataFrame([(package, n, "Xml") for n in nodes], PARTS)
    rels = [(package, a, b, "Internal") for a, b in links] + [(package, a, None, "External") for a in outside]
    return parts, spark.createDataFrame(rels, RELS)


def test_cycle_of_three_ends(spark):
    parts, rels = graph(spark, [("/", "/a"), ("/a", "/b"), ("/b", "/c"), ("/c", "/a"), ("/c", "/c")], extra=["/lone"])
    reached = reachable_parts(parts, rels)
    assert rows(reached, "path", "hops") == [("/a", 1), ("/b", 2), ("/c", 3)]
    assert rows(orphan_parts(parts, reached), "path") == [("/lone",)]


def test_long_chain(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        parts, rels = graph(spark, [("/", "/n000")] + [(f"/n{k:03}", f"/n{k + 1:03}") for k in range(34)])
        reached = reachable_parts(parts.coalesce(1), rels.coalesce(1))
        assert rows(reached, "path", "hops") == [(f"/n{k:03}", k + 1) for k in range(35)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_hub_and_what_is_not_followed(spark):
    links = [("/", "/hub")] + [("/hub", f"/leaf{k}") for k in range(3000)] + [("/leaf7", "/end"), ("/hub", "/leaf7")]
    parts, rels = graph(spark, links, outside=["/hub"])
    missing = spark.createDataFrame([("p", "/hub", "/gone", "Internal"), ("p", "/gone", "/never", "Internal")], RELS)
    found = dict(rows(reachable_parts(parts, rels.unionByName(missing), hub_links=100), "path", "hops"))
    assert len(found) == 3002 and found["/end"] == 3 and found["/leaf2999"] == 2


def test_packages_are_apart_and_starts_count(spark):
    a, ra = graph(spark, [("/x", "/y"), ("/y", "/z")])
    b, rb = graph(spark, [("/x", "/y")], package="q", extra=["/z"])
    starts = spark.createDataFrame([("p", "/x"), ("q", "/y"), ("q", "/y")], "package string, path string")
    reached = reachable_parts(a.unionByName(b), ra.unionByName(rb), starts)
    assert rows(reached, "package", "path", "hops") == [("p", "/x", 0), ("p", "/y", 1), ("p", "/z", 2), ("q", "/y", 0)]


def test_empty_tables(spark):
    parts, rels = spark.createDataFrame([], PARTS), spark.createDataFrame([], RELS)
    assert rows(reachable_parts(parts, rels)) == []
    assert rows(package_roots(parts)) == []
    lone, _ = graph(spark, [], extra=["/a", "/[Content_Types].xml", "/_rels/.rels"])
    assert rows(orphan_parts(lone, reachable_parts(lone, rels)), "path") == [("/a",)]


def test_random_graphs(spark):
    draw = random.Random(4)
    for _ in range(1):
        links = [(f"/{draw.randint(0, 30)}", f"/{draw.randint(0, 30)}") for _ in range(60)] + [("/", "/0"), ("/", "/1")]
        hops, front = {}, {"/"}
        for n in range(1, 40):
            front = {b for a, b in links if a in front} - set(hops)
            hops |= dict.fromkeys(front, n)
        parts, rels = graph(spark, links)
        assert dict(rows(reachable_parts(parts, rels, hub_links=2), "path", "hops")) == hops


TOTALS = "package string, path string, kind string, size bigint, compressed_size bigint"


def test_directory_totals(spark):
    parts = [
        ("p", "/a/b/one.xml", "Xml", 5, 2),
        ("p", "/a/b/two.png", "Image", 7, 7),
        ("p", "/a/three", "Binary", 1, 1),
        ("p", "/empty", "Directory", 9, 9),
        ("p", "/root.xml", "Xml", 2, None),
        ("p", "/a", "Directory", 0, 0),
        ("q", "/a/b", "Xml", 1, 1),
        ("q", "/a/b/c", "Xml", 3, 1),  # a part that is a directory as well
    ]
    found = {r[:2]: r[2:] for r in rows(directory_totals(spark.createDataFrame(parts, TOTALS)))}
    assert found["p", "/"] == (3, 4, 15, 10, 2, 1, 1)
    assert found["p", "/a"] == (2, 3, 13, 10, 1, 1, 1)
    assert found["p", "/a/b"] == (2, 2, 12, 9, 1, 1, 0)
    assert found["p", "/empty"] == (0, 0, 0, 0, 0, 0, 0)
    assert found["q", "/a"] == (1, 2, 4, 2, 2, 0, 0) and found["q", "/a/b"] == (1, 1, 3, 1, 1, 0, 0)
    assert len(found) == 7
    assert rows(directory_totals(spark.createDataFrame([], TOTALS))) == []


def test_many_parts_in_one_directory_are_summed_before_the_exchange(spark):
    parts = spark.range(20000).selectExpr("'p' package", "concat('/d/e/', id) path", "'Xml' kind", "id size", "1L compressed_size")
    found = {r[1]: r for r in rows(directory_totals(parts))}
    assert found["/d/e"][2:5] == (20000, 20000, 19999 * 10000) and found["/"][2] == 1


def test_a_large_frontier_takes_its_links_along(spark, monkeypatch):
    kept = {}

    class Recording(graph_module.Scratch):
        def staged(self, df, purpose):
            table = super().staged(df, purpose)
            kept.setdefault(purpose, []).append(table.count())
            return table

    monkeypatch.setattr(graph_module, "Scratch", Recording)
    links = [(f"/s{k}", f"/t{k % 5}") for k in range(90)] + [(f"/t{k}", "/end") for k in range(5)]
    parts, rels = graph(spark, links)
    starts = parts.filter("path like '/s%'").select("package", "path")
    found = dict(rows(reachable_parts(parts, rels, starts), "path", "hops"))
    assert (found["/s7"], found["/t2"], found["/end"], len(found)) == (0, 1, 2, 96)
    assert kept["links"][:2] == [95, 5]  # those of the starts are done with


def test_rows_are_dealt_without_a_sort(spark):
    plan = graph_relationships(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan
