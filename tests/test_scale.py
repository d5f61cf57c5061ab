"""Hot keys: one part, path or package holds a third of all rows."""

import collections
import os

import pytest
from helpers import packages, rows, zip_bytes
from pyspark.sql import functions as F

from packlake import session
from packlake.functions import paths as P
from packlake.limits import Limits
from packlake.operators import details, search, tree
from packlake.operators import index as I
from packlake.operators import workbook as W
from packlake.sources.packages import explode_packages, read_part

N = 60_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rels(spark):
    target = F.when(F.col("id") % 3 == 0, "/hot").otherwise(F.concat(F.lit("/t"), F.col("id") % 1000))
    return spark.range(N).select(
        F.lit("p").alias("package"),
        F.concat(F.lit("/s"), F.col("id") % 500).alias("source"),
        F.col("id").alias("rel_ord"),
        F.lit("r").alias("id"),
        F.lit("x/image").alias("relationship_type"),
        target.alias("target"),
        target.alias("resolved_target"),
        F.lit("Internal").alias("target_mode"),
    )


def test_degrees_are_aggregated_before_the_shuffle(spark):
    found = I.degrees(hot_rels(spark))
    got = {r["path"]: (r["n_out"], r["n_in"]) for r in found.collect()}
    incoming = collections.Counter("/hot" if i % 3 == 0 else f"/t{i % 1000}" for i in range(N))
    assert got["/hot"] == (0, N // 3) and got["/s7"] == (N // 500, 0)
    assert all(got[t][1] == n for t, n in incoming.items())
    plan = plan_of(found)
    # The first aggregate is below the only exchange.
    assert plan.count("Exchange hashpartitioning") >= 1
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")


def test_hot_dangling_target_keeps_all_rows(spark):
    parts = spark.range(1000).select(
        F.lit("p").alias("package"), F.concat(F.lit("/t"), F.col("id")).alias("path")
    )
    lost = details.dangling_relationships(hot_rels(spark), parts)
    assert lost.count() == N // 3


def test_repeated_path_costs_one_row_per_task(spark):
    entries = spark.range(N).select(
        F.lit("p").alias("package"),
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, "./hot.xml").otherwise(F.concat(F.lit("f"), F.col("id") % 5000)).alias("archive_name"),
        F.lit(False).alias("is_dir"),
        F.lit(1).cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("compressed_size"),
    )
    parts = I.dedupe_first_wins(entries)
    assert rows(parts.filter("path = '/hot.xml'"), "ord", "kind") == [(0, "Xml")]
    n_paths = parts.count()
    named = I.depth_guard(I.named_entries(entries))
    assert I.collisions(named).count() == N - n_paths
    assert "WindowGroupLimit" in plan_of(parts)


def test_search_hits_of_a_hot_package_are_capped_per_task(spark):
    parts = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 700)).alias("package"),
        F.concat(F.lit("/"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("path"),
        F.lit("Binary").alias("kind"),
        F.lit(6).cast("bigint").alias("size"),
        F.lit("needle").cast("binary").alias("content"),
    )
    found = search.search_content(parts, ["needle"], Limits(search_hits=100))
    hot = rows(found.filter("package = 'hot'"), "path")
    assert hot == [(f"/{i:08d}",) for i in range(0, 300, 3)]
    assert plan_of(found).count("WindowGroupLimit") >= 2


def test_hot_ancestor_is_one_row_per_task(spark):
    parts = spark.range(N).select(
        F.lit("p").alias("package"), F.concat(F.lit("/hot/"), F.col("id")).alias("path")
    )
    nodes = tree.tree_nodes(parts)
    assert nodes.count() == N + 1
    assert rows(nodes.filter("not is_leaf"), "node") == [("/hot",)]


def test_hot_shared_string(spark):
    cells = spark.range(N).select(
        F.lit("p").alias("package"),
        F.lit("s").alias("cell_type"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000).cast("string").alias("value"),
    )
    strings = spark.range(1000).select(
        F.lit("p").alias("package"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("v"), F.col("id")).alias("value")
    )
    got = collections.Counter(r["value"] for r in W.resolve_shared(cells, strings).collect())
    want = collections.Counter()
    for i in range(N):
        k = 0 if i % 3 == 0 else i % 2000
        want[f"v{k}" if k < 1000 else ""] += 1
    assert got == want


def test_bytes_stay_where_they_are(spark):
    """From entries to read parts there is no exchange at all."""
    entries = spark.createDataFrame(
        [("p", 0, "a.xml", False, 4, 4, bytearray(b"<a/>"), None, 0)],
        "package string, ord int, archive_name string, is_dir boolean, size bigint, "
        "compressed_size bigint, content binary, read_error string, copy int",
    )
    assert "Exchange" not in plan_of(I.part_contents(entries))
    assert "Exchange" not in plan_of(I.dedupe_first_wins(entries))


def test_static_broadcasts_are_off(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold").rstrip("b")) == 10485760


def test_a_session_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare, "x")


def test_scratch_tables_are_removed(spark, tmp_path):
    with session.Scratch(spark) as scratch:
        kept = scratch.staged(spark.range(3), "numbers")
        path = scratch.paths[0].removeprefix("file:")
        assert kept.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_path_fold_is_not_in_a_filter(spark):
    rels = hot_rels(spark).withColumn("resolved_target", P.resolve_target("source", "target"))
    for found in (details.relationship_targets(rels), I.incoming(rels)):
        filters = [x for x in plan_of(found).split("\n") if " Filter " in x]
        assert not any("aggregate(" in x for x in filters)


def test_read_part_does_not_move_bytes(spark):
    blob = zip_bytes([("a.xml", b"<a/>"), ("b", b"x")])
    df = packages(spark, ("p", blob), ("q", blob))
    parts = I.dedupe_first_wins(explode_packages(df))
    asked = spark.createDataFrame([("p", "/b"), ("q", "/lost"), ("q", "/a.xml")], "package string, path string")
    found = read_part(df, parts, asked)
    assert rows(found, "package", "path", "read_error", "content") == [
        ("p", "/b", None, bytearray(b"x")), ("q", "/a.xml", None, bytearray(b"<a/>")), ("q", "/lost", "part not found: /lost", None),
    ]
    assert "Exchange hashpartitioning" not in plan_of(found)
