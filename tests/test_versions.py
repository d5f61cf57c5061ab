"""Results on streams across restarts, packages that change in place, tables in buckets."""

import pytest
from helpers import packages, rows, zip_bytes
from pyspark.sql import functions as F

from packlake.operators.details import dangling_relationships, node_degrees
from packlake.plans.queries import QUERIES
from packlake.sources.buckets import BucketedIndex
from packlake.streaming.requests import REQUEST, RESULT, SELECTION, current_results, latest_wins
from packlake.streaming.versions import VersionedIndex

CHANGE = "key long, kind string, request_id long, path string"


class Arrivals:
    """Batches of changes to a stream that is stopped and started again after each."""

    def __init__(self, spark, folder, **how):
        self.spark, self.folder, self.how = spark, str(folder), how

    def arrive(self, *changes):
        self.spark.createDataFrame(list(changes), CHANGE).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(CHANGE).parquet(f"{self.folder}/in")
        query = current_results(stream, **self.how).writeStream.format("parquet").option("path", f"{self.folder}/out")
        query = query.option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return rows(self.spark.read.schema("key long, request_id long, path string").parquet(f"{self.folder}/out"))


def test_results_before_with_and_after_their_replacement(spark, tmp_path):
    a = Arrivals(spark, tmp_path)
    first = [(1, 5, "/a")]
    assert a.arrive((1, REQUEST, 5, None), (1, SELECTION, 1, "/a"), (1, RESULT, 5, "/a"), (1, RESULT, 4, "/a"), (2, RESULT, 1, "/x")) == first
    # A result of the old request and one of its replacement come together with the replacement.
    second = sorted(first + [(1, 7, "/a")])
    assert a.arrive((1, RESULT, 5, "/a"), (1, REQUEST, 7, None), (1, RESULT, 7, "/a"), (1, RESULT, 7, "/b")) == second
    # In the next runs: results of the replaced request, and of the current one after the selection moved on.
    assert a.arrive((1, RESULT, 5, "/a"), (1, RESULT, 6, "/a"), (1, REQUEST, 6, None)) == second
    assert a.arrive((1, SELECTION, 9, "/b"), (1, SELECTION, 8, "/a"), (1, RESULT, 7, "/a"), (1, RESULT, 7, "/b")) == sorted(second + [(1, 7, "/b")])
    assert a.arrive((1, RESULT, None, None), (2, REQUEST, 1, None), (2, SELECTION, 1, "/x")) == sorted(second + [(1, 7, "/b")])
    assert (2, 1, "/x") in a.arrive((2, RESULT, 1, "/x"))


def test_one_batch_is_the_rule_on_tables(spark, tmp_path):
    changes = []
    for k in range(2000):
        key = 0 if k % 2 else k % 37  # a hot key
        changes += [(key, REQUEST, k, None), (key, RESULT, k, f"/{k % 3}"), (key, SELECTION, k, f"/{k % 5}")]
    got = Arrivals(spark, tmp_path).arrive(*changes)
    df = spark.createDataFrame(changes, CHANGE)
    chosen = df.filter(F.col("kind") == SELECTION).groupBy("key").agg(F.max_by("path", "request_id").alias("path"))
    want = latest_wins(df.filter(F.col("kind") == REQUEST), df.filter(F.col("kind") == RESULT).drop("kind"), chosen)
    assert got == rows(want, "key", "request_id", "path") and got


def blob(**files):
    return zip_bytes([(name, data) for name, data in files.items()])


def test_three_versions(spark, tmp_path):
    index = VersionedIndex(spark, f"{tmp_path}/index")
    assert index.current() == 0 and rows(index.parts()) == [] and rows(index.manifest()) == []
    first = packages(spark, ("p", blob(a=b"1", b=b"2")), ("q", blob(a=b"1")), ("bad", b"none"))
    assert index.refresh(first) == 1
    assert index.refresh(first) == 1  # a repeated batch changes nothing
    second = packages(spark, ("p", blob(a=b"1", b=b"3", c=b"4")), ("q", blob(a=b"1")), ("bad", b"none"))
    assert index.refresh(second) == 2
    assert rows(index.changes(2), "package", "path", "change") == [("p", "/b", "changed"), ("p", "/c", "added")]
    third = packages(spark, ("p", blob(a=b"1", b=b"3", c=b"4")), ("r", blob(z=b"0")))
    assert index.refresh(third) == 3
    assert rows(index.changes(3), "package", "path", "change") == [("q", "/a", "removed"), ("r", "/z", "added")]
    assert rows(index.parts(), "package", "path") == [("p", "/a"), ("p", "/b"), ("p", "/c"), ("r", "/z")]
    # Earlier versions are still there, and only what changed was written again.
    assert rows(index.parts(1), "package", "path") == [("p", "/a"), ("p", "/b"), ("q", "/a")]
    assert rows(index.parts(2), "package", "path") == [("p", "/a"), ("p", "/b"), ("p", "/c"), ("q", "/a")]
    assert rows(spark.read.parquet(f"{tmp_path}/index/parts/version=3"), "package") == [("r",)]
    # A part of the packages only.
    assert index.refresh(packages(spark, ("p", blob(a=b"9"))), complete=False) == 4
    assert rows(index.parts(), "package", "path") == [("p", "/a"), ("r", "/z")]
    assert index.refresh(first.limit(0)) == 5 and rows(index.parts()) == []


def test_a_refresh_that_fails_leaves_the_current_version(spark, tmp_path, monkeypatch):
    index = VersionedIndex(spark, f"{tmp_path}/index")
    index.refresh(packages(spark, ("p", blob(a=b"1"))))

    def fail(version):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(index, "_switch", fail)
        with pytest.raises(OSError):
            index.refresh(packages(spark, ("p", blob(a=b"2"))))
    assert index.current() == 1 and rows(index.parts(), "path") == [("/a",)]
    assert index.refresh(packages(spark, ("p", blob(b=b"2")))) == 2
    assert rows(index.changes(2), "path", "change") == [("/a", "removed"), ("/b", "added")]


PARTS = "package string, path string, archive_name string, content_type string, size bigint, compressed_size bigint, kind string"
RELS = "package string, source string, rel_ord bigint, id string, relationship_type string, target string, resolved_target string, target_mode string"


def graph(spark, package, n):
    parts = [(package, f"/d{k % 7}/p{k}", f"p{k}", None, k, k, "Xml") for k in range(n)]
    rels = [(package, f"/d{k % 7}/p{k}", k, "r", "t", "x", f"/d{(k + 1) % 7}/p{k + 1}" if k % 3 else "/d1", "Internal") for k in range(n)]
    rels += [(package, "/d0/p0", n + k, "r", "t", "x", "/d0/p7", "Internal") for k in range(500)]  # a hot target
    return spark.createDataFrame(parts, PARTS), spark.createDataFrame(rels, RELS)


def test_buckets_join_without_exchange(spark, tmp_path):
    index = BucketedIndex(spark, f"{tmp_path}/index", buckets=4)
    one, two = graph(spark, "p", 200), graph(spark, "q", 50)
    index.append(*one)
    index.append(*two)
    parts, rels = one[0].unionByName(two[0]), one[1].unionByName(two[1])
    again = BucketedIndex(spark, f"{tmp_path}/index", buckets=4)
    found, known = again.dangling(), again.node_degrees()
    assert rows(found, "package", "source", "resolved_target") == rows(dangling_relationships(rels, parts), "package", "source", "resolved_target")
    want = node_degrees(parts, rels)
    assert rows(known, "package", "path", "n_out", "n_in") == rows(want, "package", "path", "n_out", "n_in")
    for df in (found, known):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan, plan
    # Every append has one file for each bucket at most.
    files = {f.rsplit("/", 1)[-1] for f in again.table("links").inputFiles()}
    assert len(files) <= 8


def test_empty_buckets(spark, tmp_path):
    index = BucketedIndex(spark, f"{tmp_path}/index", buckets=2)
    parts, rels = graph(spark, "p", 3)
    index.append(parts.limit(0), rels.limit(0))
    assert rows(index.dangling()) == [] and rows(index.node_degrees()) == []


def test_query_packs_its_packages_once(spark, monkeypatch):
    seen = []
    refresh = VersionedIndex.refresh

    def watched(self, packages, complete=True):
        seen.append(packages._jdf.queryExecution().executedPlan().toString())
        return refresh(self, packages, complete)

    monkeypatch.setattr(VersionedIndex, "refresh", watched)
    QUERIES["versioned_index"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 4 and not any("MapInArrow" in plan for plan in seen)
