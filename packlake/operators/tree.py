"""The path tree of each package. A path has at most 64 components, which bounds the explodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.functions.paths import ancestors
from packlake.functions.text import ascii_lower

NODE = ["package", "node", "parent", "depth", "name", "is_leaf"]


def _described(nodes: DataFrame) -> DataFrame:
    """Node columns that follow from the path."""
    node = F.col("node")
    parent = F.regexp_extract(node, r"(?s)\A(.*)/", 1)
    return nodes.select(
        "package",
        "node",
        F.when(parent != "", parent).alias("parent"),
        (F.char_length(node) - F.char_length(F.replace(node, F.lit("/"), F.lit("")))).alias("depth"),
        F.substring_index(node, "/", -1).alias("name"),
        "is_leaf",
    )


def _climbed(nodes: DataFrame) -> DataFrame:
    """`(package, node, inner)`: each given node and all above it, `inner` for the latter."""
    return nodes.select("package", "node", F.posexplode(ancestors("node")).alias("i", "up")).select(
        "package", F.col("up").alias("node"), (F.col("up") != F.col("node")).alias("inner")
    )


def tree_nodes(parts: DataFrame) -> DataFrame:
    """Every part path and every implied ancestor, once. One shuffle, merged per task first."""
    merged = (
        _climbed(parts.select("package", F.col("path").alias("node")))
        .groupBy("package", "node")
        .agg((~F.max("inner")).alias("is_leaf"))
    )
    return _described(merged)


def branch_nodes(tree: DataFrame) -> DataFrame:
    """Nodes with children."""
    return tree.filter(~F.col("is_leaf"))


def filter_tree(tree: DataFrame, query: str) -> DataFrame:
    """Nodes whose path contains `query` (ASCII case ignored) with all below and above them.

    What is below a match contains the match's path, hence the query, so it matches itself.
    """
    if not query:
        return tree.select(*NODE)
    hits = tree.filter(F.contains(ascii_lower("node"), ascii_lower(F.lit(query))))
    kept = _climbed_with_leaf(hits)
    return _described(kept)


def _climbed_with_leaf(hits: DataFrame) -> DataFrame:
    return (
        hits.select("package", F.col("node").alias("hit"), "is_leaf", F.explode(ancestors("node")).alias("node"))
        .select("package", "node", (F.col("is_leaf") & (F.col("node") == F.col("hit"))).alias("leaf"))
        .groupBy("package", "node")
        .agg(F.min("leaf").alias("is_leaf"))
    )


def filter_tree_matches(tree: DataFrame, matches: DataFrame) -> DataFrame:
    """The same for an exact set of `(package, path)` matches."""
    wanted = matches.select("package", F.col("path").alias("up")).distinct()
    below = (
        tree.select("package", "node", "is_leaf", F.explode(ancestors("node")).alias("up"))
        .join(wanted, ["package", "up"], "left_semi")
        .select("package", "node", "is_leaf")
    )
    return _described(_climbed_with_leaf(below))


KINDS = ("Xml", "Image", "Binary")


def directory_totals(parts: DataFrame) -> DataFrame:
    """`(package, node, n_children, n_parts, size, compressed_size, n_xml, n_image, n_binary)` of each directory.

    A directory is what parts lie below, or an entry of that kind, and `/` of every package; `n_children`
    counts what lies directly in it, the rest all parts below it. Parts are summed up by their own directory
    first, so only sums of directories are handed on to all above them: a directory of very many parts
    gives one row, merged per task before it is moved.
    """
    named = parts.select("package", F.col("path").alias("node"), "kind", "size", "compressed_size")
    up = F.regexp_extract("node", r"(?s)\A(.*)/", 1)
    is_dir = F.col("kind") == "Directory"
    own = named.select(
        "package",
        F.when(is_dir, F.col("node")).otherwise(F.when(up == "", F.lit("/")).otherwise(up)).alias("node"),
        is_dir.alias("is_dir"),
        F.when(~is_dir, 1).otherwise(0).alias("n"),
        F.when(~is_dir, F.coalesce("size", F.lit(0))).otherwise(0).alias("size"),
        F.when(~is_dir, F.coalesce("compressed_size", F.lit(0))).otherwise(0).alias("compressed_size"),
        *((F.col("kind") == kind).cast("int").alias(kind) for kind in KINDS),
    )
    sums = ["n", "size", "compressed_size", *KINDS]
    by_directory = own.groupBy("package", "node").agg(*(F.sum(c).alias(c) for c in sums))
    above = F.when(F.col("node") == "/", F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), ancestors("node")))
    totals = (
        by_directory.select("package", F.explode(above).alias("node"), *sums)
        .groupBy("package", "node")
        .agg(*(F.sum(c).alias(c) for c in sums))
    )
    # A path that is both a part and a directory is one node, so paths are counted once.
    below = totals.filter(F.col("node") != "/").select("package", "node").unionByName(named.select("package", "node"))
    parent = F.when(up == "", F.lit("/")).otherwise(up)
    children = (
        below.distinct().select("package", parent.alias("node")).groupBy("package", "node").agg(F.count(F.lit(1)).alias("n_children"))
    )
    return totals.join(children, ["package", "node"], "left").select(
        "package",
        "node",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n").alias("n_parts"),
        "size",
        "compressed_size",
        *(F.col(kind).alias(f"n_{kind.lower()}") for kind in KINDS),
    )
