"""The relationships of a package as a directed graph: what can be reached, and what cannot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.session import Scratch, staged

# Links of one node that are followed in one piece; a hub is cut into such pieces.
HUB_LINKS = 100_000
# Hashes by which links are counted before hubs are, and hashes up to which their nodes are counted apart.
HUB_HASHES, MOST_FULL = 1 << 18, 1000
# A frontier of one in so many of the nodes left takes its links and nodes out of the tables.
SHRINKING = 4
# Rounds after which what they met is written as one table again, and the plan is short again.
COMPACT_ROUNDS = 16
# Parts that describe a package and are no targets of its relationships.
CONTENT_TYPES = "[content_types].xml"
PACKAGE_ROOT = "/"


def package_roots(parts: DataFrame) -> DataFrame:
    """The source of the root relationships of each package."""
    return parts.select("package").distinct().select("package", F.lit(PACKAGE_ROOT).alias("path"))


def reachable_parts(
    parts: DataFrame, rels: DataFrame, starts: DataFrame | None = None, hub_links: int = HUB_LINKS
) -> DataFrame:
    """`(package, path, hops)`: parts that links lead to, with the least number of links.

    `starts` has `(package, path)`, by default the root of each package; a start that is a part has no
    hops. Only parts are reached and followed further: external targets, directories and targets that
    do not exist are not. Cycles end, since a node is followed when it is met first.

    Breadth first: each round joins the frontier with the links, and what that meets with the parts not met
    before. A node is followed once, so its links and its row are done with then: where the frontier is a
    good part of the nodes left, only the other links and parts stay for the next rounds. Frontiers are
    tables in the shared folder, so no round repeats an earlier one, and a lost executor reads them again.
    The links of a hub are dealt out in pieces of `hub_links`, each of which meets the hub's row by itself.
    """
    spark = parts.sparkSession
    node = ["package", "path"]
    now = F.lit(True).alias("now")
    with Scratch(spark) as scratch:
        starts = package_roots(parts) if starts is None else starts.select(*node)
        start, part = starts.distinct().select(*node, F.lit(True).alias("start")), F.lit(True).alias("part")
        # One join tells starts that are parts, other starts, and the parts that are still to be met.
        nodes = scratch.staged(parts.select(*node).distinct().select(*node, part).join(start, node, "full"), "nodes")
        frontier, unmet = nodes.filter("start").select(*node), nodes.filter("start is null").select(*node)
        found = [nodes.filter("start and part").select(*node, F.lit(0).alias("hops"))]
        n_frontier, n_left, hops = frontier.count(), nodes.count(), 0
        met_since: list[DataFrame] = []  # frontiers that `unmet` still has

        internal = rels.filter(F.col("target_mode") == "Internal")
        links = internal.select("package", F.col("source").alias("path"), F.col("resolved_target").alias("target"))
        links = scratch.staged(links, "links")
        n_links = links.count()
        hubs = scratch.staged(_hubs(links, hub_links), "hubs")
        with_hubs = not hubs.isEmpty()
        keys = node + ["piece"] * with_hubs
        if with_hubs:
            piece = F.pmod(F.xxhash64("target"), F.coalesce("pieces", F.lit(1))).cast("int")
            links = scratch.staged(links.join(hubs, node, "left").withColumn("piece", piece).drop("pieces"), "links")

        def in_pieces(frontier: DataFrame) -> DataFrame:
            if not with_hubs:
                return frontier
            pieces = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
            return frontier.join(hubs, node, "left").select(*node, F.explode(pieces).alias("piece"))

        while n_frontier and n_links:
            hops += 1
            many = n_frontier * SHRINKING >= n_left
            if many:
                marked = scratch.staged(links.join(in_pieces(frontier).select("*", now), keys, "left"), "followed")
                followed, links = marked.filter("now"), marked.filter("now is null").drop("now")
                if (left := links.count()) * 2 <= n_links:
                    links = scratch.staged(links, "links")
                n_links = left
            else:
                followed = links.join(in_pieces(frontier), keys)
            met = followed.select("package", F.col("target").alias("path")).distinct()
            if many:
                for earlier in met_since:
                    unmet = unmet.join(earlier, node, "left_anti")
                step = scratch.staged(unmet.join(met.select("*", now), node, "left"), "unmet")
                frontier, unmet, met_since = step.filter("now").select(*node), step.filter("now is null").select(*node), []
                n_left = step.count()
            else:
                new = met.join(unmet, node, "left_semi")
                if met_since:
                    new = new.join(reduce(DataFrame.unionByName, met_since), node, "left_anti")
                frontier = scratch.staged(new, "frontier")
                met_since.append(frontier)
                if len(met_since) == COMPACT_ROUNDS:
                    met_since = [scratch.staged(reduce(DataFrame.unionByName, met_since), "met")]
            n_frontier = frontier.count()
            found.append(frontier.select(*node, F.lit(hops).alias("hops")))
            if len(found) == COMPACT_ROUNDS:
                found = [scratch.staged(reduce(DataFrame.unionByName, found), "found")]
        return staged(reduce(DataFrame.unionByName, found), "reachable")


def _hubs(links: DataFrame, hub_links: int) -> DataFrame:
    """`(package, path, pieces)` of nodes with more than `hub_links` links.

    Counted by hash first, which moves no names: only nodes of a hash with that many links are counted.
    """
    at = F.pmod(F.xxhash64("package", "path"), F.lit(HUB_HASHES)).alias("at")
    many = F.count(F.lit(1)).alias("n")
    full = [row["at"] for row in links.groupBy(at).agg(many).filter(F.col("n") > hub_links).select("at").limit(MOST_FULL + 1).collect()]
    counted = links if len(full) > MOST_FULL else links.filter(at.isin(full))
    hubs = counted.groupBy("package", "path").agg(many).filter(F.col("n") > hub_links)
    return hubs.select("package", "path", F.ceil(F.col("n") / hub_links).cast("int").alias("pieces"))


def orphan_parts(parts: DataFrame, reached: DataFrame) -> DataFrame:
    """Parts that no way leads to. Directories, relationship parts and the content types part are none."""
    path = F.lower("path")
    about_package = path.endswith(".rels") | path.endswith("/" + CONTENT_TYPES)
    return parts.filter((F.col("kind") != "Directory") & ~about_package).join(reached, ["package", "path"], "left_anti")
