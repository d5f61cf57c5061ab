"""Part details and relationship questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions.paths import ancestors, kind_label, type_label
from packlake.functions.text import col, compact_text
from packlake.operators.tree import tree_nodes

# Fixed values.
LABEL_CHARS = 48
WARNING_CHARS = 56


def target_label(
    target: Column | str, resolved_target: Column | str, target_mode: Column | str
) -> Column:
    target = col(target)
    return F.when(
        col(target_mode) == "External", F.concat(target, F.lit(" (external)"))
    ).otherwise(F.coalesce(col(resolved_target), target))


def node_degrees(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """`(package, path, n_out, n_in)` of every part and implied directory, in one exchange."""

    def mark(path: Column, node: int, out: int, in_: int) -> Column:
        return F.struct(path.alias("path"), F.lit(node).alias("node"), F.lit(out).alias("o"), F.lit(in_).alias("i"))

    nodes = parts.select("package", F.inline(F.transform(ancestors("path"), lambda p: mark(p, 1, 0, 0))))
    ends = F.array(mark(F.col("source"), 0, 1, 0), mark(F.col("resolved_target"), 0, 0, 1))
    ended = rels.select("package", F.inline(ends)).filter(F.col("path").isNotNull())
    return (
        nodes.unionByName(ended)
        .groupBy("package", "path")
        .agg(F.max("node").alias("node"), F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
        .filter("node = 1")
        .drop("node")
    )


def part_details(
    parts: DataFrame, rels: DataFrame, diagnostics: DataFrame | None = None
) -> DataFrame:
    """One row per part and per implied directory: labels, sizes, degrees, warnings.

    Nodes and both ends of relationships are counted in one aggregate, merged per task before its exchange;
    the facts of parts are joined to that. The warning count belongs to the package, once per package.
    """
    known = parts.select(
        "package", "path", "archive_name", "content_type", "size", "compressed_size", "kind"
    )
    out = node_degrees(parts, rels).join(known, ["package", "path"], "left")
    display = F.regexp_replace("path", r"\A/+", "")
    is_part = F.col("kind").isNotNull()
    n_warnings = F.lit(0).cast("bigint")
    if diagnostics is not None:
        per_package = diagnostics.groupBy("package").agg(F.count(F.lit(1)).alias("_warnings"))
        out = out.join(per_package, "package", "left")
        n_warnings = F.coalesce("_warnings", F.lit(0))
    return out.select(
        "package",
        "path",
        display.alias("display_name"),
        F.when(F.col("archive_name") != display, F.col("archive_name")).alias("archive_name"),
        F.when(is_part, kind_label("kind")).otherwise("Directory").alias("kind_label"),
        F.when(is_part, F.coalesce("content_type", F.lit("Unknown")))
        .otherwise("N/A")
        .alias("content_type"),
        "size",
        "compressed_size",
        "n_out",
        "n_in",
        n_warnings.alias("n_warnings"),
    )


def relationship_lines(rels: DataFrame) -> DataFrame:
    """Both directions as text lines, with the character span of the link if there is one."""
    kind = type_label("relationship_type")
    out_label = compact_text(target_label("target", "resolved_target", "target_mode"), LABEL_CHARS)
    in_label = compact_text("source", LABEL_CHARS)
    start = F.char_length("id") + 4

    def side(direction: str, node: str, label: Column, link: str) -> Column:
        linked = F.col(link).isNotNull()
        text = F.concat(
            F.lit("  "), F.col("id"), F.lit("  "), label, F.lit(" ("), kind, F.lit(")")
        )
        return F.struct(
            F.lit(direction).alias("direction"),
            F.col(node).alias("node"),
            text.alias("line"),
            F.when(linked, start).alias("link_start"),
            F.when(linked, start + F.char_length(label)).alias("link_end"),
            F.col(link).alias("link_target"),
        )

    sides = F.array(
        side("outgoing", "source", out_label, "resolved_target"),
        side("incoming", "resolved_target", in_label, "source"),
    )
    return rels.select("package", "rel_ord", F.inline(sides)).filter(F.col("node").isNotNull())


def details_lines(
    parts: DataFrame, rels: DataFrame, diagnostics: DataFrame | None = None
) -> DataFrame:
    """The details of each node as text lines, with link spans.

    Lines are ordered by `(section, ord)` within a node rather than numbered: a node that very
    many relationships point to is never brought together in one task.
    """
    facts = part_details(parts, rels, diagnostics)

    def text(section: int, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), line.alias("line"))

    def said(label: str, c: str) -> Column:
        return F.concat(F.lit(label), F.col(c).cast("string"))

    size = F.concat(
        said("Size: ", "size"), said(" bytes (", "compressed_size"), F.lit(" compressed)")
    )
    degree = F.concat(
        said("Relationships: ", "n_out"), said(" outgoing, ", "n_in"), F.lit(" incoming")
    )
    lines = F.array(
        text(0, said("Part: ", "display_name")),
        text(1, said("Archive: ", "archive_name")),
        text(2, said("Kind: ", "kind_label")),
        text(3, said("Content type: ", "content_type")),
        text(4, size),
        text(5, F.lit("")),
        text(6, degree),
        text(7, F.when(F.col("n_out") > 0, "")),
        text(8, F.when(F.col("n_out") > 0, "Outgoing")),
        text(10, F.when(F.col("n_in") > 0, "")),
        text(11, F.when(F.col("n_in") > 0, "Incoming")),
    )
    none = F.lit(None)
    head = facts.select("package", "path", F.inline(lines)).filter("line is not null").select(
        "package",
        "path",
        "section",
        F.lit(0).cast("bigint").alias("ord"),
        "line",
        none.cast("int").alias("link_start"),
        none.cast("int").alias("link_end"),
        none.cast("string").alias("link_target"),
    )
    nodes = tree_nodes(parts).select("package", F.col("node").alias("path"))
    body = relationship_lines(rels).select(
        "package",
        F.col("node").alias("path"),
        F.when(F.col("direction") == "outgoing", 9).otherwise(12).alias("section"),
        F.col("rel_ord").cast("bigint").alias("ord"),
        "line",
        "link_start",
        "link_end",
        "link_target",
    )
    return head.unionByName(body.join(nodes, ["package", "path"], "left_semi"))


def package_warnings(diagnostics: DataFrame) -> DataFrame:
    """The warnings every node of a package shows, as text lines."""
    warning = F.concat(F.col("stage"), F.lit(": "), F.col("message"))
    return diagnostics.select(
        "package", F.concat(F.lit("- "), compact_text(warning, WARNING_CHARS)).alias("line")
    )


def dangling_relationships(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationships whose target is neither a part nor an implied directory.

    One pass over each side: nodes are unique by path, and a target that very many relationships
    share is split by the adaptive skew join.
    """
    nodes = tree_nodes(parts).select("package", F.col("node").alias("resolved_target"))
    # External targets alone are unresolved; asking for their mode keeps the path fold out of the filter.
    linked = rels.filter(F.col("target_mode") == "Internal")
    return linked.join(nodes, ["package", "resolved_target"], "left_anti")


def relationship_targets(rels: DataFrame) -> DataFrame:
    """Per `(package, source, id)` the first relationship that has a resolved target."""
    return (
        rels.filter(F.col("target_mode") == "Internal")
        .groupBy("package", "source", "id")
        .agg(F.min_by("resolved_target", "rel_ord").alias("path"))
    )


def relationship_target_for_id(requests: DataFrame, rels: DataFrame) -> DataFrame:
    """Adds `path` to `(package, source, id)` requests; null if unresolved."""
    return requests.join(relationship_targets(rels), ["package", "source", "id"], "left")


def relationship_count(rels: DataFrame, suffix: str) -> DataFrame:
    """Outgoing relationships whose type ends with `suffix`, external ones included."""
    return (
        rels.filter(F.col("relationship_type").endswith(suffix))
        .groupBy("package", F.col("source").alias("path"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
