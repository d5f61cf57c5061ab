"""From archive entries to the package index: parts, content types, relationships, diagnostics.

No operator here carries part bytes through a shuffle; XML is read as tokens (`shred_xml`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions import paths as P
from packlake.functions.text import ascii_lower, equals_ascii_ci
from packlake.functions.xml import is_element, xml_attr
from packlake.limits import DEFAULT, Limits, bound
from packlake.operators.shred import shred_xml, xml_errors
from packlake.session import staged

Stage = Callable[[DataFrame, str], DataFrame]

TRAVERSAL_MESSAGE = "traversal-like archive name was normalized"
SOURCE_MESSAGE = "could not determine relationship source"
CONTENT_TYPES = "[content_types].xml"

METADATA_NAMES = ["Default", "Override", "Relationship"]
META = ["package", "ord", "archive_name", "is_dir", "size", "compressed_size", "copy"]


def _without_bytes(entries: DataFrame) -> DataFrame:
    return entries.select(*[c for c in META if c in entries.columns])


# Archive limits -----------------------------------------------------------------------------


def archive_limits(entries: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Packages over the entry or declared-size limit, with the reason.

    All entries count, also those ignored later. Sizes are clipped just above the limit, so
    the sum cannot overflow and the comparison stays exact.
    """
    clipped = F.least(F.col("size"), F.lit(bound(limits.total_bytes) + 1))
    totals = entries.groupBy("package").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(clipped).alias("declared")
    )
    message = F.when(
        F.col("n_entries") > bound(limits.entry_count),
        F.concat(
            F.lit("archive has "),
            F.col("n_entries").cast("string"),
            F.lit(f" entries; limit is {limits.entry_count}"),
        ),
    ).when(
        F.col("declared") > bound(limits.total_bytes),
        f"declared uncompressed size exceeds {limits.total_bytes} bytes",
    )
    return (
        totals.withColumn("message", message)
        .filter(F.col("message").isNotNull())
        .select("package", "n_entries", "message")
    )


def accept_packages(entries: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Entries of the packages within the limits."""
    return entries.join(archive_limits(entries, limits).select("package"), "package", "left_anti")


# Names --------------------------------------------------------------------------------------


def named_entries(entries: DataFrame) -> DataFrame:
    """Adds `path` (normalised, leading slash) and `unsafe`; entries that normalise to
    nothing keep `path = '/'` here."""
    return (
        entries.filter(F.col("ord") >= 0)
        .withColumn("path", F.concat(F.lit("/"), P.normalize_path("archive_name")))
        .withColumn("unsafe", P.unsafe_name("archive_name"))
    )


def depth_guard(named: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Drops empty names and paths with too many components."""
    return named.filter(_has_path() & ~_too_deep(limits))


def _has_path() -> Column:
    return F.col("path") != "/"


def _too_deep(limits: Limits) -> Column:
    # `path` has one leading slash, so its slash count is its component count.
    return P.path_depth("path") - 1 > bound(limits.path_depth)


def collisions(named: DataFrame) -> DataFrame:
    """All but the first entry, in archive order, of each `(package, path)`.

    Entries of `explode_packages` know this (`copy`). For other tables, counts are
    pre-aggregated per task, and a path that very many entries share is split by the adaptive
    skew join when its entries are looked up.
    """
    if "copy" in named.columns:
        return named.filter("copy > 0")
    first = named.groupBy("package", "path").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("copies")
    )
    repeated = first.filter("copies > 1").drop("copies")
    return (
        named.join(repeated, ["package", "path"])
        .filter(F.col("ord") > F.col("first_ord"))
        .drop("first_ord")
    )


def first_entries(named: DataFrame) -> DataFrame:
    """Per `(package, path)` the first entry in archive order.

    For entries without `copy`, the rank filter is applied before the shuffle too: a path
    repeated without end costs one row per task.
    """
    if "copy" in named.columns:
        return named.filter("copy = 0")
    w = Window.partitionBy("package", "path").orderBy("ord")
    return named.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def named_parts(first: DataFrame) -> DataFrame:
    """First entries to parts without content types, kind by name."""
    return first.select(
        "package",
        "ord",
        "path",
        "archive_name",
        "size",
        "compressed_size",
        P.classify_kind("archive_name", "is_dir").alias("kind"),
    )


def dedupe_first_wins(entries: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Entries to parts without content types: names, guards, first entry wins, kind by name."""
    return named_parts(first_entries(depth_guard(named_entries(_without_bytes(entries)), limits)))


def part_contents(entries: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Entries with bytes as read parts `(package, ord, path, archive_name, is_dir, size,
    content, read_error)`. Row-local: bytes are not shuffled."""
    return first_entries(depth_guard(named_entries(entries), limits)).select(
        "package", "ord", "path", "archive_name", "is_dir", "size", "content", "read_error"
    )


def _within_metadata_limit(contents: DataFrame, limits: Limits) -> DataFrame:
    """Metadata parts have a lower read limit, whatever the entries were read with."""
    cap = bound(limits.metadata_bytes)
    declared = F.when(
        F.col("size") > cap,
        F.concat(
            F.lit("entry declares "), F.col("size").cast("string"), F.lit(f" bytes; limit is {cap}")
        ),
    )
    actual = F.when(F.octet_length("content") > cap, f"entry exceeds {cap} byte read limit")
    error = F.coalesce(declared, "read_error", actual)
    return contents.withColumn("read_error", error).withColumn(
        "content", F.when(F.col("read_error").isNull(), F.col("content"))
    )


# Content types ------------------------------------------------------------------------------


def _is_content_types() -> Column:
    """The name is matched without case."""
    return equals_ascii_ci("path", "/" + CONTENT_TYPES)


def last_readable(contents: DataFrame) -> DataFrame:
    """Per package the last candidate that could be read."""
    return (
        contents.filter(F.col("read_error").isNull())
        .groupBy("package")
        .agg(F.max_by("path", "ord").alias("path"))
    )


def type_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=["Default", "Override"], with_text=False)


def parse_content_types(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of the content-types parts to `(defaults, overrides)`; the last duplicate wins.

    A malformed part has an Error token only, hence no rows.
    """
    declared = F.col("content_type").isNotNull()
    defaults = (
        events.filter(is_element("Default", "Start", "Empty"))
        .select(
            "package",
            "seq",
            ascii_lower(xml_attr("attrs", "Extension")).alias("extension"),
            xml_attr("attrs", "ContentType").alias("content_type"),
        )
        .filter(declared & F.col("extension").isNotNull())
        .groupBy("package", "extension")
        .agg(F.max_by("content_type", "seq").alias("content_type"))
    )
    part_name = xml_attr("attrs", "PartName")
    overrides = (
        events.filter(is_element("Override", "Start", "Empty"))
        .select(
            "package",
            "seq",
            F.concat(F.lit("/"), P.normalize_path(part_name)).alias("path"),
            xml_attr("attrs", "ContentType").alias("content_type"),
        )
        .filter(declared & F.col("path").isNotNull())
        .groupBy("package", "path")
        .agg(F.max_by("content_type", "seq").alias("content_type"))
    )
    return defaults, overrides


def resolve_content_type(
    parts: DataFrame, defaults: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Adds `content_type`: the override of the path, else the default of the extension."""
    return (
        parts.withColumn("_extension", P.default_extension("path"))
        .join(
            overrides.select("package", "path", F.col("content_type").alias("_override")),
            ["package", "path"],
            "left",
        )
        .join(
            defaults.select(
                "package",
                F.col("extension").alias("_extension"),
                F.col("content_type").alias("_default"),
            ),
            ["package", "_extension"],
            "left",
        )
        .withColumn("content_type", F.coalesce("_override", "_default"))
        .drop("_extension", "_override", "_default")
    )


def refine_kind(parts: DataFrame) -> DataFrame:
    return parts.withColumn("kind", P.refine_kind("kind", "content_type"))


# Relationships ------------------------------------------------------------------------------


def _is_relationships() -> Column:
    return ascii_lower("archive_name").endswith(".rels") & ~_is_content_types()


def _described_part() -> Column:
    return P.relationship_source(F.substring("path", 2, 2**31 - 1))


def relationship_parts(parts: DataFrame) -> DataFrame:
    """Parts whose archive name ends in `.rels` (any case), with the part they describe."""
    return parts.filter(_is_relationships()).select(
        "package", "ord", "path", _described_part().alias("source")
    )


def relationship_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=["Relationship"], with_text=False)


def relationship_rows(events: DataFrame) -> DataFrame:
    """One row per Relationship element, with the first required attribute it lacks."""
    rows = events.filter(is_element("Relationship", "Start", "Empty")).select(
        "package",
        "path",
        "seq",
        xml_attr("attrs", "Id").alias("id"),
        xml_attr("attrs", "Type").alias("relationship_type"),
        xml_attr("attrs", "Target").alias("target"),
        F.coalesce(
            equals_ascii_ci(xml_attr("attrs", "TargetMode"), "External"), F.lit(False)
        ).alias("external"),
    )
    lacking = F.lit(None).cast("string")
    for name, attribute in [("target", "Target"), ("relationship_type", "Type"), ("id", "Id")]:
        absent = F.coalesce(F.col(name), F.lit("")) == ""
        lacking = F.when(absent, attribute).otherwise(lacking)
    return rows.withColumn("lacking", lacking)


def relationship_part_errors(events: DataFrame) -> DataFrame:
    """Relationships parts rejected as a whole: malformed, or an element lacks an attribute."""
    malformed = xml_errors(events)
    incomplete = (
        relationship_rows(events)
        .filter(F.col("lacking").isNotNull())
        .groupBy("package", "path")
        .agg(F.min_by("lacking", "seq").alias("lacking"))
        .select(
            "package",
            "path",
            F.concat(
                F.lit("Relationship is missing required "), F.col("lacking"), F.lit(" attribute")
            ).alias("message"),
        )
    )
    return malformed.unionByName(incomplete)


def parse_relationships(events: DataFrame, rels_parts: DataFrame) -> DataFrame:
    """Tokens of relationships parts to relationships.

    `rel_ord` orders the relationships of one package: archive order, then document order.
    """
    rejected = relationship_part_errors(events).select("package", "path")
    sources = rels_parts.filter(F.col("source").isNotNull())
    return (
        relationship_rows(events)
        .join(rejected, ["package", "path"], "left_anti")
        .join(sources, ["package", "path"])
        .select(
            "package",
            "source",
            (F.col("ord").cast("bigint") * F.lit(1 << 31) + F.col("seq")).alias("rel_ord"),
            "id",
            "relationship_type",
            "target",
            F.when(~F.col("external"), P.resolve_target("source", "target")).alias(
                "resolved_target"
            ),
            F.when(F.col("external"), "External").otherwise("Internal").alias("target_mode"),
        )
    )


def outgoing(rels: DataFrame) -> DataFrame:
    """Number of relationships by source part."""
    return rels.groupBy("package", F.col("source").alias("path")).agg(
        F.count(F.lit(1)).alias("n_out")
    )


def incoming(rels: DataFrame) -> DataFrame:
    """Number of relationships by resolved target; external ones have none."""
    return (
        rels.filter(F.col("target_mode") == "Internal")
        .groupBy("package", F.col("resolved_target").alias("path"))
        .agg(F.count(F.lit(1)).alias("n_in"))
    )


def degrees(rels: DataFrame) -> DataFrame:
    """Outgoing and incoming counts in one shuffle; both are pre-aggregated per task, so a
    part that a third of all relationships point to stays one row per task."""
    ends = F.array(
        F.struct(F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("resolved_target").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return (
        rels.select("package", F.inline(ends))
        .filter(F.col("path").isNotNull())
        .groupBy("package", "path")
        .agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    )


# Directories --------------------------------------------------------------------------------


def directories(parts: DataFrame) -> DataFrame:
    """All directories of a package, explicit entries and implied ancestors."""
    explicit = F.when(F.col("kind") == "Directory", F.array("path")).otherwise(
        F.array().cast("array<string>")
    )
    above = P.ancestors("path")
    implied = F.slice(above, F.lit(1), F.size(above) - 1)
    return parts.select(
        "package", F.explode(F.concat(implied, explicit)).alias("path")
    ).distinct()


def is_directory(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds `is_directory` to `(package, path)` requests."""
    known = directories(parts).withColumn("_dir", F.lit(True))
    return (
        requests.join(known, ["package", "path"], "left")
        .withColumn("is_directory", F.coalesce("_dir", F.lit(False)))
        .drop("_dir")
    )


# Diagnostics --------------------------------------------------------------------------------


def diagnostic(rows: DataFrame, severity: str, stage: str, part: Column, message: Column) -> DataFrame:
    return rows.select(
        "package",
        F.lit(severity).alias("severity"),
        F.lit(stage).alias("stage"),
        part.cast("string").alias("part"),
        message.alias("message"),
    )


def name_diagnostics(entries: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """What the names alone tell: traversal, depth, collision."""
    named = named_entries(_without_bytes(entries))
    name = F.col("archive_name")
    unsafe = diagnostic(
        named.filter("unsafe"), "Warning", "index", name, F.lit(TRAVERSAL_MESSAGE)
    )
    deep = diagnostic(
        named.filter(_has_path() & _too_deep(limits)),
        "Warning",
        "index",
        name,
        F.lit(
            f"archive path exceeds maximum depth of {limits.path_depth}; entry ignored"
        ),
    )
    collision = diagnostic(
        collisions(depth_guard(named, limits)),
        "Error",
        "index",
        F.col("path"),
        F.concat(F.lit("archive path collides with '"), name, F.lit("'; entry ignored")),
    )
    return unsafe.unionByName(deep).unionByName(collision)


def warnings(diagnostics: DataFrame) -> DataFrame:
    """Adds the one-line form `stage: message`."""
    return diagnostics.withColumn(
        "warning", F.concat(F.col("stage"), F.lit(": "), F.col("message"))
    )


# The whole index ----------------------------------------------------------------------------


def build_index(
    entries: DataFrame, limits: Limits = DEFAULT, stage: Stage = staged
) -> dict[str, DataFrame]:
    """Entries of `explode_packages` to the tables of the index.

    `entries` is used several times, so it should be a written table. `stage` keeps the tokens
    of the metadata parts, which the tables share, so that they are made once.
    """
    opened = entries.filter(F.col("ord") >= 0)
    untyped = dedupe_first_wins(opened, limits)

    # Only rows with a metadata name are looked at for bytes.
    lowered = ascii_lower("archive_name")
    named_so = opened.filter(lowered.endswith(".rels") | lowered.contains(CONTENT_TYPES))
    metadata = _within_metadata_limit(part_contents(named_so, limits), limits)
    type_contents = metadata.filter(_is_content_types())
    rels_contents = metadata.filter(_is_relationships()).withColumn("source", _described_part())
    # One pass over the bytes of both.
    described = metadata.filter(_is_content_types() | _is_relationships())
    events = stage(shred_xml(described, names=METADATA_NAMES, with_text=False), "metadata-tokens")
    type_events = stage(
        events.filter(_is_content_types()).join(
            last_readable(type_contents), ["package", "path"], "left_semi"
        ),
        "type-tokens",
    )
    rels_events = events.filter(~_is_content_types())

    defaults, overrides = parse_content_types(type_events)
    parts = refine_kind(resolve_content_type(untyped, defaults, overrides))
    rels_at = relationship_parts(untyped)
    relationships = parse_relationships(rels_events, rels_at)

    unreadable = F.col("read_error").isNotNull()
    path = F.col("path")
    message = F.col("message")
    found = [
        diagnostic(
            entries.filter(F.col("ord") < 0), "Error", "index", F.lit(None), F.col("read_error")
        ),
        name_diagnostics(opened, limits),
        diagnostic(
            type_contents.filter(unreadable), "Error", "content-types", path, F.col("read_error")
        ),
        diagnostic(
            type_events.filter(F.col("event") == "Error"),
            "Error",
            "content-types",
            F.lit("/[Content_Types].xml"),
            F.col("text"),
        ),
        diagnostic(
            rels_contents.filter(unreadable), "Error", "relationships", path, F.col("read_error")
        ),
        diagnostic(
            rels_contents.filter(~unreadable & F.col("source").isNull()),
            "Warning",
            "relationships",
            path,
            F.lit(SOURCE_MESSAGE),
        ),
        diagnostic(
            relationship_part_errors(rels_events).join(
                rels_at.filter(F.col("source").isNotNull()).select("package", "path"),
                ["package", "path"],
                "left_semi",
            ),
            "Error",
            "relationships",
            path,
            message,
        ),
    ]
    diagnostics = found[0]
    for more in found[1:]:
        diagnostics = diagnostics.unionByName(more)
    return {
        "parts": parts.select(
            "package",
            "ord",
            "path",
            "archive_name",
            "content_type",
            "size",
            "compressed_size",
            "kind",
        ),
        "type_defaults": defaults,
        "type_overrides": overrides,
        "relationships": relationships,
        "diagnostics": warnings(diagnostics),
    }
