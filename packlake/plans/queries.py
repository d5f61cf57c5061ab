"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.functions import media as M
from packlake.functions import paths as P
from packlake.functions import text as T
from packlake.functions.xml import xml_attr
from packlake.limits import Limits
from packlake.operators import details, formulas, graph, inheritance, links, preview, ranges, report, search, summary, tree
from packlake.operators import index as I
from packlake.operators import presentation as S
from packlake.operators import shred as X
from packlake.operators import word as D
from packlake.operators import workbook as W
from packlake.plans import adapters as A
from packlake.plans.adapters import Tables, spread
from packlake.session import configure, shared_dir, staged
from packlake.sources.buckets import BucketedIndex
from packlake.sources.datasource import read_packages, write_packages
from packlake.sources.packages import (
    explode_packages,
    pack_zip,
    part_needles,
    read_part,
    scan_packages,
    search_packages,
)
from packlake.sources.sinks import read_index, write_index
from packlake.streaming.packages import index_stream, stream_packages
from packlake.streaming.requests import current_requests, current_results, latest_wins
from packlake.streaming.versions import VersionedIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(configure(spark), folder))

    QUERIES[build.__name__] = run
    return build


# Sources and sinks --------------------------------------------------------------------------


def _zips(files: DataFrame) -> DataFrame:
    return pack_zip(files)


@query
def scan_packages_query(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "corpus")
    _zips(A.workbook_files(t)).write.parquet(path)
    packages = scan_packages(t.spark, path, max_bytes=1 << 30, fmt="parquet")
    magic = F.hex(F.substring("content", 1, 4))
    return packages.select("package", magic.alias("magic"), (F.col("length") > 0).alias("filled"))


@query
def explode_packages_query(t: Tables) -> DataFrame:
    entries = explode_packages(_zips(A.word_files(t)))
    return entries.select("package", "ord", "archive_name", "is_dir", "size", "read_error")


@query
def package_source(t: Tables) -> DataFrame:
    """The same entries, from files that are read by ranges."""
    path = shared_dir(t.spark, "files")
    write_packages(_zips(A.word_files(t)), path, ending=".docx")
    entries = read_packages(t.spark, path, content="none")
    package = F.regexp_replace("package", "[.]docx$", "").alias("package")
    return entries.select(package, "ord", "archive_name", "is_dir", "size", "read_error")


@query
def package_source_parts(t: Tables) -> DataFrame:
    """One part of each file: the filter is the reader's, which reads the bytes of that entry alone."""
    path = shared_dir(t.spark, "files")
    write_packages(_zips(A.word_files(t)), path, ending=".docx")
    entries = read_packages(t.spark, path, content="all").filter(F.col("archive_name") == "word/document.xml")
    package = F.regexp_replace("package", "[.]docx$", "").alias("package")
    return entries.select(package, F.md5("content").alias("digest"), F.octet_length("content").alias("size"))


@query
def read_part_query(t: Tables) -> DataFrame:
    packages = _zips(A.word_files(t))
    parts = I.dedupe_first_wins(explode_packages(packages))
    requests = packages.select(
        "package", F.explode(F.array(F.lit("/word/document.xml"), F.lit("/lost.xml"))).alias("path")
    )
    found = read_part(packages, parts, requests)
    return found.select(
        "package",
        "path",
        F.md5("content").alias("digest"),
        F.octet_length("content").alias("size"),
        "read_error",
    )


@query
def bounded_read(t: Tables) -> DataFrame:
    entries = explode_packages(_zips(A.word_files(t)), with_content=True, limit=2000)
    return entries.select(
        "package", "archive_name", "size", F.octet_length("content").alias("got"), "read_error"
    )


@query
def write_index_query(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "index")
    parts = A.page_parts(t)
    typed = I.resolve_content_type(
        I.dedupe_first_wins(I.accept_packages(A.page_entries(t))), *A.page_type_tables(t)
    )
    values = {
        "parts": (parts, "kind"),
        "directories": (I.directories(parts), "CAST(NULL AS string)"),
        "types": (typed.select("package", "path", "content_type"), "content_type"),
        "relationships": (_page_relationships(t).withColumn("path", F.col("source")), "id"),
        "diagnostics": (diagnostics(t).withColumn("path", F.col("part")), "message"),
    }
    write_index({name: df for name, (df, _) in values.items()}, path, buckets=8)
    read = [
        read_index(t.spark, path, name).selectExpr(
            f"'{name}' AS name", "package", "path AS item", f"{value} AS value"
        )
        for name, (_, value) in values.items()
    ]
    found = read[0]
    for more in read[1:]:
        found = found.unionByName(more)
    return found


@query
def stream_packages_query(t: Tables) -> DataFrame:
    source, out = shared_dir(t.spark, "arrivals"), shared_dir(t.spark, "indexed")
    _zips(A.workbook_files(t)).write.parquet(source)
    stream = stream_packages(t.spark, source, fmt="parquet", max_files=4)
    index_stream(stream, out, shared_dir(t.spark, "progress")).awaitTermination()
    parts = t.spark.read.parquet(f"{out}/parts")
    return parts.select("package", "path", "content_type", "kind")


@query
def incremental_index(t: Tables) -> DataFrame:
    source, out = shared_dir(t.spark, "arrivals"), shared_dir(t.spark, "indexed")
    _zips(A.workbook_files(t)).write.parquet(source)
    stream = stream_packages(t.spark, source, fmt="parquet")
    index_stream(stream, out, shared_dir(t.spark, "progress")).awaitTermination()
    rels = t.spark.read.parquet(f"{out}/relationships")
    return rels.select("package", "source", "id", "resolved_target", "target_mode")


# Index --------------------------------------------------------------------------------------


@query
def normalize_path(t: Tables) -> DataFrame:
    return A.page_entries(t).select(
        "package", "ord", "archive_name", P.normalize_path("archive_name").alias("path")
    )


@query
def unsafe_name(t: Tables) -> DataFrame:
    return A.page_entries(t).select(
        "package", "ord", "archive_name", P.unsafe_name("archive_name").alias("unsafe")
    )


@query
def depth_guard(t: Tables) -> DataFrame:
    return I.depth_guard(I.named_entries(A.page_entries(t))).select("package", "ord", "path")


@query
def archive_limits(t: Tables) -> DataFrame:
    return I.archive_limits(A.order_entries(t), Limits(entry_count=6, total_bytes=150_000))


@query
def dedupe_first_wins(t: Tables) -> DataFrame:
    return I.dedupe_first_wins(I.accept_packages(A.page_entries(t)))


@query
def classify_kind(t: Tables) -> DataFrame:
    return A.page_entries(t).select(
        "package", "ord", "archive_name", P.classify_kind("archive_name", "is_dir").alias("kind")
    )


@query
def parse_content_types(t: Tables) -> DataFrame:
    defaults, overrides = I.parse_content_types(I.type_tokens(A.page_content_types(t)))
    return (
        defaults.withColumnRenamed("extension", "name")
        .withColumn("rule", F.lit("default"))
        .unionByName(
            overrides.withColumnRenamed("path", "name").withColumn("rule", F.lit("override"))
        )
    )


@query
def resolve_content_type(t: Tables) -> DataFrame:
    parts = I.dedupe_first_wins(I.accept_packages(A.page_entries(t)))
    return I.resolve_content_type(parts, *A.page_type_tables(t)).select(
        "package", "path", "content_type"
    )


@query
def refine_kind(t: Tables) -> DataFrame:
    return A.page_parts(t).select("package", "path", "content_type", "kind")


@query
def is_xml_content_type(t: Tables) -> DataFrame:
    return A.page_parts(t).select(
        "package", "path", P.is_xml_content_type("content_type").alias("is_xml")
    )


@query
def relationship_source(t: Tables) -> DataFrame:
    return A.page_rels(t).select(
        "package",
        "path",
        P.relationship_source(F.substring("path", 2, 2**31 - 1)).alias("source"),
    )


def _page_relationships(t: Tables) -> DataFrame:
    parts = A.page_rels(t)
    return I.parse_relationships(I.relationship_tokens(parts), I.relationship_parts(parts))


@query
def parse_relationships(t: Tables) -> DataFrame:
    return _page_relationships(t).select(
        "package", "source", "id", "relationship_type", "target", "target_mode"
    )


@query
def resolve_target(t: Tables) -> DataFrame:
    return _page_relationships(t).select("package", "source", "target", "resolved_target")


@query
def resolve_target_keys(t: Tables) -> DataFrame:
    return A.graph_relationships(t).select("source", "id", "target", "resolved_target")


@query
def outgoing(t: Tables) -> DataFrame:
    return I.outgoing(A.graph_relationships(t))


@query
def incoming(t: Tables) -> DataFrame:
    return I.incoming(A.graph_relationships(t))


@query
def diagnostics(t: Tables) -> DataFrame:
    usable = I.accept_packages(A.page_entries(t))
    return I.warnings(I.name_diagnostics(usable))


@query
def relationship_diagnostics(t: Tables) -> DataFrame:
    errors = I.relationship_part_errors(I.relationship_tokens(A.page_rels(t)))
    lacking = F.when(F.col("message").contains("missing"), F.col("message")).otherwise("malformed XML")
    return errors.select("package", "path", lacking.alias("message"))


@query
def container_diagnostics(t: Tables) -> DataFrame:
    """Of the whole index: damaged and rejected containers, metadata that cannot be read or parsed."""
    limits = Limits(entry_count=9, metadata_bytes=1000)
    packages = A.damaged_packages(t, _zips(A.faulty_files(t)))
    entries = staged(explode_packages(packages, limits=limits), "entries")
    found = I.build_index(entries, limits)["diagnostics"]
    # Where a parser stopped is its own affair.
    return found.select("package", "severity", "stage", "part", F.regexp_extract("message", "^([^:]*)", 1).alias("message"))


@query
def is_directory(t: Tables) -> DataFrame:
    parts = A.page_parts(t)
    requests = tree.tree_nodes(parts).select("package", F.col("node").alias("path"))
    return I.is_directory(requests, parts)


@query
def xml_attr_query(t: Tables) -> DataFrame:
    events = X.shred_xml(A.page_rels(t), names=["Relationship"], with_text=False)
    return events.filter(F.col("event") == "Empty").select(
        "package",
        xml_attr("attrs", "Id").alias("id"),
        xml_attr("attrs", "r:Target").alias("prefixed"),
        xml_attr("attrs", "Target").alias("target"),
    )


# Tree and search ----------------------------------------------------------------------------


@query
def tree_nodes(t: Tables) -> DataFrame:
    return tree.tree_nodes(A.page_parts(t))


@query
def ancestors(t: Tables) -> DataFrame:
    parts = A.page_parts(t)
    return parts.select("package", "path", F.posexplode(P.ancestors("path")).alias("level", "node"))


@query
def branch_nodes(t: Tables) -> DataFrame:
    return tree.branch_nodes(tree.tree_nodes(A.page_parts(t))).select("package", "node")


@query
def filter_tree(t: Tables) -> DataFrame:
    return tree.filter_tree(tree.tree_nodes(A.page_parts(t)), "X/eN")


@query
def filter_tree_matches(t: Tables) -> DataFrame:
    parts = A.page_parts(t)
    nodes = tree.tree_nodes(parts)
    matches = parts.filter(F.col("kind") == "Image").select("package", "path")
    return tree.filter_tree_matches(nodes, matches)


@query
def search_paths(t: Tables) -> DataFrame:
    return search.search_paths(A.page_parts(t), "MeDia/1")


NEEDLES = ["the ", "queue", "\nE", "Ch", "ü"]


@query
def search_content(t: Tables) -> DataFrame:
    return search.search_content(A.document_parts(t), NEEDLES)


@query
def search_packages_query(t: Tables) -> DataFrame:
    return search_packages(_zips(A.word_files(t)), NEEDLES)


@query
def search_many_needles(t: Tables) -> DataFrame:
    """All words of the benchmark's items, in one pass over the packages."""
    words = t.benchmark.select(F.explode(F.split(F.concat_ws(" ", *_texts(t.benchmark)), " ")).alias("w")).filter("w <> ''")
    needles = [row[0] for row in words.distinct().orderBy("w").collect()]
    hits = part_needles(_zips(A.word_files(t)), needles).filter(F.col("path") == "/word/document.xml")
    digest = F.md5(F.concat_ws(" ", F.array_sort("needles"))).alias("digest")
    return hits.select("package", "path", F.size("needles").cast("bigint").alias("n_needles"), digest)


def _texts(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


# Details ------------------------------------------------------------------------------------


@query
def part_details(t: Tables) -> DataFrame:
    return details.part_details(
        A.graph_parts(t), A.graph_relationships(t), A.graph_diagnostics(t)
    )


@query
def details_lines(t: Tables) -> DataFrame:
    return details.details_lines(
        A.graph_parts(t), A.graph_relationships(t), A.graph_diagnostics(t)
    ).select("path", "section", "ord", "line", "link_start", "link_end", "link_target")


@query
def package_warnings(t: Tables) -> DataFrame:
    return details.package_warnings(I.name_diagnostics(I.accept_packages(A.page_entries(t))))


@query
def relationship_lines(t: Tables) -> DataFrame:
    return details.relationship_lines(A.graph_relationships(t))


@query
def target_label(t: Tables) -> DataFrame:
    label = details.target_label("target", "resolved_target", "target_mode")
    return A.graph_relationships(t).select("source", "id", label.alias("label"))


@query
def type_label(t: Tables) -> DataFrame:
    return _page_relationships(t).select(
        "package", "id", P.type_label("relationship_type").alias("label")
    )


@query
def compact_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.compact_text("text", 48).alias("label"))


@query
def dangling_relationships(t: Tables) -> DataFrame:
    lost = details.dangling_relationships(A.graph_relationships(t), A.graph_parts(t))
    return lost.select("source", "id", "resolved_target")


@query
def dangling_slide_links(t: Tables) -> DataFrame:
    rels = A.file_relationships(A.deck_files(t))
    parts = A.file_parts(A.deck_files(t))
    rejoined = details.dangling_relationships(rels, parts)
    return rejoined.select("package", "source", "id", "resolved_target")


@query
def relationship_target_for_id(t: Tables) -> DataFrame:
    requests = (
        t.lineitem.selectExpr(
            "'sales' AS package",
            "concat('/orders/', l_orderkey) AS source",
            "concat('p', l_linenumber) AS id",
        )
    ).distinct()
    return details.relationship_target_for_id(requests, A.graph_relationships(t))


@query
def relationship_count(t: Tables) -> DataFrame:
    return details.relationship_count(A.graph_relationships(t), "/image")


def _reached(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The parts of the key graph, and those that orders lead to."""
    parts = staged(A.graph_parts(t), "parts")
    orders = parts.filter(F.col("path").startswith("/orders/")).select("package", "path")
    return parts, graph.reachable_parts(parts, A.graph_relationships(t), orders)


@query
def reachable_parts(t: Tables) -> DataFrame:
    return _reached(t)[1]


@query
def orphan_parts(t: Tables) -> DataFrame:
    return graph.orphan_parts(*_reached(t)).select("package", "path")


@query
def unreached_slide_parts(t: Tables) -> DataFrame:
    """Presentations, from their roots through their relationships."""
    files = A.deck_files(t)
    parts = A.file_parts(files).select("package", "path", F.lit("Xml").alias("kind"))
    reached = graph.reachable_parts(parts, A.file_relationships(files))
    lost = graph.orphan_parts(parts, reached).select("package", "path", F.lit(None).cast("int").alias("hops"))
    return reached.unionByName(lost)


@query
def directory_totals(t: Tables) -> DataFrame:
    return tree.directory_totals(A.page_parts(t))


@query
def selection_status(t: Tables) -> DataFrame:
    parts = A.page_parts(t)
    flagged = I.is_directory(parts.select("package", "path"), parts)
    return flagged.select(
        "package", "path", P.extension_label("path", "is_directory").alias("label")
    )


# Shredding and summaries --------------------------------------------------------------------


@query
def shred_xml(t: Tables) -> DataFrame:
    events = X.shred_xml(A.file_parts(A.workbook_files(t), "sheet1.xml", "sheet2.xml"))
    return events.select("package", "path", "seq", "event", "qname", "depth", F.size("attrs").alias("n_attrs"), "text")


@query
def validate_xml(t: Tables) -> DataFrame:
    return X.validate_xml(A.page_rels(t)).select("package", "valid")


@query
def detect_format(t: Tables) -> DataFrame:
    files = (
        A.file_parts(A.deck_files(t))
        .unionByName(A.file_parts(A.word_files(t)))
        .unionByName(A.file_parts(A.workbook_files(t)))
    )
    return summary.detect_format(files)


@query
def append_text(t: Tables) -> DataFrame:
    return S.all_text(S.text_tokens(A.file_parts(A.word_files(t), "document.xml")))


@query
def clean_text(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", T.clean_text("text").alias("text"))


def _slides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = A.deck_files(t)
    rels = A.file_relationships(files)
    events = X.shred_xml(A.file_parts(files, "presentation.xml"), names=["sldId"], with_text=False)
    return files, rels, S.slide_order(events, rels)


@query
def slide_order(t: Tables) -> DataFrame:
    return _slides(t)[2]


@query
def slide_title(t: Tables) -> DataFrame:
    return S.slide_title(S.title_tokens(_slide_parts(A.deck_files(t))))


def _slide_parts(files: DataFrame) -> DataFrame:
    return A.file_parts(files).filter(F.col("path").rlike("^/ppt/slides/[^/]*$"))


def _note_parts(files: DataFrame) -> DataFrame:
    return A.file_parts(files).filter(F.col("path").startswith("/ppt/notesSlides/"))


@query
def all_text(t: Tables) -> DataFrame:
    return S.all_text(S.text_tokens(_slide_parts(A.deck_files(t))))


@query
def slide_notes(t: Tables) -> DataFrame:
    files, rels, slides = _slides(t)
    return S.slide_notes(slides, rels, S.text_tokens(_note_parts(files)))


@query
def ppt_slides(t: Tables) -> DataFrame:
    files, rels, slides = _slides(t)
    return S.ppt_slides(
        slides,
        rels,
        S.title_tokens(_slide_parts(files)),
        S.text_tokens(_note_parts(files)),
    )


def _summary_inputs(files: DataFrame, reports: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index tables and tokens of packages made from `files`, through the container.

    Two passes over the packages, so that no inflated part is ever written.
    """
    packages = staged(pack_zip(files), "packages")
    index = I.build_index(staged(explode_packages(packages), "entries"))
    parts = staged(index["parts"], "parts")
    rels = staged(index["relationships"], "relationships")
    opened = explode_packages(packages, with_content=True, only_markup=True)
    tokens = staged(summary.summary_tokens(I.part_contents(opened), reports), "tokens")
    return parts, rels, tokens


def _summary_lines(files: DataFrame) -> DataFrame:
    return summary.document_summaries(*_summary_inputs(files))[0]


@query
def ppt_summary(t: Tables) -> DataFrame:
    return _summary_lines(A.deck_files(t))


@query
def summary_diagnostics(t: Tables) -> DataFrame:
    failed = summary.document_summaries(*_summary_inputs(A.deck_files(t), reports=False))[1]
    named = F.regexp_extract("message", r"^(.*?: /[^:]*: malformed XML)", 1)
    return failed.select("package", "severity", "stage", "part", named.alias("message"))


def _word_events(t: Tables) -> DataFrame:
    return D.word_tokens(A.file_parts(A.word_files(t), "document.xml"))


@query
def word_counts(t: Tables) -> DataFrame:
    return D.word_counts(_word_events(t))


@query
def heading_outline(t: Tables) -> DataFrame:
    return D.heading_outline(_word_events(t))


@query
def word_summary(t: Tables) -> DataFrame:
    return _summary_lines(A.word_files(t))


def _sheets(t: Tables) -> DataFrame:
    files = A.workbook_files(t)
    events = X.shred_xml(A.file_parts(files, "workbook.xml"), names=["sheet"], with_text=False)
    return W.workbook_sheets(events, A.file_relationships(files))


@query
def workbook_sheets(t: Tables) -> DataFrame:
    return _sheets(t)


def _strings(t: Tables) -> DataFrame:
    parts = A.file_parts(A.workbook_files(t), "sharedStrings.xml")
    return W.shared_strings(W.string_tokens(parts))


@query
def shared_strings(t: Tables) -> DataFrame:
    return _strings(t)


def _sheet_events(t: Tables) -> DataFrame:
    return W.cell_tokens(A.file_parts(A.workbook_files(t), "sheet1.xml", "sheet2.xml"))


@query
def worksheet_cells(t: Tables) -> DataFrame:
    return W.resolve_shared(W.worksheet_cells(_sheet_events(t)), _strings(t))


@query
def resolve_shared(t: Tables) -> DataFrame:
    return W.resolve_shared(A.order_cells(t), A.part_strings(t))


@query
def sheet_stats(t: Tables) -> DataFrame:
    return W.sheet_stats(W.sheet_tokens(A.file_parts(A.workbook_files(t), "sheet1.xml", "sheet2.xml")))


@query
def cell_sample(t: Tables) -> DataFrame:
    cells = W.worksheet_cells(W.shown_tokens(A.file_parts(A.workbook_files(t), "sheet1.xml", "sheet2.xml")))
    return W.cell_sample(W.resolve_shared(cells, _strings(t)))


@query
def excel_summary(t: Tables) -> DataFrame:
    return _summary_lines(A.workbook_files(t))


# Facts of documents -------------------------------------------------------------------------


def _ledgers(t: Tables, fold: str = "cells") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells (those of the fold), sheets and the other tokens of workbooks with formulas."""
    parts = A.file_parts(A.ledger_files(t), "sheet1.xml", "sheet2.xml", "workbook.xml", ".rels")
    # One pass over the parts: cells, ranges, names, sheets and their relationships.
    events = staged(ranges.range_tokens(parts, more=("sheet", "Relationship"), cells=fold), "tokens")
    # Most tokens are cells, which what follows from the others need not read again and again.
    facts = staged(events.filter("event <> 'Cell'"), "facts")
    rels = I.parse_relationships(facts.filter(F.col("path").endswith(".rels")), I.relationship_parts(parts.drop("content")))
    sheets = staged(W.workbook_sheets(facts, rels), "sheets")
    return staged(W.worksheet_cells(events), "cells"), sheets, facts


@query
def merged_anchors(t: Tables) -> DataFrame:
    cells, _, events = _ledgers(t)
    found = ranges.merged_anchors(cells, ranges.merged_ranges(events))
    return found.select("package", "path", "reference", "ref", "anchor", "is_anchor")


@query
def named_cells(t: Tables) -> DataFrame:
    cells, sheets, events = _ledgers(t)
    found = ranges.named_cells(cells, ranges.defined_names(events), sheets)
    return found.join(cells.select("package", "path", "ord", "reference"), ["package", "path", "ord"]).drop("ord")


def _references(t: Tables) -> tuple[DataFrame, DataFrame]:
    cells, sheets, events = _ledgers(t)
    names = staged(ranges.defined_names(events), "defined")
    return cells, staged(formulas.formula_references(cells, sheets, names), "references")


@query
def formula_references(t: Tables) -> DataFrame:
    cells, found = _references(t)
    where = cells.select("package", "path", "ord", "reference")
    return found.join(where, ["package", "path", "ord"]).drop("ord")


@query
def formula_levels(t: Tables) -> DataFrame:
    cells, sheets, events = _ledgers(t, "formulas")
    names = staged(ranges.defined_names(events), "defined")
    references = formulas.formula_references(cells, sheets, names, distinct=False)
    return formulas.formula_levels(cells, references, keep=("reference",)).drop("ord")


@query
def styled_outline(t: Tables) -> DataFrame:
    events = staged(inheritance.style_tokens(A.file_parts(A.styled_files(t))), "tokens")
    return inheritance.styled_outline(events).drop("ord")


@query
def style_inheritance(t: Tables) -> DataFrame:
    events = inheritance.style_tokens(A.file_parts(A.styled_files(t), "styles.xml"))
    return inheritance.inherited(inheritance.word_styles(events), ["outline"])


@query
def slide_chain(t: Tables) -> DataFrame:
    files = A.themed_files(t)
    return inheritance.slide_chain(A.file_parts(files).drop("content"), A.file_relationships(files))


@query
def document_links(t: Tables) -> DataFrame:
    files = A.linked_files(t)
    # One pass over the parts: links, and relationships.
    events = staged(links.link_tokens(A.file_parts(files, "document.xml", ".rels"), more=("Relationship",)), "tokens")
    found = events.filter(F.col("path").endswith("document.xml"))
    return links.document_links(found, A.file_relationships(files, events=events))


@query
def bounded_lines(t: Tables) -> DataFrame:
    return report.bounded_lines(
        A.document_lines(t), Limits(summary_lines=12, summary_bytes=2000)
    )


# Previews -----------------------------------------------------------------------------------


@query
def preview_kind(t: Tables) -> DataFrame:
    kind = M.preview_kind("archive_name", "content_type", "content")
    return A.document_parts(t).select("package", "path", kind.alias("preview_kind"))


def _by_name_and_type(predicate, name: str) -> None:
    def build(t: Tables) -> DataFrame:
        flag = predicate("archive_name", "content_type")
        return A.document_parts(t).select("path", flag.alias(name))

    build.__name__ = name
    query(build)


for _predicate in (M.is_json, M.is_font, M.is_media, M.is_ole):
    _by_name_and_type(_predicate, _predicate.__name__)
_by_name_and_type(lambda name, _: M.is_bin(name), "is_bin")
_by_name_and_type(lambda name, _: P.path_extension(name), "path_extension")


@query
def utf8_text(t: Tables) -> DataFrame:
    return A.document_parts(t).select("path", T.utf8_text("content").alias("text"))


@query
def is_probably_text(t: Tables) -> DataFrame:
    text = T.utf8_text("content")
    return A.document_parts(t).select("path", T.is_probably_text(text).alias("is_text"))


@query
def hex_dump(t: Tables) -> DataFrame:
    return preview.hex_dump(A.document_parts(t)).select("path", "line", "text")


@query
def json_pretty(t: Tables) -> DataFrame:
    parts = spread(t.events).selectExpr(
        "event_type AS package",
        "concat('/events/', event_id, '.json') AS path",
        "CAST(if(event_id % 5 = 0, concat(props, '}'), concat('{\"z\":[],\"a\":', props, '}')) AS binary) AS content",
    )
    return preview.json_pretty(parts)


@query
def xml_pretty(t: Tables) -> DataFrame:
    parts = spread(t.customer).selectExpr(
        "c_mktsegment AS package",
        "concat('/customer/', c_custkey) AS path",
        "CAST(concat('<c id=\"', c_custkey, '\"><!-- > --><n a=''>''>', c_name, '</n><e /><o><i><b></b></i></o>', "
        "if(c_custkey % 6 = 0, '</x>', '</c >')) AS binary) AS content",
    )
    return preview.xml_pretty(parts).select(
        "package", "path", "text", F.col("error").isNotNull().alias("failed")
    )


@query
def binary_info(t: Tables) -> DataFrame:
    category = M.info_category("archive_name", "content_type")
    info = M.binary_info("archive_name", category, "content_type", "size", "compressed_size")
    return A.document_parts(t).select("path", info.alias("text"))


@query
def fallback_mime(t: Tables) -> DataFrame:
    return A.document_parts(t).select("path", M.fallback_mime("archive_name").alias("mime"))


@query
def image_guard(t: Tables) -> DataFrame:
    return preview.image_guard(A.part_images(t))


@query
def limited_output(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", preview.limited_output(F.col("text"), "formatted preview", 1000).alias("error")
    )


@query
def build_previews(t: Tables) -> DataFrame:
    shown = preview.build_previews(A.document_parts(t))
    return shown.select(
        "package",
        "path",
        "preview_kind",
        F.md5("preview_text").alias("digest"),
        F.col("preview_error").isNotNull().alias("failed"),
    )


@query
def preview_packages(t: Tables) -> DataFrame:
    shown = preview.preview_packages(staged(_zips(A.media_files(t)), "packages"))
    return shown.select(
        "package",
        "path",
        "preview_kind",
        F.md5("preview_text").alias("digest"),
        F.col("preview_error").isNotNull().alias("failed"),
    )


# Requests -----------------------------------------------------------------------------------


@query
def latest_wins_query(t: Tables) -> DataFrame:
    results = t.events.selectExpr("user_id AS key", "event_id AS request_id", "event_type AS path")
    selected = (
        t.events.filter("event_type <> 'error'")
        .groupBy(F.col("user_id").alias("key"))
        .agg(F.max_by("event_type", "event_id").alias("path"))
    )
    return latest_wins(results.select("key", "request_id"), results, selected)


@query
def stream_latest_wins(t: Tables) -> DataFrame:
    """The same current requests from a stream; the sink keeps each batch's changed keys."""
    out = shared_dir(t.spark, "current")
    schema = t.events.schema
    requests = (
        t.spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
        .selectExpr("user_id AS key", "event_id AS request_id", "event_type AS path")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        current_requests(requests)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", shared_dir(t.spark, "progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return current_requests(t.spark.read.parquet(out).drop("batch"))


@query
def stream_current_results(t: Tables) -> DataFrame:
    """Results that count when they arrive, from a stream of requests, selections and results."""
    out = shared_dir(t.spark, "results")
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    kinds = "array('request', 'result', if(event_type <> 'error', 'selection', NULL))"
    changes = events.selectExpr("user_id AS key", f"explode({kinds}) AS kind", "event_id AS request_id", "event_type AS path")
    (
        current_results(changes.filter("kind is not null"))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", shared_dir(t.spark, "progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return t.spark.read.schema("key long, request_id long, path string").parquet(out)


@query
def versioned_index(t: Tables) -> DataFrame:
    """Three versions of the packages of customers; the parts that differ between them."""
    index = VersionedIndex(t.spark, shared_dir(t.spark, "versions"))
    files = A.workbook_files(t)
    key = "CAST(substring(package, 2) AS bigint)"
    extra = "concat(files, array(named_struct('name', 'new.txt', 'content', 'x')))"
    edited = "transform(files, f -> if(f.name = 'xl/sharedStrings.xml', named_struct('name', f.name, 'content', '<sst/>'), f))"
    second = files.filter(f"{key} % 4 <> 3").selectExpr("package", f"if({key} % 4 = 1, {extra}, {edited}) AS files")
    # Made once: a refresh reads its packages twice.
    first, other = staged(pack_zip(files), "packages"), staged(pack_zip(second), "packages")
    index.refresh(first)
    index.refresh(first)  # nothing has changed, so there is no version for it
    index.refresh(other)
    index.refresh(first)
    found = index.changes(1)
    for version in range(2, index.current() + 1):
        found = found.unionByName(index.changes(version))
    return found


@query
def bucketed_dangling(t: Tables) -> DataFrame:
    index = BucketedIndex(t.spark, shared_dir(t.spark, "buckets"), buckets=8)
    index.append(A.graph_parts(t), A.graph_relationships(t))
    return index.dangling().select("source", "id", "resolved_target")


# Operators whose plain name is already taken by an import carry a suffix above.
for _name in [n for n in QUERIES if n.endswith("_query")]:
    QUERIES[_name.removesuffix("_query")] = QUERIES.pop(_name)
