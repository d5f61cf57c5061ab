"""Document summaries of whole packages: which parts they read, what makes them fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.limits import DEFAULT, Limits
from packlake.operators import presentation as S
from packlake.operators import word as D
from packlake.operators import workbook as X
from packlake.operators.index import Stage, diagnostic
from packlake.operators.report import bounded_lines
from packlake.operators.shred import part_failures, shred_xml
from packlake.session import staged

# Main part by format, in order of precedence.
MAIN_PARTS = {"ppt": S.PRESENTATION, "word": D.DOCUMENT, "excel": X.WORKBOOK}


SUMMARY_NAMES = ["sldId", "sheet"]
SUMMARY_FOLDS = ("titles", "whole", "paragraphs", "headings", "strings", "shown")
# Read of one part alone; slides, notes and sheets may have any path.
FOLDS_AT = {"paragraphs": D.DOCUMENT, "headings": D.DOCUMENT, "strings": X.SHARED_STRINGS}


def detect_format(parts: DataFrame) -> DataFrame:
    """`(package, format)`; packages without a known main part have a null format."""
    has = {
        name: F.max(F.when(F.col("path") == path, 1)) for name, path in MAIN_PARTS.items()
    }
    form = F.coalesce(*[F.when(h == 1, name) for name, h in has.items()])
    return parts.groupBy("package").agg(form.alias("format"))


def main_parts(parts: DataFrame) -> DataFrame:
    """The main part of each package with a known format: `(package, format, path)`."""
    table = F.lit(None).cast("string")
    for name, path in MAIN_PARTS.items():
        table = F.when(F.col("format") == name, path).otherwise(table)
    return detect_format(parts).filter(F.col("format").isNotNull()).withColumn("path", table)


def summary_failures(needed: DataFrame, parts: DataFrame, events: DataFrame) -> DataFrame:
    """First failure per package: a needed part that is missing, unreadable or malformed.

    `needed` is `(package, path, step)`, `step` being the order in which the parts are read.
    """
    there = parts.select("package", "path", F.lit(True).alias("there"))
    missing = F.when(F.col("there").isNull(), F.concat(F.lit("part not found: "), F.col("path")))
    return (
        needed.join(there, ["package", "path"], "left")
        .join(part_failures(events), ["package", "path"], "left")
        .withColumn("reason", F.coalesce(missing, F.col("message")))
        .filter(F.col("reason").isNotNull())
        .groupBy("package")
        .agg(F.min_by("reason", "step").alias("reason"))
    )


def summary_tokens(contents: DataFrame, reports: bool = True) -> DataFrame:
    """The tokens summaries need, of all parts given, in one pass and without moving bytes.

    `contents` are `part_contents`, best of entries read with `only_markup`. The tokens are read
    by several operators: write or persist them before `document_summaries`. Without `reports` they are
    what the diagnostics need, which read no texts or cells.
    """
    found = contents.filter(~F.col("is_dir"))
    folds, only_at = (SUMMARY_FOLDS, FOLDS_AT) if reports else ((), {})
    return shred_xml(found, names=SUMMARY_NAMES, with_text=False, folds=folds, only_at=only_at)


def bare_lines(main: DataFrame) -> DataFrame:
    """No report lines: the result of a corpus without any known format."""
    return main.filter(F.lit(False)).select(
        "package",
        F.lit(0).alias("line"),
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("target"),
    )


def document_summaries(
    parts: DataFrame,
    rels: DataFrame,
    events: DataFrame,
    limits: Limits = DEFAULT,
    stage: Stage = staged,
) -> tuple[DataFrame, DataFrame]:
    """`(report lines, diagnostics)` for all packages of a known format.

    `events` are the `summary_tokens` of the packages. One bad part fails the summary of its
    package, never the job. `stage` keeps the lists of main parts, slides and sheets
    and the failures, which several branches read.
    """
    form = stage(main_parts(parts), "formats")
    main = form.select("package", "path")

    def of_format(rows: DataFrame, name: str) -> DataFrame:
        chosen = form.filter(F.col("format") == name).select("package")
        return rows.join(chosen, "package", "left_semi")

    def of_parts(rows: DataFrame) -> DataFrame:
        wanted = rows.select("package", "path").distinct()
        return events.join(wanted, ["package", "path"], "left_semi")

    # At most three rows; branches of absent formats are not planned at all.
    present = {row["format"] for row in form.select("format").distinct().collect()}
    main_events = of_parts(main)
    steps = [main.withColumn("step", F.lit(0))]

    # Slides, notes and sheets are found through the main parts.
    if "ppt" in present:
        slides = stage(of_format(S.slide_order(main_events, rels, limits), "ppt"), "slides")
        notes = slides.join(S.notes_paths(rels), ["package", "path"]).select(
            "package", F.col("notes_path").alias("path"), (F.col("slide_no") * 2 + 1).alias("step")
        )
        steps += [slides.select("package", "path", (F.col("slide_no") * 2).alias("step")), notes]
    if "excel" in present:
        sheets = stage(of_format(X.workbook_sheets(main_events, rels, limits), "excel"), "sheets")
        worksheets = sheets.filter(F.col("path").isNotNull())
        strings = of_format(parts.filter(F.col("path") == X.SHARED_STRINGS), "excel").select(
            "package", "path", F.lit(1).alias("step")
        )
        steps += [strings, worksheets.select("package", "path", (F.col("ord") + 1).alias("step"))]

    needed = reduce(DataFrame.unionByName, steps)
    failures = stage(summary_failures(needed, parts, events), "failures")
    sound = form.join(failures, "package", "left_anti")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        chosen = sound.filter(F.col("format") == name).select("package")
        return rows.join(chosen, "package", "left_semi")

    reports = [bare_lines(main)]
    if "ppt" in present:
        slide_rows = S.ppt_slides(slides, rels, of_parts(slides), of_parts(notes), limits)
        reports.append(S.ppt_summary(kept(main, "ppt"), kept(slide_rows, "ppt"), limits))
    if "word" in present:
        document_events = main_events.filter(F.col("path") == D.DOCUMENT)
        headings = D.heading_outline(document_events, limits)
        reports.append(
            D.word_summary(
                kept(main, "word"),
                D.word_counts(document_events),
                kept(headings, "word"),
                rels,
                limits,
            )
        )
    if "excel" in present:
        sheet_events = of_parts(worksheets)
        # The tokens have the cells that are shown alone; only those need their strings.
        cells = X.worksheet_cells(sheet_events, limits)
        shown = X.resolve_shared(cells, X.shared_strings(of_parts(strings), limits))
        reports.append(
            X.excel_summary(
                kept(main, "excel"),
                kept(sheets, "excel"),
                X.sheet_stats(sheet_events, limits=limits),
                X.cell_sample(shown),
                limits,
            )
        )
    lines = reduce(DataFrame.unionByName, reports[1:] or reports)
    message = F.concat(F.lit("summary parser rejected package XML: "), F.col("reason"))
    return bounded_lines(lines, limits), diagnostic(
        failures, "Error", "summary", F.lit(None), message
    )
