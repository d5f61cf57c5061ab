"""Slides, titles and notes of presentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions.text import clean_text, prefix
from packlake.functions.xml import is_element, xml_attr
from packlake.limits import DEFAULT, Limits, bound
from packlake.operators.details import relationship_count, relationship_target_for_id
from packlake.operators.report import line, numbered
from packlake.operators.shred import found_rows, shred_xml

PRESENTATION = "/ppt/presentation.xml"
UNTITLED = "(untitled)"


def slide_order(events: DataFrame, rels: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Slides in document order; ids that resolve to nothing are skipped.

    `events` are tokens that include `sldId`.
    """
    ids = events.filter(
        (F.col("path") == PRESENTATION) & is_element("sldId", "Start", "Empty")
    ).select(
        "package", F.lit(PRESENTATION).alias("source"), "seq", xml_attr("attrs", "r:id").alias("id")
    )
    w = Window.partitionBy("package").orderBy("seq")
    return (
        relationship_target_for_id(ids.filter(F.col("id").isNotNull()), rels)
        .filter(F.col("path").isNotNull())
        .withColumn("slide_no", F.row_number().over(w))
        .filter(F.col("slide_no") <= bound(limits.summary_items))
        .select("package", "slide_no", "path")
    )


def title_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=[], with_text=False, folds=("titles",))


def slide_title(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """First top-level shape with a title placeholder and text after it; of `title_tokens`.

    Text runs are joined without separator. Parts without a title give no row.
    """
    cap = limits.text_chars
    titled = (
        found_rows(events, "Title")
        .select("package", "path", "seq", clean_text(prefix("text", cap), cap).alias("title"))
        .filter("title <> ''")
    )
    return titled.groupBy("package", "path").agg(F.min_by("title", "seq").alias("title"))


def text_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=[], with_text=False, folds=("whole",))


def all_text(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """All text of a part, concatenated; of `text_tokens`. Row-local."""
    return found_rows(events, "Whole").select(
        "package", "path", prefix("text", limits.text_chars).alias("text")
    )


def notes_paths(rels: DataFrame) -> DataFrame:
    """First notes relationship of each slide that has a resolved target."""
    return (
        rels.filter(
            F.col("relationship_type").endswith("/notesSlide")
            & (F.col("target_mode") == "Internal")
        )
        .groupBy("package", F.col("source").alias("path"))
        .agg(F.min_by("resolved_target", "rel_ord").alias("notes_path"))
    )


def slide_notes(
    slides: DataFrame, rels: DataFrame, note_events: DataFrame, limits: Limits = DEFAULT
) -> DataFrame:
    """Adds `notes_path` and `notes_text` (null when empty) to slides."""
    texts = all_text(note_events, limits).select(
        "package",
        F.col("path").alias("notes_path"),
        F.nullif(clean_text("text", limits.text_chars), F.lit("")).alias("notes_text"),
    )
    return (
        slides.select("package", "slide_no", "path")
        .join(notes_paths(rels), ["package", "path"], "left")
        .join(texts, ["package", "notes_path"], "left")
        .select("package", "slide_no", "path", "notes_path", "notes_text")
    )


def ppt_slides(
    slides: DataFrame,
    rels: DataFrame,
    title_events: DataFrame,
    note_events: DataFrame,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """One row per slide: number, part, title, images, notes."""
    images = relationship_count(rels, "/image").withColumnRenamed("n", "images")
    return (
        slide_notes(slides, rels, note_events, limits)
        .join(slide_title(title_events, limits), ["package", "path"], "left")
        .join(images, ["package", "path"], "left")
        .select(
            "package",
            "slide_no",
            "path",
            F.coalesce("title", F.lit(UNTITLED)).alias("title"),
            F.coalesce("images", F.lit(0)).alias("images"),
            "notes_path",
            "notes_text",
        )
    )


def ppt_summary(
    packages: DataFrame, slide_rows: DataFrame, limits: Limits = DEFAULT
) -> DataFrame:
    """Report lines `(package, line, text, target)` for each presentation package."""
    counts = slide_rows.groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    head = packages.select("package").join(counts, "package", "left").select(
        "package",
        F.inline(
            F.array(
                line([0, 0], F.lit("PowerPoint summary")),
                line([0, 1], F.lit("")),
                line(
                    [0, 2],
                    F.concat(F.lit("Slides: "), F.coalesce("n", F.lit(0)).cast("string")),
                ),
            )
        ),
    )
    no = F.col("slide_no")

    def said(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    notes = F.when(F.col("notes_path").isNull(), "   Notes: none").otherwise(
        F.concat(
            F.lit("   Notes: "),
            F.col("notes_path"),
            F.coalesce(said(" — ", F.col("notes_text")), F.lit("")),
        )
    )
    body = slide_rows.select(
        "package",
        F.inline(
            F.array(
                line([no, 0], F.lit("")),
                line([no, 1], F.concat(no.cast("string"), F.lit(". "), F.col("title"))),
                line([no, 2], said("   Part: ", F.col("path")), F.col("path")),
                line([no, 3], said("   Images: ", F.col("images").cast("string"))),
                line([no, 4], notes, F.col("notes_path")),
            )
        ),
    )
    return numbered(head.unionByName(body), "key", limits=limits)
