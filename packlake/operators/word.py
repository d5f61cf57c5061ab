"""Counts and heading outline of text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions.text import clean_text, prefix
from packlake.functions.xml import xml_attr
from packlake.limits import DEFAULT, Limits, bound
from packlake.operators.details import relationship_count
from packlake.operators.report import line, numbered
from packlake.operators.shred import found_rows, shred_xml

DOCUMENT = "/word/document.xml"
# Levels by which a heading is indented, at most; the level itself is in `heading_outline`.
INDENT_LEVELS = 1000


def word_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=[], with_text=False, folds=("paragraphs", "headings"))


def word_counts(events: DataFrame) -> DataFrame:
    """Paragraphs (start tags only; `<p/>` is none) and tables by part; of `word_tokens`."""
    return found_rows(events, "Counts").select(
        "package",
        "path",
        xml_attr("attrs", "paragraphs").cast("bigint").alias("paragraphs"),
        xml_attr("attrs", "tables").cast("bigint").alias("tables"),
    )


def heading_outline(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Headings in document order: `(package, path, ord, level, text)`; of `word_tokens`.

    A stretch runs between two paragraph boundaries; only one that a paragraph start opens and
    a paragraph end closes can be a heading, so text around a nested paragraph is dropped. Only
    headings are brought together, to be numbered.
    """
    number = F.regexp_extract(xml_attr("attrs", "style"), r"\AHeading\+?([0-9]+)\z", 1)
    level = F.nullif(number, F.lit("")).try_cast("bigint")
    cap = limits.text_chars
    w = Window.partitionBy("package", "path").orderBy("seq")
    return (
        found_rows(events, "Heading")
        .withColumn("level", level)
        .withColumn("text", clean_text(prefix("text", cap), cap))
        .filter("level is not null and text <> ''")
        .withColumn("ord", F.row_number().over(w))
        .filter(F.col("ord") <= bound(limits.summary_items))
        .select("package", "path", "ord", "level", "text")
    )


def word_summary(
    documents: DataFrame,
    counts: DataFrame,
    headings: DataFrame,
    rels: DataFrame,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Report lines for each package of `documents` (its main part read and well-formed)."""
    main = F.col("path") == DOCUMENT
    images = relationship_count(rels.filter(F.col("source") == DOCUMENT), "/image")
    has_headings = headings.filter(main).groupBy("package").agg(F.count(F.lit(1)).alias("n_headings"))
    facts = (
        documents.select("package")
        .join(counts.filter(main).drop("path"), "package", "left")
        .join(images.select("package", F.col("n").alias("images")), "package", "left")
        .join(has_headings, "package", "left")
    )

    def count_line(order: int, label: str, name: str):
        value = F.coalesce(F.col(name), F.lit(0)).cast("string")
        return line([order, 0], F.concat(F.lit(label), value))

    none = F.when(F.col("n_headings").isNull(), F.array(line([8, 0], F.lit("  (none)")))).otherwise(
        F.array().cast("array<struct<key:struct<k0:int,k1:int>,text:string,target:string>>")
    )
    head = facts.select(
        "package",
        F.inline(
            F.concat(
                F.array(
                    line([0, 0], F.lit("Word summary")),
                    line([1, 0], F.lit("")),
                    line([2, 0], F.lit(f"Document: {DOCUMENT}"), F.lit(DOCUMENT)),
                    count_line(3, "Paragraphs: ", "paragraphs"),
                    count_line(4, "Tables: ", "tables"),
                    count_line(5, "Images: ", "images"),
                    line([6, 0], F.lit("")),
                    line([7, 0], F.lit("Heading outline")),
                ),
                none,
            )
        ),
    )
    # A report with a byte limit cuts wider indents anyway; without one, a level of any number of digits
    # must not make a line of that many spaces.
    widest = INDENT_LEVELS if limits.summary_bytes is None else limits.summary_bytes // 2 + 1
    indent = F.least("level", F.lit(widest)).cast("int")
    body = headings.filter(main).select(
        "package",
        F.inline(
            F.array(
                line(
                    [8, F.col("ord")],
                    F.concat(F.lit("  "), F.repeat(F.lit("  "), indent), F.col("text")),
                )
            )
        ),
    )
    return numbered(head.unionByName(body), "key", limits=limits)
