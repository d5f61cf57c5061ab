"""Sheets, shared strings and cells of workbooks. Cell values stay text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions.text import prefix
from packlake.functions.xml import is_element, xml_attr
from packlake.limits import DEFAULT, Limits, bound
from packlake.operators.details import relationship_target_for_id
from packlake.operators.folds import SAMPLE_CELLS
from packlake.operators.report import line, numbered
from packlake.operators.shred import found_rows, shred_xml

WORKBOOK = "/xl/workbook.xml"
SHARED_STRINGS = "/xl/sharedStrings.xml"


def workbook_sheets(events: DataFrame, rels: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Sheets in document order; `path` is null where the relationship does not resolve."""
    named = (
        events.filter((F.col("path") == WORKBOOK) & is_element("sheet", "Start", "Empty"))
        .select(
            "package",
            F.lit(WORKBOOK).alias("source"),
            "seq",
            xml_attr("attrs", "name").alias("name"),
            xml_attr("attrs", "r:id").alias("id"),
        )
        .filter("name is not null and id is not null")
    )
    w = Window.partitionBy("package").orderBy("seq")
    kept = named.withColumn("ord", F.row_number().over(w)).filter(
        F.col("ord") <= bound(limits.summary_items)
    )
    return relationship_target_for_id(kept, rels).select(
        "package", "ord", "name", F.col("id").alias("rel_id"), "path"
    )


def string_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=[], with_text=False, folds=("strings",))


def shared_strings(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, idx, value)`: one entry per closed `si`, text of its `t` elements joined.

    Of `string_tokens`. A self-closing `<si/>` is no entry.
    """
    return (
        found_rows(events, "String")
        .filter(F.col("seq") < bound(limits.shared_strings))
        .select("package", F.col("seq").alias("idx"), prefix("text", limits.text_chars).alias("value"))
    )


def cell_tokens(contents: DataFrame) -> DataFrame:
    return shred_xml(contents, names=["dimension"], with_text=False, folds=("cells",))


def worksheet_cells(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """All cells: `(package, path, ord, reference, cell_type, value, formula)`; of `cell_tokens`."""
    cap = limits.text_chars
    return found_rows(events, "Cell").select(
        "package",
        "path",
        F.col("seq").alias("ord"),
        xml_attr("attrs", "r").alias("reference"),
        xml_attr("attrs", "t").alias("cell_type"),
        prefix("text", cap).alias("value"),
        prefix(xml_attr("attrs", "f"), cap).alias("formula"),
    )


def string_index(value: Column | str) -> Column:
    """Position a shared-string cell names; null if its value is no unsigned 64-bit number."""
    digits = F.regexp_extract(value, r"\A\+?0*([0-9]{1,20})\z", 1)
    number = F.nullif(digits, F.lit("")).try_cast("decimal(20,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)


def resolve_shared(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Replaces the value of shared-string cells by the string; '' if out of range.

    The join key is `(package, idx)`, unique on the string side; a hot string is split by the
    adaptive skew join, or the string side is broadcast where its measured size allows.
    """
    index = F.when(F.col("cell_type") == "s", string_index("value"))
    # Positions beyond any table find nothing, as they must.
    keyed = cells.withColumn("idx", F.when(index <= 2**31 - 2, index.cast("int")))
    table = strings.select("package", "idx", F.col("value").alias("_shared"))
    resolved = F.when(index.isNotNull(), F.coalesce("_shared", F.lit(""))).otherwise(F.col("value"))
    return (
        keyed.join(table, ["package", "idx"], "left")
        .withColumn("value", resolved)
        .select(*cells.columns)
    )


def sheet_tokens(contents: DataFrame) -> DataFrame:
    """Facts of worksheets, without a row for each cell; for `sheet_stats` alone."""
    return shred_xml(contents, names=[], with_text=False, folds=("sheet",))


def shown_tokens(contents: DataFrame) -> DataFrame:
    """The facts of worksheets and the cells that reports show; for `sheet_stats` alone and `cell_sample`."""
    return shred_xml(contents, names=[], with_text=False, folds=("shown",))


def sheet_stats(events: DataFrame, cells: DataFrame | None = None, limits: Limits = DEFAULT) -> DataFrame:
    """Per worksheet: declared range (last one), cell count (up to the items limit, if any), formula count.

    Of `cell_tokens` and their `worksheet_cells`, or of `sheet_tokens` alone: these have a row for each part,
    so nothing is brought together.
    """
    if cells is None:
        n_cells = xml_attr("attrs", "cells").cast("bigint")
        return found_rows(events, "Sheet").select(
            "package",
            "path",
            F.col("text").alias("range"),
            F.least(n_cells, F.lit(bound(limits.summary_items))).cast("bigint").alias("n_cells"),
            xml_attr("attrs", "formulas").cast("bigint").alias("formula_count"),
        )
    ranges = (
        events.filter(is_element("dimension", "Start", "Empty"))
        .groupBy("package", "path")
        .agg(F.max_by(F.struct(xml_attr("attrs", "ref").alias("v")), "seq")["v"].alias("range"))
    )
    counts = cells.groupBy("package", "path").agg(
        F.least(F.count(F.lit(1)), F.lit(bound(limits.summary_items))).alias("n_cells"),
        F.count("formula").alias("formula_count"),
    )
    return ranges.join(counts, ["package", "path"], "full").select(
        "package",
        "path",
        "range",
        F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"),
        F.coalesce("formula_count", F.lit(0)).alias("formula_count"),
    )


def cell_sample(cells: DataFrame, n: int = SAMPLE_CELLS) -> DataFrame:
    """The first `n` cells of each worksheet that show something, as text lines.

    Cells without formula and value use up a slot but show nothing.
    """
    shown = F.coalesce("formula", F.nullif("value", F.lit("")))
    return (
        cells.filter((F.col("ord") <= n) & shown.isNotNull())
        .select(
            "package",
            "path",
            "ord",
            F.concat(F.lit("  "), F.col("reference"), F.lit(" = "), shown).alias("line"),
        )
    )


def excel_summary(
    workbooks: DataFrame,
    sheets: DataFrame,
    stats: DataFrame,
    sample: DataFrame,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Report lines for each package of `workbooks`."""
    counts = sheets.groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    head = workbooks.select("package").join(counts, "package", "left").select(
        "package",
        F.inline(
            F.array(
                line([0, 0, 0], F.lit("Excel summary")),
                line([0, 1, 0], F.lit("")),
                line([0, 2, 0], F.lit(f"Workbook: {WORKBOOK}"), F.lit(WORKBOOK)),
                line(
                    [0, 3, 0],
                    F.concat(F.lit("Sheets: "), F.coalesce("n", F.lit(0)).cast("string")),
                ),
            )
        ),
    )
    no = F.col("ord")

    def said(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    more = F.col("n_cells") - SAMPLE_CELLS
    n_cells = F.coalesce("n_cells", F.lit(0)).cast("string")
    n_formulas = F.coalesce("formula_count", F.lit(0)).cast("string")
    intro = F.array(line([no, 0, 0], F.lit("")), line([no, 1, 0], said("- ", F.col("name"))))
    lost = F.array(line([no, 2, 0], F.lit("  Worksheet part: unavailable")))
    facts = F.array(
        line([no, 2, 0], said("  Worksheet: ", F.col("path")), F.col("path")),
        line([no, 3, 0], said("  Range: ", F.coalesce("range", F.lit("unknown")))),
        line([no, 4, 0], said("  Cells: ", n_cells)),
        line([no, 5, 0], said("  Formulas: ", n_formulas)),
    )
    rest = F.array(
        line([no, 7, 0], F.concat(F.lit("  ... "), more.cast("string"), F.lit(" more cells")))
    )
    known = F.col("path").isNotNull()
    lines = F.when(~known, F.concat(intro, lost)).when(
        more > 0, F.concat(intro, facts, rest)
    ).otherwise(F.concat(intro, facts))
    blocks = sheets.join(stats, ["package", "path"], "left").select("package", F.inline(lines))
    samples = (
        sheets.select("package", "path", no.alias("sheet_no"))
        .join(sample, ["package", "path"])
        .select(
            "package",
            F.inline(F.array(line([F.col("sheet_no"), 6, F.col("ord")], F.col("line")))),
        )
    )
    return numbered(head.unionByName(blocks).unionByName(samples), "key", limits=limits)
