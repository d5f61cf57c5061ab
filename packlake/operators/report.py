"""Bounded text reports: what all document summaries end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlake.functions.text import byte_prefix, lines_before
from packlake.limits import DEFAULT, Limits, bound


def bounded_lines(lines: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, line, text[, target])` with dense `line` from 0 to the lines that fit.

    A line is dropped once the report has `summary_lines` lines or `summary_bytes` bytes, where
    these limits are set; the one that crosses the byte limit is cut on a character boundary and
    marked. Every line adds at least one to the line count, so lines at or beyond the cap go before
    the shuffle. The link span counts characters of the uncut line.
    """
    most_lines, most_bytes = bound(limits.summary_lines), bound(limits.summary_bytes)
    if "target" not in lines.columns:
        lines = lines.withColumn("target", F.lit(None).cast("string"))
    w = Window.partitionBy("package").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text") + 1
    room = F.greatest(F.lit(most_bytes) - F.col("used") - 1, F.lit(0))
    at = F.position("target", "text")
    cut = F.octet_length("text") > room
    linked = F.col("target").isNotNull() & (at > 0)
    return (
        lines.filter(F.col("line") < most_lines)
        .withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0)))
        .withColumn("at_line", F.coalesce(F.sum(lines_before("text") + 1).over(w), F.lit(0)))
        .filter(
            (F.col("at_line") < most_lines) & (F.col("used") < most_bytes)
        )
        .select(
            "package",
            F.col("at_line").cast("int").alias("line"),
            F.when(cut, F.concat(byte_prefix("text", F.least(room, F.lit(2**31 - 1)).cast("int")), F.lit("…")))
            .otherwise(F.col("text"))
            .alias("text"),
            F.when(linked, at - 1).alias("link_start"),
            F.when(linked, at - 1 + F.char_length("target")).alias("link_end"),
            F.when(linked, F.col("target")).alias("link_target"),
        )
    )


def numbered(lines: DataFrame, *order: str, limits: Limits = DEFAULT) -> DataFrame:
    """Numbers the lines of each package from 0 in the given order, up to the line limit, if any."""
    w = Window.partitionBy("package").orderBy(*order)
    return (
        lines.withColumn("_no", F.row_number().over(w))
        .filter(F.col("_no") <= bound(limits.summary_lines))
        .select("package", (F.col("_no") - 1).alias("line"), "text", "target")
    )


def line(order: list, text, target=None):
    """One report line as a struct: sort key, text, link target."""
    key = F.struct(*[F.lit(o).alias(f"k{i}") if isinstance(o, int) else o.cast("int").alias(f"k{i}") for i, o in enumerate(order)])
    return F.struct(
        key.alias("key"),
        text.cast("string").alias("text"),
        (F.lit(None) if target is None else target).cast("string").alias("target"),
    )
