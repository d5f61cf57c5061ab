"""Hyperlinks and fields of text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.functions.text import clean_text, prefix
from packlake.functions.xml import xml_attr
from packlake.limits import DEFAULT, Limits
from packlake.operators.shred import found_rows, shred_xml

_FIRST_ARGUMENT = r'\A\s*\S+\s+(?:"((?:[^"\\]|\\.)*)"|(\S+))'


def link_tokens(contents: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Links, and the elements with names in `more`, of all parts given."""
    return shred_xml(contents, names=list(more), with_text=False, folds=("links",))


def document_links(events: DataFrame, rels: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, path, ord, kind, depth, closed, code, target, text)` of hyperlinks and fields, of `link_tokens`.

    `ord` numbers them by their starts, `depth` counts the ones open around them and themselves. `code` is a
    field's type in capitals. The target of a hyperlink is that of its relationship, external or resolved, else
    `#` and its anchor; of a HYPERLINK field its first argument. A relationship that is not there or does not
    resolve gives null. A field that its part never closes has `closed` false and the text up to the end.
    """
    cap = limits.text_chars
    links = found_rows(events, "Link").select(
        "package",
        "path",
        F.col("seq").alias("ord"),
        xml_attr("attrs", "kind").alias("kind"),
        xml_attr("attrs", "depth").cast("int").alias("depth"),
        (xml_attr("attrs", "closed") == "1").alias("closed"),
        xml_attr("attrs", "id").alias("id"),
        xml_attr("attrs", "anchor").alias("anchor"),
        xml_attr("attrs", "instruction").alias("instruction"),
        clean_text(prefix("text", cap), cap).alias("text"),
    )
    targets = rels.groupBy("package", F.col("source").alias("path"), "id").agg(
        F.min_by(F.struct(F.when(F.col("target_mode") == "External", F.col("target")).otherwise(F.col("resolved_target")).alias("to")), "rel_ord").alias("t")
    )
    code = F.nullif(F.upper(F.regexp_extract("instruction", r"\A\s*(\S+)", 1)), F.lit(""))
    argument = F.concat(F.regexp_extract("instruction", _FIRST_ARGUMENT, 1), F.regexp_extract("instruction", _FIRST_ARGUMENT, 2))
    target = F.when(
        F.col("kind") == "hyperlink", F.coalesce("t.to", F.when(F.col("id").isNull(), F.concat(F.lit("#"), F.col("anchor"))))
    ).when(code == "HYPERLINK", F.nullif(argument, F.lit("")))
    return links.join(targets, ["package", "path", "id"], "left").select(
        "package", "path", "ord", "kind", "depth", "closed", code.alias("code"), target.alias("target"), "text"
    )
