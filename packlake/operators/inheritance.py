"""Values that come from a chain of parents: styles, and slides by layouts, masters and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions.text import clean_text, prefix
from packlake.functions.xml import xml_attr
from packlake.limits import DEFAULT, Limits
from packlake.operators.shred import found_rows, shred_xml
from packlake.session import Scratch, staged

DOCUMENT, STYLES = "/word/document.xml", "/word/styles.xml"
# Relationship types that lead from a slide to its theme, and the levels of an outline.
CHAIN = ("/slideLayout", "/slideMaster", "/theme")
BODY_LEVEL = 9


def inherited(nodes: DataFrame, values: list[str], keys: tuple[str, ...] = ("package",)) -> DataFrame:
    """`nodes` `(…keys, id, parent, …values)` with the first value of each column along the chain of parents.

    Adds `depth`, the number of parents above a node, and `in_cycle` for those whose chain does not end
    (their depth is null, their values are those of the nodes that are met). A parent that is not there
    ends the chain. Ids are unique within keys; a null id inherits as well, but is nobody's parent.

    Pointer doubling: each round a node takes the values and the pointer of the one it points at, so a
    chain of n nodes takes log2(n) joins. A parent that very many nodes share is split by the adaptive skew
    join. Rounds end when no pointer is left, or when they are enough for a chain of all nodes of the
    largest key.
    """
    spark = nodes.sparkSession
    keys = list(keys)
    with Scratch(spark) as scratch:
        present = nodes.select(*keys, F.col("id").alias("parent")).filter("parent is not null")
        state = scratch.staged(
            nodes.join(present.withColumn("_real", F.lit(True)).distinct(), [*keys, "parent"], "left").select(
                *keys,
                "id",
                F.when(F.col("_real"), F.col("parent")).alias("parent"),
                *values,
                F.when(F.col("_real"), 1).otherwise(0).cast("long").alias("depth"),
            ),
            "chain",
        )
        most = state.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        for _ in range(most.bit_length()):
            if state.filter("parent is not null").isEmpty():
                break
            above = state.filter("id is not null").select(
                *keys,
                F.col("id").alias("parent"),
                F.col("parent").alias("_next"),
                F.col("depth").alias("_depth"),
                *(F.col(v).alias(f"_{v}") for v in values),
            )
            state = scratch.staged(
                state.join(above, [*keys, "parent"], "left").select(
                    *keys,
                    "id",
                    F.col("_next").alias("parent"),
                    *(F.coalesce(v, f"_{v}").alias(v) for v in values),
                    (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                ),
                "chain",
            )
        endless = F.col("parent").isNotNull()
        return staged(
            state.select(*keys, "id", *values, F.when(~endless, F.col("depth")).alias("depth"), endless.alias("in_cycle")),
            "inherited",
        )


def style_tokens(contents: DataFrame) -> DataFrame:
    """Tokens of document and style parts, for `styled_outline`."""
    return shred_xml(contents, names=[], with_text=False, folds=("styles", "outlines"))


def word_styles(events: DataFrame) -> DataFrame:
    """`(package, path, ord, id, parent, outline, name)` of the styles of style parts; outline from 0.

    Of styles with one id the first counts; styles without an id are left out.
    """
    styles = found_rows(events, "Style").select(
        "package",
        "path",
        F.col("seq").alias("ord"),
        xml_attr("attrs", "styleId").alias("id"),
        xml_attr("attrs", "basedOn").alias("parent"),
        outline_level(xml_attr("attrs", "outlineLvl")).alias("outline"),
        F.col("text").alias("name"),
    )
    fields = F.struct("ord", "parent", "outline", "name")
    first = styles.filter("id is not null").groupBy("package", "path", "id").agg(F.min_by(fields, "ord").alias("s"))
    return first.select("package", "path", "id", "s.*")


def outline_level(value: Column) -> Column:
    """0 to 9; null for anything else."""
    return F.when(value.rlike(r"\A[0-9]\z"), value.cast("int"))


def styled_outline(events: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, ord, style, level, inherited_from, text)`: headings of the main part, by outline levels.

    A paragraph's own level counts first, else that of its style or of the nearest style it is based on;
    level 9 is body text. So headings are found whatever their styles are called. `inherited_from` is the
    style that gives the level, null for a paragraph's own. Paragraphs without text are no headings. Of
    `style_tokens`.
    """
    styles = word_styles(events.filter(F.col("path") == STYLES))
    nodes = styles.select("package", "id", "parent", "outline", F.when(F.col("outline").isNotNull(), F.col("id")).alias("giver"))
    known = inherited(nodes, ["outline", "giver"])
    cap = limits.text_chars
    found = (
        found_rows(events, "Outline")
        .filter(F.col("path") == DOCUMENT)
        .select(
            "package",
            F.col("seq").alias("ord"),
            xml_attr("attrs", "style").alias("style"),
            outline_level(xml_attr("attrs", "outlineLvl")).alias("own"),
            clean_text(prefix("text", cap), cap).alias("text"),
        )
        .filter("text <> ''")
    )
    joined = found.join(known.select("package", F.col("id").alias("style"), "outline", "giver"), ["package", "style"], "left")
    level = F.coalesce("own", "outline")
    return joined.filter(level < BODY_LEVEL).select(
        "package",
        "ord",
        "style",
        (level + 1).alias("level"),
        F.when(F.col("own").isNull(), F.col("giver")).alias("inherited_from"),
        "text",
    )


def slide_chain(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """`(package, path, layout, master, theme, depth)` of each slide, by relationships from part to part.

    A slide leads to a layout, that to a master, and that to a theme. Of several relationships of one
    type the first with a target counts, what is missing is null. The chain is followed by pointer
    doubling, so a theme that slides or layouts link to directly is found as well.
    """
    kinds = dict(zip(CHAIN, ("layout", "master", "theme"), strict=True))
    step = F.lit(None)
    rank = F.lit(None)
    for order, suffix in enumerate(reversed(CHAIN)):
        ends = F.col("relationship_type").endswith(suffix)
        step = F.when(ends, F.lit(kinds[suffix])).otherwise(step)
        rank = F.when(ends, F.lit(len(CHAIN) - order)).otherwise(rank)
    up = (
        rels.filter(F.col("target_mode") == "Internal")
        .select("package", F.col("source").alias("id"), "rel_ord", "resolved_target", step.alias("step"), rank.alias("rank"))
        .filter("step is not null")
        .groupBy("package", "id")
        # A master has layouts and a theme: the way up is the one of the highest kind.
        .agg(F.max_by(F.struct("resolved_target", "step"), F.struct("rank", -F.col("rel_ord"))).alias("up"))
    )
    nodes = parts.select("package", F.col("path").alias("id")).distinct().join(up, ["package", "id"], "left")
    columns = [F.when(F.col("up.step") == kind, F.col("up.resolved_target")).alias(kind) for kind in kinds.values()]
    found = inherited(nodes.select("package", "id", F.col("up.resolved_target").alias("parent"), *columns), list(kinds.values()))
    return found.filter(F.col("id").rlike(r"\A/ppt/slides/[^/]+\.xml\z")).select(
        "package", F.col("id").alias("path"), *kinds.values(), "depth"
    )
