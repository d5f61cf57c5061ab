"""Bounded previews of parts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions import media as M
from packlake.functions.paths import normalize_path
from packlake.functions.text import utf8_text
from packlake.limits import DEFAULT, Limits, bound
from packlake.operators.shred import parse_error
from packlake.sources.packages import explode_packages


def limited_output(text: Column, label: str, limit: int | None) -> Column:
    """Error message if `text` is larger than `limit` bytes, else null."""
    return F.when(F.octet_length(text) > bound(limit), F.lit(f"{label} exceeds {limit} byte limit"))


# Hex ----------------------------------------------------------------------------------------


def hex_dump(parts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """One row per dump line; row-local."""
    lines = F.posexplode(M.hex_lines("content", limits)).alias("line", "text")
    return parts.select("package", "path", lines)


# JSON ---------------------------------------------------------------------------------------


# Fixed value: deepest nesting that still counts as JSON.
MAX_DEPTH = 127


def _constant(name: str):
    raise ValueError(name)


def _float_text(value: float) -> str:
    """Shortest digits; plain notation from 1e-5 up to below 1e16, else exponent form."""
    shortest = repr(value)
    if "e" not in shortest:
        return shortest
    digits, power = shortest.split("e")
    if int(power) == -5:
        sign = "-" if value < 0 else ""
        return f"{sign}0.0000{digits.lstrip('-').replace('.', '')}"
    return f"{digits}e{int(power)}"


def _integer(text: str):
    value = int(text)
    if text == "-0" or not -(2**63) <= value < 2**64:
        return float(text)
    return value


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def _render(value, indent: str) -> str:
    inner = indent + "  "
    if isinstance(value, (dict, list)) and len(inner) > 2 * MAX_DEPTH:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        if not value:
            return "{}"
        items = [
            f"{inner}{json.dumps(k, ensure_ascii=False)}: {_render(value[k], inner)}"
            for k in sorted(value)
        ]
        return "{\n" + ",\n".join(items) + f"\n{indent}}}"
    if isinstance(value, list):
        if not value:
            return "[]"
        return "[\n" + ",\n".join(inner + _render(v, inner) for v in value) + f"\n{indent}]"
    if isinstance(value, float):
        return _float_text(value)
    return json.dumps(value, ensure_ascii=False)


def pretty_json(text: str) -> str | None:
    """Two-space indent, keys sorted, last duplicate key kept; null if it is no JSON."""
    try:
        value = json.loads(
            text, parse_constant=_constant, parse_int=_integer, parse_float=_number
        )
        out = _render(value, "")
        out.encode("utf-8")
        return out
    except (ValueError, RecursionError):
        return None


def _pretty_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else pretty_json(t))


def formatted_json(text: Column) -> Column:
    """Formatted text; invalid JSON stays as it is, null stays null."""
    return F.coalesce(F.pandas_udf(_pretty_texts, "string")(text), text)


def json_error(raw: Column, formatted: Column, limits: Limits) -> Column:
    too_long = limited_output(formatted, "formatted JSON preview", limits.json_bytes)
    return F.when(raw.isNull(), "JSON is not valid UTF-8").otherwise(
        F.concat(F.lit("JSON preview failed: "), too_long)
    )


def json_pretty(parts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, path, text, error)`: formatted JSON; invalid JSON stays as it is. Row-local."""
    shaped = parts.select("package", "path", utf8_text("content").alias("raw")).withColumn(
        "text", formatted_json(F.col("raw"))
    )
    return shaped.withColumn("error", json_error(F.col("raw"), F.col("text"), limits)).select(
        "package", "path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error"
    )


# XML ----------------------------------------------------------------------------------------

# Comments, CDATA, processing instructions, declarations, tags, text.
XML_TOKEN = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>\[]*+(?:\[[^\]]*+\][^>\[]*+)?>"
    r"|<[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|[^<]++",
    re.DOTALL,
)


def _layout(source: str, limit: int) -> str | None:
    """Tokens re-emitted with two-space indent; none over `limit` bytes, which ends the work."""
    out: list[str] = []
    level = used = 0
    after_text = True
    for token in XML_TOKEN.findall(source):
        inline = not token.startswith("<") or token.startswith("<![CDATA[")
        end = token.startswith("</")
        start = not inline and not end and not token.startswith(("<!", "<?")) and not token.endswith("/>")
        level -= end
        breaks = not inline and not after_text
        used += len(token.encode()) + (2 * level + 1 if breaks else 0)
        if used > limit:
            return None
        if end:
            token = re.sub(r"[ \t\n\x0b\f\r]+>\Z", ">", token)
        out.append("\n" + "  " * level + token if breaks else token)
        level += start
        after_text = inline
    return "".join(out)


def xml_pretty(parts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, path, text, error)`: tokens re-emitted with two-space indent. Row-local.

    A token goes on its own line unless text came before it; text is kept as it is. Bytes that are
    not UTF-8 are replaced before the part is tested and laid out. Sizes are summed before anything
    is indented, so deep nesting cannot blow up: a part over the limit gives an error.
    """
    limit = bound(limits.xml_bytes)

    def pretty(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            source = (content or b"").decode("utf-8", "replace").removeprefix("\ufeff")
            broken = parse_error(source.encode())
            text = None if broken is not None else _layout(source, limit)
            rows.append((text, broken))
        return pd.DataFrame(rows, columns=["text", "broken"], dtype=object)

    laid = F.pandas_udf(pretty, "text string, broken string")(F.col("content").cast("binary"))
    failed = F.concat(
        F.lit("XML preview failed: "), F.col("path"), F.lit(": malformed XML: "), F.col("_laid.broken")
    )
    too_long = F.when(
        F.col("_laid.text").isNull(),
        f"XML preview failed: formatted XML preview exceeds {limits.xml_bytes} byte limit",
    )
    return parts.select("package", "path", laid.alias("_laid")).select(
        "package", "path", "_laid.text", F.coalesce(failed, too_long).alias("error")
    )


# Images -------------------------------------------------------------------------------------


def image_error(size: Column, limits: Limits = DEFAULT) -> Column:
    """Why an image of this header size is not shown; null if it is."""
    width, height = size["width"], size["height"]
    return (
        F.when(
            F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0)) == 0,
            "image decode failed: unreadable header",
        )
        .when(
            (width > bound(limits.image_side)) | (height > bound(limits.image_side)),
            "image decode failed: dimensions exceed the limit",
        )
        .when(
            width * height > bound(limits.image_pixels),
            f"image exceeds {limits.image_pixels} pixel limit",
        )
    )


def image_guard(parts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, path, format, width, height, error)` from image headers, pixels not decoded."""
    content = F.col("content").cast("binary")
    sized = (
        parts.select("package", "path", "archive_name", content.alias("content"))
        .withColumn("format", M.image_format("archive_name"))
        .withColumn("_jpeg", M.jpeg_size("archive_name", "content"))
        .withColumn("size", M.image_size(F.col("format"), F.col("content"), F.col("_jpeg")))
    )
    return sized.select(
        "package",
        "path",
        "format",
        F.col("size.width").alias("width"),
        F.col("size.height").alias("height"),
        image_error(F.col("size"), limits).alias("error"),
    )


# All of it ----------------------------------------------------------------------------------


def build_previews(parts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`(package, path, preview_kind, preview_text, preview_error)` for read parts.

    Everything but XML is made in place in one pass; only JSON text and JPEG bytes go to Python.
    XML takes a second pass over the rows that are XML by name or type.
    """
    name, typ = F.col("archive_name"), F.col("content_type")
    is_xml = ~M.is_image_name(name) & M.is_xml(name, typ)
    return previews_of(parts.filter(~is_xml), parts.filter(is_xml), limits)


def previews_of(others: DataFrame, markup: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Previews of parts that are XML by name or type, and of others."""
    name, typ = F.col("archive_name"), F.col("content_type")
    by_kind = F.col("preview_kind")

    pass_one = (
        others.select(
            "package", "path", "archive_name", "content_type", "size", "compressed_size",
            F.col("content").cast("binary").alias("content"),
        )
        .withColumn("preview_kind", M.preview_kind(name, typ, "content"))
        .withColumn("raw", utf8_text("content"))
        .withColumn("json", formatted_json(F.when(by_kind == "Json", F.col("raw"))))
        .withColumn("_jpeg", M.jpeg_size(name, F.when(by_kind == "Image", F.col("content"))))
    )
    size = M.image_size(M.image_format(name), F.col("content"), F.col("_jpeg"))
    error = (
        F.when(by_kind == "Image", image_error(size, limits))
        .when(by_kind == "Json", json_error(F.col("raw"), F.col("json"), limits))
        .when(by_kind == "Error", "JSON is not valid UTF-8")
    )
    notice = M.truncation_notice("content", limits)
    lines = F.transform(M.hex_lines("content", limits), lambda s: F.concat(s, F.lit("\n")))
    dump = F.concat(
        F.array_join(lines, ""),
        F.coalesce(F.concat(F.lit("\n"), notice, F.lit("\n")), F.lit("")),
    )
    info = M.binary_info(name, M.info_category(name, typ), typ, "size", "compressed_size")
    text = (
        F.when(by_kind == "Hex", dump)
        .when(by_kind == "PlainText", F.col("raw"))
        .when(by_kind == "Json", F.col("json"))
        .when(by_kind == "Info", info)
    )
    shown = pass_one.withColumn("error", error).withColumn("text", text)
    rendered = shown.unionByName(
        xml_pretty(markup, limits).withColumn("preview_kind", F.lit("Xml")),
        allowMissingColumns=True,
    )
    failed = F.col("error").isNotNull()
    return rendered.select(
        "package",
        "path",
        F.when(failed, "Error").otherwise(by_kind).alias("preview_kind"),
        F.when(~failed, F.col("text")).alias("preview_text"),
        F.col("error").alias("preview_error"),
    )


def preview_packages(packages: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """`build_previews` of the parts of packages, opened where they are read.

    Content types are resolved in the task that has the package, and a part's bytes become its preview in
    that task, so nothing but previews leaves it. XML parts and the others are two passes over the packages,
    each of which inflates its own. The first entry of a path counts; directories and entries without a path
    have no preview. An entry that cannot be read shows why; a package that cannot be opened has no parts.
    """

    def opened(typed: str) -> DataFrame:
        entries = explode_packages(packages, with_content=True, limits=limits, typed=typed)
        named = entries.filter((F.col("ord") >= 0) & ~F.col("is_dir") & (F.col("copy") == 0))
        path = F.concat(F.lit("/"), normalize_path("archive_name"))
        deep = F.size(F.split("path", "/")) - 1 > bound(limits.path_depth)
        return named.withColumn("path", path).filter((F.col("path") != "/") & ~deep)

    readable = F.col("content").isNotNull()
    rest, markup = opened("other"), opened("markup")
    shown = previews_of(rest.filter(readable), markup.filter(readable), limits)
    unread = rest.filter(~readable).unionByName(markup.filter(~readable)).select(
        "package",
        "path",
        F.lit("Error").alias("preview_kind"),
        F.lit(None).cast("string").alias("preview_text"),
        F.col("read_error").alias("preview_error"),
    )
    return shown.unionByName(unread)
