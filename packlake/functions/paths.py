"""Column expressions over archive names and part paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlake.functions.text import ascii_lower, col

# Extensions that decide the kind of a part.
XML_EXTENSIONS = ["xml", "rels"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "webp"]

KIND_LABELS = {
    "Xml": "XML",
    "Image": "Image",
    "Binary": "Binary/unsupported",
    "Directory": "Directory",
}


def normalize_path(c: Column | str) -> Column:
    """Use `/`, drop empty and `.` components, let `..` pop; no leading slash.

    Most names are clean already: one regular expression tells them, and only the others are
    folded component by component.
    """
    c = col(c)
    empty = F.lit("")

    def add(path: Column, piece: Column) -> Column:
        last = F.char_length(F.substring_index(path, "/", -1))
        return (
            F.when(piece.isin("", "."), path)
            .when(piece == "..", F.substring(path, F.lit(1), F.char_length(path) - last - 1))
            .otherwise(F.concat(path, F.lit("/"), piece))
        )

    pieces = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    folded = F.substring(F.aggregate(pieces, empty, add), 2, 2**31 - 1)
    dirty = F.rlike(c, F.lit(r"\\|(^|/)\.{0,2}(/|\z)"))
    return F.when(dirty, folded).otherwise(c)


def unsafe_name(c: Column | str) -> Column:
    c = col(c)
    return F.rlike(c, F.lit(r"(^|/)\.\.(/|\z)")) | c.startswith("/") | c.contains("\\")


def path_depth(c: Column | str) -> Column:
    """Number of components of a normalised path."""
    c = col(c)
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("/"), F.lit(""))) + 1


def path_extension(c: Column | str) -> Column:
    """ASCII-lowercased extension of the file name; '' if there is none.

    A file name that starts with its only dot (`.rels`) has no extension.
    """
    bare = F.regexp_replace(col(c), r"(?:/+\.?)+\z", "")
    return ascii_lower(F.regexp_extract(bare, r"(?s)[^/]\.([^./]*)\z", 1))


def is_xml_name(c: Column | str) -> Column:
    return path_extension(c).isin(XML_EXTENSIONS)


def is_image_name(c: Column | str) -> Column:
    return path_extension(c).isin(IMAGE_EXTENSIONS)


def classify_kind(archive_name: Column | str, is_dir: Column | str) -> Column:
    return (
        F.when(col(is_dir), "Directory")
        .when(is_xml_name(archive_name), "Xml")
        .when(is_image_name(archive_name), "Image")
        .otherwise("Binary")
    )


def is_xml_content_type(c: Column | str) -> Column:
    """`application/xml`, `text/xml` or `…+xml`; parameters after `;` are ignored."""
    head = F.regexp_replace(F.substring_index(col(c), ";", 1), r"(?U)\A\s+|\s+\z", "")
    value = ascii_lower(head)
    return value.isin("application/xml", "text/xml") | value.endswith("+xml")


def refine_kind(kind: Column | str, content_type: Column | str) -> Column:
    """The declared content type decides where the extension could not."""
    kind, content_type = col(kind), col(content_type)
    return (
        F.when(kind != "Binary", kind)
        .when(is_xml_content_type(content_type), "Xml")
        .when(ascii_lower(content_type).startswith("image/"), "Image")
        .otherwise(kind)
    )


def kind_label(kind: Column | str) -> Column:
    kind = col(kind)
    out = F.lit(None).cast("string")
    for value, label in KIND_LABELS.items():
        out = F.when(kind == value, label).otherwise(out)
    return out


def extension_label(path: Column | str, is_directory: Column | str) -> Column:
    """Type label from the extension alone (content types are not looked at)."""
    return (
        F.when(col(is_directory), "Directory")
        .when(is_xml_name(path), "XML")
        .when(is_image_name(path), "Image")
        .otherwise("Binary/unsupported")
    )


def default_extension(path: Column | str) -> Column:
    """Lookup key of a default content type: what follows the last dot of the whole path."""
    return ascii_lower(F.substring_index(col(path), ".", -1))


def relationship_source(path: Column | str) -> Column:
    """The part a relationships part describes; null if the name tells none.

    `path` is normalised, without leading slash.
    """
    path = col(path)
    root_name = F.regexp_extract(path, r"(?s)\A_rels/(.*)\.rels\z", 1)
    directory = F.regexp_extract(path, r"(?s)\A(.*)/_rels/(.*)\.rels\z", 1)
    name = F.regexp_extract(path, r"(?s)\A(.*)/_rels/(.*)\.rels\z", 2)
    return (
        F.when(path == "_rels/.rels", "/")
        .when(
            path.startswith("_rels/"),
            F.when(path.endswith(".rels"), F.concat(F.lit("/"), normalize_path(root_name))),
        )
        .when(
            path.contains("/_rels/") & path.endswith(".rels"),
            F.concat(F.lit("/"), directory, F.lit("/"), name),
        )
    )


def resolve_target(source: Column | str, target: Column | str) -> Column:
    """Absolute path of an internal target, relative to the folder of `source`."""
    source, target = col(source), col(target)
    folder = F.regexp_extract(source, r"(?s)\A(.*)/", 1)
    combined = F.when(target.startswith("/"), target).otherwise(
        F.concat(folder, F.lit("/"), target)
    )
    return F.concat(F.lit("/"), normalize_path(combined))


def ancestors(path: Column | str) -> Column:
    """`/a`, `/a/b`, `/a/b/c` for `/a/b/c`."""
    whole = F.concat(F.lit("/"), F.ltrim(col(path), F.lit("/")))
    n = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("/"), F.lit("")))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", whole, F.lit("/"), i + 1))


def type_label(relationship_type: Column | str) -> Column:
    return F.substring_index(col(relationship_type), "/", -1)
