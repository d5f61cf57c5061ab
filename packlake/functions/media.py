"""Part type predicates for previews, and image header fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from packlake.functions.paths import is_image_name, is_xml_content_type, is_xml_name, path_extension
from packlake.functions.text import ascii_lower, col, is_probably_text, utf8_text
from packlake.limits import DEFAULT, Limits, bound

# Fixed values.
FONT_EXTENSIONS = ["ttf", "otf", "woff", "woff2", "eot"]
MEDIA_EXTENSIONS = ["mp3", "wav", "m4a", "aac", "ogg", "mp4", "avi", "mov", "wmv", "mkv"]
FALLBACK_MIME = {
    "ttf": "font/ttf",
    "otf": "font/otf",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "mp4": "video/mp4",
    "avi": "video/x-msvideo",
}
DEFAULT_MIME = "application/octet-stream"


def _typed(content_type: Column | str) -> Column:
    return F.coalesce(ascii_lower(content_type), F.lit(""))


def is_json(name, content_type) -> Column:
    """By extension or type; parameters of the type are not stripped."""
    kind = _typed(content_type)
    return (path_extension(name) == "json") | (kind == "application/json") | kind.endswith("+json")


def is_bin(name) -> Column:
    return path_extension(name) == "bin"


def is_font(name, content_type) -> Column:
    return path_extension(name).isin(FONT_EXTENSIONS) | _typed(content_type).contains("font")


def is_media(name, content_type) -> Column:
    kind = _typed(content_type)
    return (
        path_extension(name).isin(MEDIA_EXTENSIONS)
        | kind.startswith("audio/")
        | kind.startswith("video/")
    )


def is_ole(name, content_type) -> Column:
    kind, path = _typed(content_type), ascii_lower(name)
    by_type = kind.contains("ole") | kind.contains("vba") | kind.contains("ms-office")
    return by_type | path.contains("oleobject") | path.contains("vbaproject")


def is_xml(name, content_type) -> Column:
    return is_xml_name(name) | F.coalesce(is_xml_content_type(content_type), F.lit(False))


def info_category(name, content_type) -> Column:
    return (
        F.when(is_ole(name, content_type), "OLE/VBA object")
        .when(is_font(name, content_type), "Font")
        .when(is_media(name, content_type), "Media")
        .otherwise("Binary data")
    )


def preview_kind(name, content_type, content) -> Column:
    """How a part is shown; the first rule that holds decides. Images go by name alone."""
    text = utf8_text(content)
    described = (
        is_ole(name, content_type) | is_font(name, content_type) | is_media(name, content_type)
    )
    return (
        F.when(is_image_name(name), "Image")
        .when(is_xml(name, content_type), "Xml")
        .when(is_json(name, content_type), F.when(text.isNotNull(), "Json").otherwise("Error"))
        .when(described, "Info")
        .when(is_bin(name), "Hex")
        .when(text.isNotNull() & is_probably_text(text), "PlainText")
        .otherwise("Info")
    )


def fallback_mime(name) -> Column:
    extension = path_extension(name)
    out = F.lit(DEFAULT_MIME)
    for known, mime in FALLBACK_MIME.items():
        out = F.when(extension == known, mime).otherwise(out)
    return out


def binary_info(name, category, content_type, size, compressed_size) -> Column:
    """The text report for parts that are not rendered."""
    mime = F.coalesce(col(content_type), fallback_mime(name))
    return F.format_string(
        "Binary file\n\nName:       %s\nCategory:   %s\nMIME type:  %s\nSize:       %d bytes\n"
        "Compressed: %d bytes\n\nRaw bytes are not rendered for this file type.",
        col(name),
        col(category),
        mime,
        col(size),
        col(compressed_size),
    )


def hex_lines(content, limits: Limits = DEFAULT) -> Column:
    """Array of dump lines: offset, 16 bytes in two groups, printable characters."""
    content = col(content).cast("binary")
    shown = F.least(F.octet_length(content), F.lit(min(bound(limits.hex_bytes), 2**31 - 1)))

    # Digits and characters are made once for all bytes, and kept as bytes, of which a line takes its slice.
    head = F.substring(content, F.lit(1), shown)
    made = F.struct(
        F.regexp_replace(F.lower(F.hex(head)), "(..)", "$1 ").cast("binary").alias("digits"),
        F.regexp_replace(F.decode(head, "ISO-8859-1"), "(?s)[^ -~]", ".").cast("binary").alias("printable"),
    )

    def dump(whole: Column, at: Column) -> Column:
        return F.concat(
            F.lower(F.lpad(F.hex(at), 8, "0")),
            F.lit("  "),
            F.rpad(F.substring(whole["digits"], at * 3 + 1, F.lit(24)).cast("string"), 24, " "),
            F.lit(" "),
            F.rpad(F.substring(whole["digits"], at * 3 + 25, F.lit(24)).cast("string"), 24, " "),
            F.lit(" |"),
            F.substring(whole["printable"], at + 1, F.lit(16)).cast("string"),
            F.lit("|"),
        )

    starts = F.sequence(F.lit(0), shown - 1, F.lit(16))
    lines = F.get(F.transform(F.array(made), lambda whole: F.transform(starts, lambda at: dump(whole, at))), F.lit(0))
    return F.when(shown > 0, lines).otherwise(F.array().cast("array<string>"))


def truncation_notice(content, limits: Limits = DEFAULT) -> Column:
    """Notice for a dump that does not show all bytes; null if it does."""
    size = F.octet_length(col(content).cast("binary"))
    return F.when(
        size > bound(limits.hex_bytes),
        F.concat(
            F.lit(f"[preview truncated: showing {limits.hex_bytes} of "),
            size.cast("string"),
            F.lit(" bytes]"),
        ),
    )


# Image headers ------------------------------------------------------------------------------


def _number(content: Column, *positions: int) -> Column:
    """Unsigned number of the bytes at `positions` (0-based), most significant first."""
    digits = F.concat(*[F.hex(F.substring(content, p + 1, 1)) for p in positions])
    return F.conv(digits, 16, 10).cast("bigint")


def _magic(content: Column, at: int, value: bytes) -> Column:
    return F.substring(content, at + 1, len(value)) == F.lit(value)


def _frame_sizes(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_frame_size(c) for c in contents], columns=["width", "height"]).astype(
        "Int64"
    )


def _frame_size(data: bytes | None) -> tuple[int | None, int | None]:
    """Walk the JPEG segments to the frame header."""
    at = 2
    while data is not None and at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return None, None


def image_format(name) -> Column:
    """Decoder by file name; PNG where the extension tells none."""
    extension = path_extension(name)
    return (
        F.when(extension.isin("jpg", "jpeg"), "Jpeg")
        .when(extension == "gif", "Gif")
        .when(extension == "bmp", "Bmp")
        .when(extension == "webp", "WebP")
        .otherwise("Png")
    )


def image_size(form: Column, content: Column, jpeg: Column) -> Column:
    """Struct (width, height) from the header; null if the header is not of that format."""
    c = content

    def size(width: Column, height: Column) -> Column:
        return F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))

    signed = lambda n: F.when(n >= 2**31, 2**32 - n).otherwise(n)
    lossless = _number(c, 24, 23, 22, 21)
    return (
        F.when(
            (form == "Png") & _magic(c, 0, b"\x89PNG\r\n\x1a\n") & _magic(c, 12, b"IHDR"),
            size(_number(c, 16, 17, 18, 19), _number(c, 20, 21, 22, 23)),
        )
        .when(
            (form == "Gif") & (_magic(c, 0, b"GIF87a") | _magic(c, 0, b"GIF89a")),
            size(_number(c, 7, 6), _number(c, 9, 8)),
        )
        .when(
            (form == "Bmp") & _magic(c, 0, b"BM") & (_number(c, 17, 16, 15, 14) == 12),
            size(_number(c, 19, 18), _number(c, 21, 20)),
        )
        .when(
            (form == "Bmp") & _magic(c, 0, b"BM"),
            size(_number(c, 21, 20, 19, 18), signed(_number(c, 25, 24, 23, 22))),
        )
        .when(
            (form == "WebP") & _magic(c, 8, b"WEBPVP8X"),
            size(_number(c, 26, 25, 24) + 1, _number(c, 29, 28, 27) + 1),
        )
        .when(
            (form == "WebP") & _magic(c, 8, b"WEBPVP8L"),
            size(
                lossless.bitwiseAND(F.lit(0x3FFF)) + 1,
                F.shiftright(lossless, 14).bitwiseAND(F.lit(0x3FFF)) + 1,
            ),
        )
        .when(
            (form == "WebP") & _magic(c, 8, b"WEBPVP8 "),
            size(
                _number(c, 27, 26).bitwiseAND(F.lit(0x3FFF)),
                _number(c, 29, 28).bitwiseAND(F.lit(0x3FFF)),
            ),
        )
        .when((form == "Jpeg") & jpeg["width"].isNotNull(), jpeg)
    )


def jpeg_size(name, content) -> Column:
    """Only JPEG contents are sent to Python."""
    content = col(content).cast("binary")
    wanted = (image_format(name) == "Jpeg") & _magic(content, 0, b"\xff\xd8")
    size = F.pandas_udf(_frame_sizes, "struct<width:bigint,height:bigint>")
    return size(F.when(wanted, content))
