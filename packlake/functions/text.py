"""Column expressions over text and bytes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lowercase A-Z only; `lower` would fold all of Unicode."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def equals_ascii_ci(c: Column | str, value: str) -> Column:
    return ascii_lower(c) == F.lit(value.lower())


def prefix(c: Column | str, cap: int | None) -> Column:
    """First `cap` characters; all without a cap."""
    return col(c) if cap is None else F.substring(col(c), 1, cap)


def clean_text(c: Column | str, cap: int | None = None) -> Column:
    """Collapse runs of Unicode whitespace to one space, strip, cap in characters if asked."""
    return prefix(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), cap)


def compact_text(c: Column | str, n: int) -> Column:
    """First `n` characters, with an ellipsis when something was cut."""
    c = col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def byte_prefix(c: Column | str, n: Column | int) -> Column:
    """Longest prefix of at most `n` UTF-8 bytes that ends on a character boundary."""
    raw = col(c).cast("binary")
    n = F.lit(n) if isinstance(n, int) else n
    cuts = [
        F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n - k, F.lit(0))).cast("string"))
        for k in range(4)
    ]
    return F.coalesce(*cuts)


def utf8_text(content: Column | str) -> Column:
    """Strictly decoded text without a leading byte order mark; null if not UTF-8."""
    text = F.try_validate_utf8(col(content).cast("string"))
    return F.regexp_replace(text, r"\A\x{FEFF}", "")


def is_probably_text(text: Column | str) -> Column:
    """No control characters but newline, carriage return and tab."""
    return ~F.rlike(col(text), F.lit(r"[\p{Cc}&&[^\n\r\t]]"))


def lines_before(c: Column | str) -> Column:
    """Number of newline characters in `c`."""
    c = col(c)
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
