"""Processing limits. They are part of the query semantics: they decide which rows exist."""

from __future__ import annotations

from dataclasses import dataclass

#: Stands for a limit that is off in comparisons.
ENDLESS = 1 << 62


def bound(limit: int | None) -> int:
    return ENDLESS if limit is None else limit


@dataclass(frozen=True)
class Limits:
    """None turns a limit off.

    What is over one of the first group is reported, as a diagnostics row or an error. Those of the
    second group cut results and are off unless a caller asks for them.
    """

    # Fixed values.
    entry_bytes: int | None = 32 * 1024 * 1024
    metadata_bytes: int | None = 4 * 1024 * 1024
    total_bytes: int | None = 256 * 1024 * 1024
    entry_count: int | None = 100_000
    path_depth: int | None = 64
    xml_bytes: int | None = 4 * 1024 * 1024
    json_bytes: int | None = 4 * 1024 * 1024
    image_side: int | None = 8192
    image_pixels: int | None = 16 * 1024 * 1024

    summary_lines: int | None = None
    summary_bytes: int | None = None
    summary_items: int | None = None
    text_chars: int | None = None
    shared_strings: int | None = None
    hex_bytes: int | None = None
    search_hits: int | None = None
    search_chars: int | None = None


DEFAULT = Limits()

# What fits a screen.
SCREEN = Limits(
    summary_lines=4096,
    summary_bytes=512 * 1024,
    summary_items=4096,
    text_chars=16 * 1024,
    shared_strings=16_384,
    hex_bytes=1024 * 1024,
    search_hits=4096,
    search_chars=256,
)
