"""What a file is that is no package but a compound file: encrypted, a legacy document, or damaged.

Only the header and the directory are read, by a walk along the sector chain that is bounded by the size of
the file; no stream is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed values of the format.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END_OF_CHAIN = 0xFFFFFFFE
HEADER_TABLES = 109
ENTRY_BYTES = 128
ENCRYPTED = ("EncryptedPackage", "EncryptionInfo")
LEGACY = {"WordDocument": "text document", "Workbook": "workbook", "Book": "workbook", "PowerPoint Document": "presentation"}


class Damaged(ValueError):
    pass


def problem(blob: bytes) -> str | None:
    """Why the file cannot be opened as a package, or null if it is no compound file either."""
    if blob[:8] != MAGIC:
        return None
    try:
        names = set(directory(blob))
    except (Damaged, struct.error, UnicodeDecodeError) as error:
        return f"damaged compound file: {error}"
    if any(name in names for name in ENCRYPTED):
        return "package is encrypted"
    for name, kind in LEGACY.items():
        if name in names:
            return f"legacy {kind}, not a package"
    return "compound file, not a package"


#: Bytes of a file that is no row which are looked at; a directory beyond them counts as damaged.
HEAD_BYTES = 64 << 20


def problem_of_file(file) -> str | None:
    """`problem` of an open file; only compound files are read beyond their first bytes."""
    return problem(file[0:HEAD_BYTES]) if file[0:8] == MAGIC else None


def directory(blob: bytes) -> Iterator[str]:
    """Names of the storages and streams of a compound file."""
    shift, n_tables, first, first_more = (
        struct.unpack_from("<H", blob, 30)[0],
        struct.unpack_from("<I", blob, 44)[0],
        struct.unpack_from("<I", blob, 48)[0],
        struct.unpack_from("<I", blob, 68)[0],
    )
    if shift not in (9, 12):
        raise Damaged(f"sector size of 2**{shift} bytes")
    size = 1 << shift
    n_sectors = len(blob) // size
    per_table = size // 4

    def sector(number: int) -> memoryview:
        at = (number + 1) * size
        if number >= n_sectors or at + size > len(blob):
            raise Damaged(f"sector {number} lies beyond the end")
        return memoryview(blob)[at : at + size]

    # Sectors of the allocation table: the first ones in the header, the others in a chain of their own.
    tables = [t for t in struct.unpack_from(f"<{HEADER_TABLES}I", blob, 76) if t < END_OF_CHAIN - 4]
    met: set[int] = set()
    while first_more < END_OF_CHAIN - 4 and len(tables) < n_tables:
        if first_more in met:
            raise Damaged("chain of allocation tables loops")
        met.add(first_more)
        *listed, first_more = struct.unpack(f"<{per_table}I", sector(first_more))
        tables += [t for t in listed if t < END_OF_CHAIN - 4]

    def following(number: int) -> int:
        if number // per_table >= len(tables):
            raise Damaged(f"sector {number} is in no allocation table")
        return struct.unpack_from("<I", sector(tables[number // per_table]), number % per_table * 4)[0]

    met = set()
    number = first
    while number != END_OF_CHAIN:
        if number in met:
            raise Damaged("chain of directory sectors loops")
        met.add(number)
        held = sector(number)
        for at in range(0, size, ENTRY_BYTES):
            length = struct.unpack_from("<H", held, at + 64)[0]
            if held[at + 66] and 2 <= length <= 64:
                yield bytes(held[at : at + length - 2]).decode("utf-16-le")
        number = following(number)
