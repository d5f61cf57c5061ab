"""Package sources: files (or stored blobs) to archive entries.

A package is one row `(package, content BINARY)`. Opening it stays inside the task that read
it; entry bytes are inflated only for the entries a query asks for, because column pruning
cannot reach into the Python scan.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlake.functions.paths import normalize_path
from packlake.limits import DEFAULT, Limits, bound
from packlake.operators.folds import ascii_lower, attribute
from packlake.operators.shred import SMALL_BYTES, SMALL_ENTRIES, tokens_of
from packlake.session import staged
from packlake.sources import compound

PACKAGE_GLOB = "*.{pptx,docx,xlsx}"
# Requests up to which they are sent to all tasks: some 100 MB.
BROADCAST_PACKAGES, BROADCAST_REQUESTS = 500_000, 5_000_000
# Fixed value: the largest file that the scan can hand on as one row.
MAX_FILE_BYTES = 2**31 - 1 - 1024
NO_MARKUP = "malformed XML: no element found"
TOO_LARGE = "package is too large to open"
# Deflated size up to which an entry is inflated before its first byte is looked at.
SMALL_ENTRY_BYTES = 1 << 15
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "bmp", "webp")
MARKUP_STARTS = {bytes([b]) for b in b"<\xef\xff\xfe \t\n\r"}

ENTRY_SCHEMA = (
    "package string, ord int, archive_name string, is_dir boolean, size bigint, "
    "compressed_size bigint, content binary, read_error string, copy int"
)
_ARROW_ENTRY = pa.schema(
    [
        ("package", pa.string()),
        ("ord", pa.int32()),
        ("archive_name", pa.string()),
        ("is_dir", pa.bool_()),
        ("size", pa.int64()),
        ("compressed_size", pa.int64()),
        ("content", pa.binary()),
        ("read_error", pa.string()),
        ("copy", pa.int32()),
    ]
)
_FLUSH_BYTES = 16 * 1024 * 1024
_FLUSH_ROWS = 4096
_FLUSH_HITS = 200_000
_INT64 = 2**63 - 1


def scan_packages(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = MAX_FILE_BYTES,
    glob: str = PACKAGE_GLOB,
    fmt: str = "binaryFile",
) -> DataFrame:
    """Package files as rows `(package, length, content)`.

    `fmt="binaryFile"` reads a folder tree of files; `fmt="parquet"` reads a dataset of
    `(package, content)` rows, the better container for very many small packages. A package of
    more than `max_bytes` has a row without content, which `explode_packages` reports; by default
    that is what one row can hold.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path).withColumn("length", F.octet_length("content").cast("bigint"))
    else:
        df = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true")
            .load(path)
            .withColumnRenamed("path", "package")
        )
    df = df.select("package", "length", "content")
    if max_bytes is None:
        return df
    # The content of large files is not even read: that column is pruned from their scan.
    large = df.filter(F.col("length") > max_bytes).select(
        "package", "length", F.lit(None).cast("binary").alias("content")
    )
    return df.filter(F.col("length") <= max_bytes).unionByName(large)


class Ranges:
    """An open file as something to slice; each slice is one read. Counts the bytes it has read."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0

    def __getitem__(self, at: slice) -> bytes:
        self.file.seek(at.start)
        return self.read(max(0, at.stop - at.start))

    # What the ZIP directory reader needs.
    def read(self, n: int = -1) -> bytes:
        data = self.file.read() if n < 0 else self.file.read(n)
        self.bytes_read += len(data)
        return data

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            self.file.seek(at, whence)
        except ValueError as error:  # some file systems say so of a place before the start
            raise OSError(str(error)) from error
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True


def _raw_entry(blob: bytes | Ranges, info: zipfile.ZipInfo) -> bytes | memoryview:
    at = info.header_offset
    head = blob[at : at + 30]
    if head[:4] != b"PK\x03\x04":
        raise ValueError("invalid local file header")
    name_len, extra_len = struct.unpack("<HH", head[26:30])
    start = at + 30 + name_len + extra_len
    whole = memoryview(blob) if isinstance(blob, bytes) else blob
    return whole[start : start + info.compress_size]


def read_prefix(blob: bytes, info: zipfile.ZipInfo, limit: int) -> bytes | None:
    """The first `limit` bytes of an entry, as far as they can be had; for searching."""
    if info.flag_bits & 1:
        return None
    try:
        raw = _raw_entry(blob, info)
        if info.compress_type == zipfile.ZIP_STORED:
            return bytes(raw[:limit])
        if info.compress_type == zipfile.ZIP_DEFLATED:
            return zlib.decompressobj(-15).decompress(raw, limit)
    except (ValueError, zlib.error, struct.error):
        pass
    return None


def bounded_read(
    blob: bytes | Ranges, info: zipfile.ZipInfo, limit: int
) -> tuple[bytes | None, str | None]:
    """Entry bytes, or why they cannot be had. The declared size is tested, then not trusted."""
    if info.file_size > limit:
        return None, f"entry declares {info.file_size} bytes; limit is {limit}"
    if info.flag_bits & 1:
        return None, "entry is encrypted"
    try:
        raw = _raw_entry(blob, info)
        if info.compress_type == zipfile.ZIP_STORED:
            data = bytes(raw[: limit + 1])
        elif info.compress_type == zipfile.ZIP_DEFLATED:
            inflater = zlib.decompressobj(-15)
            data = inflater.decompress(raw, limit + 1)
            if not inflater.eof and len(data) <= limit:
                data += inflater.flush()
                if not inflater.eof:
                    return None, "unexpected end of compressed data"
        else:
            return None, f"unsupported compression method {info.compress_type}"
    except (ValueError, zlib.error, struct.error) as error:
        return None, str(error)
    if len(data) > limit:
        return None, f"entry exceeds {limit} byte read limit"
    if zlib.crc32(data) != info.CRC:
        return None, "invalid checksum"
    return data, None


def _starts_like_markup(blob: bytes, info: zipfile.ZipInfo) -> bool:
    """Looks at the first byte only: none, `<`, white space or a byte order mark."""
    try:
        raw = _raw_entry(blob, info)
        if info.compress_type == zipfile.ZIP_DEFLATED:
            raw = zlib.decompressobj(-15).decompress(raw, 1)
        return not raw or bytes(raw[:1]) in MARKUP_STARTS
    except (ValueError, zlib.error, struct.error):
        return True  # the full read says what is wrong


def _markup_read(blob: bytes, info: zipfile.ZipInfo, limit: int) -> tuple[bytes | None, str | None]:
    """`bounded_read` of an entry that can be XML by its first byte. Small entries are inflated once for both."""
    if info.compress_size <= SMALL_ENTRY_BYTES:
        content, problem = bounded_read(blob, info, limit)
        if problem is None:
            return (content, None) if not content or content[:1] in MARKUP_STARTS else (None, NO_MARKUP)
    return bounded_read(blob, info, limit) if _starts_like_markup(blob, info) else (None, NO_MARKUP)


def _is_metadata(name: str) -> bool:
    lowered = name.lower()
    return lowered.endswith(".rels") or "[content_types].xml" in lowered


def _clean_name(name: str) -> str:
    """Same rule as `functions.paths.normalize_path`."""
    pieces: list[str] = []
    for piece in name.replace("\\", "/").split("/"):
        if piece == "..":
            pieces[-1:] = []
        elif piece not in ("", "."):
            pieces.append(piece)
    return "/".join(pieces)


class ContentTypes:
    """The content types that a package declares for its parts; the rules of `operators.index`."""

    NAME = "[content_types].xml"

    def __init__(self, declared: bytes | None):
        self.defaults: dict[str, str] = {}
        self.overrides: dict[str, str] = {}
        for local, attrs in tokens_of(declared or b"", ("Default", "Override")):
            typ = attribute(attrs, "ContentType")
            name = attribute(attrs, "Extension" if local == "Default" else "PartName")
            if typ is None or name is None:
                continue
            if local == "Default":
                self.defaults[ascii_lower(name)] = typ
            else:
                self.overrides["/" + _clean_name(name)] = typ

    @classmethod
    def of_package(cls, blob: bytes, infos: list[zipfile.ZipInfo], cap: int) -> ContentTypes:
        """Of the last entry of that name which can be read, in whatever case."""
        for info in reversed(infos):
            if ascii_lower(_clean_name(info.orig_filename)) == cls.NAME:
                declared, problem = bounded_read(blob, info, cap)
                if problem is None:
                    return cls(declared)
        return cls(None)

    def of(self, path: str) -> str | None:
        ending = ascii_lower(path.rsplit(".", 1)[-1])
        return self.overrides[path] if path in self.overrides else self.defaults.get(ending)


def is_markup(name: str, content_type: str | None) -> bool:
    """Whether a part is shown as XML: by its name, or by its type if its name is not that of an image."""
    stem, dot, ending = name.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1].rpartition(".")
    ending = ascii_lower(ending) if dot and stem else ""
    kind = ascii_lower((content_type or "").split(";", 1)[0].strip())
    typed = kind in ("application/xml", "text/xml") or kind.endswith("+xml")
    return ending not in IMAGE_ENDINGS and (ending in ("xml", "rels") or typed)


def _over_limits(infos: list[zipfile.ZipInfo], limits: Limits) -> str | None:
    if len(infos) > bound(limits.entry_count):
        return f"archive has {len(infos)} entries; limit is {limits.entry_count}"
    if sum(info.file_size for info in infos) > bound(limits.total_bytes):
        return f"declared uncompressed size exceeds {limits.total_bytes} bytes"
    return None


def explode_packages(
    packages: DataFrame,
    with_content: bool = False,
    only_markup: bool = False,
    parts: str | None = None,
    limits: Limits = DEFAULT,
    limit: int | None = None,
    typed: str | None = None,
) -> DataFrame:
    """One row per archive entry, in archive order.

    `copy` counts the earlier entries of the same normalised path. The task has the whole
    package at hand, so this saves the index every shuffle of entries.

    `parts` names an `ARRAY<INT>` column of `packages` with the entry positions to inflate;
    without it all entries are inflated if `with_content`, else only the metadata parts.
    `only_markup` leaves media and other entries that cannot be XML by their first byte packed.
    `typed` adds the column `content_type`, resolved in the task that has the package, and is "markup",
    "other" or "all": entries that are shown as XML, those that are not, or both; the rest is not inflated.
    A container that cannot be opened, has no content, or is over the archive limits (tested before anything is
    inflated), gives one row with `ord = -1` and `read_error`. So a package has at most
    `limits.entry_count` entries from here on.
    """
    cap = min(bound(limit), bound(limits.entry_bytes))
    metadata_cap = min(bound(limits.metadata_bytes), bound(limits.entry_bytes))
    columns = ["package", "content"] + ([parts] if parts else [])

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        untyped = (None,) if typed else ()
        for batch in batches:
            wanted_column = batch.column(2) if parts else None
            for row in range(batch.num_rows):
                package = batch.column(0)[row].as_py()
                blob = batch.column(1)[row].as_py()
                if blob is None:
                    rows.append((package, -1, None, False, 0, 0, None, TOO_LARGE, 0) + untyped)
                    continue
                wanted = set(wanted_column[row].as_py() or ()) if parts else None
                try:
                    infos = zipfile.ZipFile(io.BytesIO(blob)).infolist()
                    problem = _over_limits(infos, limits)
                except Exception as error:  # any damage ends as a diagnostic, never as a failed job
                    infos, problem = [], compound.problem(blob) or str(error)
                if problem is not None:
                    rows.append((package, -1, None, False, 0, 0, None, problem, 0) + untyped)
                    continue
                seen: Counter[str] = Counter()
                types = ContentTypes.of_package(blob, infos, metadata_cap) if typed else None
                for ord_, info in enumerate(infos):
                    name = info.orig_filename
                    content = read_error = content_type = None
                    is_dir = name.endswith(("/", "\\"))
                    path = _clean_name(name)
                    if types is not None:
                        content_type = types.of(f"/{path}")
                        if typed != "all" and is_markup(name, content_type) != (typed == "markup"):
                            seen[path] += 1
                            continue
                    if wanted is not None:
                        if ord_ in wanted:
                            content, read_error = bounded_read(blob, info, cap)
                    elif with_content and not is_dir:
                        content, read_error = (_markup_read if only_markup else bounded_read)(blob, info, cap)
                    elif not with_content and _is_metadata(name):
                        content, read_error = bounded_read(blob, info, metadata_cap)
                    held += len(content or b"")
                    rows.append(
                        (
                            package,
                            ord_,
                            name,
                            is_dir,
                            info.file_size,
                            min(info.compress_size, _INT64),
                            content,
                            read_error,
                            seen[path],
                        )
                        + ((content_type,) if typed else ())
                    )
                    seen[path] += 1
                    if held >= _FLUSH_BYTES or len(rows) >= _FLUSH_ROWS:
                        yield _entry_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _entry_batch(rows)

    schema = f"{ENTRY_SCHEMA}, content_type string" if typed else ENTRY_SCHEMA
    return packages.select(*columns).mapInArrow(unzip, schema)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    typed = len(rows[0]) > len(_ARROW_ENTRY)
    schema = _ARROW_ENTRY.append(pa.field("content_type", pa.string())) if typed else _ARROW_ENTRY
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: UTF-8 bytes of needles that one pass looks for; more are looked for in several passes.
NEEDLE_BYTES = 16 << 20


class Needles:
    """Byte strings, found together in one pass over some bytes: an automaton over all of them."""

    def __init__(self, needles: list[str]):
        import ahocorasick

        self.needles = needles
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, needle in enumerate(needles):
            # A character for each byte, so that UTF-8 is searched byte for byte.
            self.automaton.add_word(needle.encode().decode("latin-1"), number)
        self.automaton.make_automaton()

    def inside(self, content: bytes) -> list[str]:
        """The needles that `content` holds, overlapping ones and those within others too."""
        met: set[int] = set()
        if not self.needles:
            return []
        for _, number in self.automaton.iter(content.decode("latin-1")):
            met.add(number)
        return [self.needles[number] for number in sorted(met)]


def _passes(needles: list[str], most: int) -> list[list[str]]:
    passes: list[list[str]] = [[]]
    size = 0
    for needle in needles:
        size += len(needle.encode())
        if passes[-1] and size > most:
            passes.append([])
            size = len(needle.encode())
        passes[-1].append(needle)
    return passes


def search_packages(
    packages: DataFrame, needles: list[str], limits: Limits = DEFAULT, needle_bytes: int = NEEDLE_BYTES
) -> DataFrame:
    """`(package, needle, path)`: the parts of packages that hold a needle, byte for byte; `part_needles` by rows."""
    found = part_needles(packages, needles, limits, needle_bytes).select(
        "package", F.explode("needles").alias("needle"), "path"
    )
    if limits.search_hits is None:
        return found
    w = Window.partitionBy("package", "needle").orderBy("path")
    ranked = found.withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") <= limits.search_hits).drop("_rank")


def part_needles(
    packages: DataFrame, needles: list[str], limits: Limits = DEFAULT, needle_bytes: int = NEEDLE_BYTES
) -> DataFrame:
    """`(package, path, needles)`: all needles that a part holds, byte for byte, of parts with any.

    Entries are inflated one at a time in the task that has the package, the first entry of a path
    counts, and only hits leave the task, a row for each part. An entry that declares more than
    `limits.entry_bytes` is not read; of one that turns out larger, the bytes up to that limit are searched.
    The needles are looked for together, so a pass costs about the same for one and for ten thousand; those of
    more than `needle_bytes` are dealt out to several passes, whose hits are then brought together by part.
    Empty needles find nothing, repeated ones count once.
    """
    usable = list(dict.fromkeys(n for n in needles if n))
    if too_long := [n for n in usable if len(n) > bound(limits.search_chars)]:
        raise ValueError(f"needle of {len(too_long[0])} characters; limit is {limits.search_chars}")
    cap = bound(limits.entry_bytes)

    def hits(blob: bytes, wanted: Needles) -> Iterator[tuple[str, list[str]]]:
        try:
            infos = zipfile.ZipFile(io.BytesIO(blob)).infolist()
        except Exception:  # the index reports it
            return
        if _over_limits(infos, limits) is not None:
            return
        seen: set[str] = set()
        for info in infos:
            name = info.orig_filename
            path = _clean_name(name)
            if not path or path in seen or path.count("/") > bound(limits.path_depth):
                continue
            seen.add(path)
            if name.endswith(("/", "\\")) or info.file_size > cap:
                continue
            if met := wanted.inside(read_prefix(blob, info, cap) or b""):
                yield f"/{path}", met

    def one_pass(chosen: list[str]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = Needles(chosen)
            found, held = [], 0
            for batch in batches:
                for row in range(batch.num_rows):
                    package = batch.column(0)[row].as_py()
                    for path, met in hits(batch.column(1)[row].as_py() or b"", wanted):
                        found.append((package, path, met))
                        held += len(met)
                        if held >= _FLUSH_HITS:
                            yield _hit_batch(found)
                            found, held = [], 0
            if found:
                yield _hit_batch(found)

        return packages.select("package", "content").mapInArrow(
            search, "package string, path string, needles array<string>"
        )

    found, *more = map(one_pass, _passes(usable, needle_bytes))
    if not more:
        return found
    for other in more:
        found = found.unionByName(other)
    return found.groupBy("package", "path").agg(F.flatten(F.collect_list("needles")).alias("needles"))


def _hit_batch(found: list[tuple[str, str, list[str]]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*found), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["package", "path", "needles"])


def package_errors(entries: DataFrame) -> DataFrame:
    """Containers that could not be opened or are over the limits."""
    return entries.filter(F.col("ord") < 0).select(
        "package", F.col("read_error").alias("message")
    )


def read_part(
    packages: DataFrame,
    parts: DataFrame,
    requests: DataFrame,
    limits: Limits = DEFAULT,
    limit: int | None = None,
) -> DataFrame:
    """Bytes of the requested `(package, path)` parts; an unknown part gives an error row.

    Requests of one package are grouped (an archive has at most `limits.entry_count` entries), so
    each package is opened once and only the asked entries are inflated, where the package is read.
    The groups are sent to the packages when counted to be few enough; only a larger number of
    packages is joined by a shuffle. Inflated bytes are not moved: their path is that of the entry.
    """
    asked = requests.select("package", "path").distinct()
    at = asked.join(parts.select("package", "path", "ord"), ["package", "path"], "left")
    located = staged(at, "requests")
    wanted = staged(
        located.filter(F.col("ord").isNotNull())
        .groupBy("package")
        .agg(F.collect_list(F.col("ord").cast("int")).alias("wanted")),
        "requests",
    )
    if wanted.count() <= BROADCAST_PACKAGES and located.count() <= BROADCAST_REQUESTS:
        wanted = F.broadcast(wanted)
    found = explode_packages(
        packages.select("package", "content").join(wanted, "package"),
        parts="wanted",
        limits=limits,
        limit=limit,
    ).filter((F.col("ord") >= 0) & (F.col("content").isNotNull() | F.col("read_error").isNotNull()))
    missing = located.filter(F.col("ord").isNull()).select(
        "package",
        "path",
        F.lit(None).cast("binary").alias("content"),
        F.concat(F.lit("part not found: "), F.col("path")).alias("read_error"),
    )
    path = F.concat(F.lit("/"), normalize_path("archive_name")).alias("path")
    return found.select("package", path, "content", "read_error").unionByName(missing)


def _deflated(content: str | bytes) -> tuple[int, int, bytes]:
    """Checksum, size and deflated bytes."""
    data = content.encode() if isinstance(content, str) else content
    deflater = zlib.compressobj(1, zlib.DEFLATED, -15)
    return zlib.crc32(data), len(data), deflater.compress(data) + deflater.flush()


def _zip_of(names: list[str], contents: list[str | bytes], small: Callable) -> bytes:
    """A package of these entries; `small` is `_deflated` that remembers, for entries that many packages share.

    A fixed date keeps the bytes the same on every run.
    """
    out, directory, at = [], [], 0
    for name, content in zip(names, contents, strict=True):
        crc, size, data = (small if len(content) <= SMALL_BYTES else _deflated)(content)
        raw = name.encode()
        # What the local header and the directory share: version 2.0, name in UTF-8 if need be, deflated, 1980-01-01.
        shared = struct.pack(
            "<HHHHHIIIHH", 20, 0 if name.isascii() else 0x800, 8, 0, 33, crc, len(data), size, len(raw), 0
        )
        out += (b"PK\x03\x04", shared, raw, data)
        directory += (b"PK\x01\x02\x14\x03", shared, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), raw)
        at += 30 + len(raw) + len(data)
    tail = b"".join(directory)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, len(names), len(names), len(tail), at, 0)
    return b"".join((*out, tail, end))


def pack_zip(files: DataFrame) -> DataFrame:
    """Rows `(package, files ARRAY<STRUCT<name, content>>)` to package blobs.

    Used to make packages out of tables; each row is packed where it is. Entries that packages have in common
    are deflated once in a task. A package has less than 65,536 entries and, as a row, less than 2 GiB.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = lru_cache(SMALL_ENTRIES)(_deflated)
        for batch in batches:
            lists = batch.column(1)
            entries = lists.flatten()
            names, contents = (entries.field(name).to_pylist() for name in ("name", "content"))
            blobs, at = [], 0
            for n in lists.value_lengths().to_pylist():
                blobs.append(_zip_of(names[at : at + (n or 0)], contents[at : at + (n or 0)], small))
                at += n or 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(blobs, pa.binary())], names=["package", "content"]
            )

    return files.select("package", "files").mapInArrow(pack, "package string, content binary")
