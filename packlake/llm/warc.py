"""WARC archives: writing, a normaliser of monolithic gzip files, and reading by a sidecar index.

An archive compressed as one gzip stream can only be read from its start. The normaliser inflates such a
file once, front to back, rewrites every record as a gzip member of its own, and writes next to it an
index of (offset, length, record id), so that records can be fetched one by one.

Files are handled in tasks through pyarrow's file systems, in the folder the cluster shares. A task
writes under a name of its own and then moves the file to its place; the content depends on the rows
alone, so a task that runs again puts the same file there.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.session import shared_dir, staged

CHUNK = 1 << 20
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMESPACE = uuid.UUID("6f0f6d4e-5d0b-4c43-9d8d-5f2b6f3f8f10")
GZIP = 16 + zlib.MAX_WBITS


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END + block + END


def page_record(page_id, url, payload: bytes, refers_to, key: str) -> bytes:
    """A response, or if `refers_to` is a page a revisit of it. Line ends in an URL are left out."""
    uri = None if url is None else "".join(c for c in url if c not in "\r\n")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + digest_of(payload)),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    return record(fields, HTTP + payload if refers_to is None else HTTP)


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of `least` bytes or more the largest page_id is referred to.

    Rows that repeat the largest page_id are all responses, as are rows without a page_id where no other
    row of the payload has one. Payloads are compared by their SHA-1 and length, before which only these
    and the ids are shuffled; a payload moves once, to meet what its page refers to.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = [F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")]
    ids = staged(pages.select("page_id", *own).distinct(), "payloads")
    largest = ids.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"))
    # A page has one entry for each of its payloads.
    revisits = ids.join(largest, ["sha", "size"]).where("NOT page_id <=> refers_to AND refers_to IS NOT NULL")
    revisits = staged(revisits.toDF("sha", "size", "its_id", "refers_to"), "revisits")
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), *own)
    same = [F.col("page_id").eqNullSafe(F.col("its_id")), full["sha"] == revisits["sha"], full["size"] == revisits["size"]]
    return full.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")


class Target:
    """A file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.system, root = file_system(folder)
        self.system.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self.own = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.own, compression=None)

    def done(self) -> None:
        self.stream.close()
        self.system.move(self.own, self.path)


def write_monolithic(rows: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(name, records) of the archives, one for each partition of `rows`, each one gzip stream."""

    def run(batches):
        number = TaskContext.get().partitionId()
        target, count, name = None, 0, f"part-{number:06d}"
        squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        for batch in batches:
            if batch.num_rows and target is None:
                target = Target(folder, f"{name}.warc.gz")
                about = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                target.stream.write(squeeze.compress(about))
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                target.stream.write(squeeze.compress(page_record(*row, f"{name}/{count}")))
                count += 1
        if target is not None:
            target.stream.write(squeeze.flush())
            target.done()
            yield pa.RecordBatch.from_pylist([{"name": name, "records": count}])

    return rows.mapInArrow(run, "name string, records long")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, in chunks."""
    inflate = zlib.decompressobj(GZIP)
    while piece := stream.read(CHUNK):
        while piece:
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
            yield inflate.decompress(piece, CHUNK)
            piece = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    if not inflate.eof:
        yield inflate.flush()
        if not inflate.eof:
            raise ValueError("the gzip stream is cut off")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, each whole with its end."""
    held = bytearray()
    size = None  # of the record at the start of `held`, once its header is there
    for chunk in chunks:
        held += chunk
        while True:
            if size is None:
                at = held.find(END)
                if at < 0:
                    break
                size = at + len(END) + int(header_of(bytes(held[:at]))["content-length"]) + len(END)
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
            size = None
    if held.strip():
        raise ValueError("the last record is cut off")


def header_of(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def normalise(archives: DataFrame, folder: str, to: str, level: int = 6) -> DataFrame:
    """(name, members, bytes): each archive `name` of `folder` rewritten in `to`, with its index.

    A file is inflated once and never held whole, only the record at hand. Index lines are offset,
    length and record id, in the order of the file.
    """

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                system, root = file_system(folder)
                members, index = Target(to, f"{name}.warc.gz"), Target(to, f"{name}.idx")
                at = count = 0
                with system.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as stream:
                    for whole in records(inflated(stream)):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(whole) + squeeze.flush()
                        members.stream.write(member)
                        own = header_of(whole[: whole.find(END)])["warc-record-id"]
                        index.stream.write(f"{at} {len(member)} {own}\n".encode())
                        at += len(member)
                        count += 1
                members.done()
                index.done()
                yield pa.RecordBatch.from_pylist([{"name": name, "members": count, "bytes": at}])

    return archives.select("name").mapInArrow(run, "name string, members long, bytes long")


def fetch(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header and block of the record that is the gzip member at `offset`."""
    stream.seek(offset)
    inflate = zlib.decompressobj(GZIP)
    whole = inflate.decompress(stream.read(length)) + inflate.flush()
    if not inflate.eof or inflate.unused_data:
        raise ValueError("an index line is not a gzip member")
    at = whole.find(END)
    header = header_of(whole[:at])
    block = whole[at + len(END) : -len(END)]
    if len(block) != int(header["content-length"]):
        raise ValueError("a record's length is not that of its block")
    return header, block


def read(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records of normalised archives.

    Each record is fetched by its index line; a response's digest and length are those of the payload
    found, and are checked against its header. A revisit's are in its header.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                system, root = file_system(folder)
                with system.open_input_stream(f"{root}/{name}.idx", compression=None) as lines:
                    index = [line.split() for line in lines.read().decode().splitlines()]
                rows = []
                with system.open_input_file(f"{root}/{name}.warc.gz") as stream:
                    for offset, length, own in index:
                        header, block = fetch(stream, int(offset), int(length))
                        if header["warc-record-id"] != own:
                            raise ValueError("an index line names another record")
                        if header["warc-type"] == "warcinfo":
                            continue
                        digest, size = header["warc-payload-digest"].removeprefix("sha1:"), int(header["x-payload-length"])
                        if header["warc-type"] == "response":
                            payload = block[block.find(END) + len(END) :]
                            if (digest_of(payload), len(payload)) != (digest, size):
                                raise ValueError("a payload is not the one its header names")
                        page, refers = header.get("x-page-id"), header.get("x-refers-to-page-id")
                        rows.append(
                            (None if page is None else int(page), header.get("warc-target-uri"), size, digest, header["warc-type"], None if refers is None else int(refers))
                        )
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return archives.select("name").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """`read` of the normalised archives of all `pages` (page_id, url, html).

    A null html is the empty payload, a null page_id or url stays null, repeated rows have a record each, no
    rows give no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    raw, members = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    archives = staged(write_monolithic(marked(pages, least), raw), "archives")
    # An archive a task.
    spread = archives.repartitionByRange(max(1, archives.count()), "name")
    normalised = staged(normalise(spread, raw, members), "archives")
    return read(normalised.repartitionByRange(max(1, normalised.count()), "name"), members)
