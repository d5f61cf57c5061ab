"""Small inputs for operator tests."""

import io
import struct
import zipfile


def xml_parts(spark, *rows):
    """Rows `(package, path, xml)` as read parts."""
    return spark.createDataFrame(
        [(p, path, x if isinstance(x, (bytes, bytearray)) else x.encode()) for p, path, x in rows],
        "package string, path string, content binary",
    )


def value(spark, expression, **columns):
    """`expression` over one row of string columns."""
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expression.alias("v")).first()["v"]


def zip_bytes(files, declared=None, stored=False):
    """A container of `(name, bytes)`; `declared` overwrites all declared sizes."""
    buffer = io.BytesIO()
    method = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
    with zipfile.ZipFile(buffer, "w", method) as out:
        for name, data in files:
            out.writestr(zipfile.ZipInfo(name), data, compress_type=method)
    blob = bytearray(buffer.getvalue())
    if declared is not None:
        at = 0
        while (at := blob.find(b"PK", at)) >= 0:
            if blob[at : at + 4] == b"PK\x03\x04":
                blob[at + 22 : at + 26] = struct.pack("<I", declared)
            elif blob[at : at + 4] == b"PK\x01\x02":
                blob[at + 24 : at + 28] = struct.pack("<I", declared)
            at += 2
    return bytes(blob)


def packages(spark, *rows):
    return spark.createDataFrame(
        [(name, bytearray(blob)) for name, blob in rows], "package string, content binary"
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def one(df, *columns):
    found = rows(df, *columns)
    assert len(found) == 1, found
    return found[0]


REL = "http://example.org/rel/"


def rels_xml(*links):
    """`(id, type suffix, target[, mode])` as a relationships part."""
    body = "".join(
        f'<Relationship Id="{i}" Type="{REL}{t}" Target="{x}"{" TargetMode=%r" % m[0] if m else ""}/>'
        for i, t, x, *m in links
    )
    return f"<Relationships>{body}</Relationships>".encode()
