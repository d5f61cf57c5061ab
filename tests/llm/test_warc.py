"""WARC archives: exact round trip, members and index, damaged files."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from packlake.llm import warc


def brute(rows, least=0):
    payloads = [(h or "").encode() for _, _, h in rows]
    largest = {}
    for (p, _, _), x in zip(rows, payloads):
        if p is not None:
            largest[x] = max(p, largest.get(x, p))
    out = []
    for (p, url, _), x in zip(rows, payloads):
        to = largest.get(x) if len(x) >= least else None
        revisit = to is not None and to != p
        out.append((p, url, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "x\r\n\r\nWARC/1.1\r\n" * 50),
    (5, "http://d", "x\r\n\r\nWARC/1.1\r\n" * 50), (None, "http://e", "<p>é</p>"), (None, "http://f", "alone"), (7, "http://g", "long " * 400_000), (6, "http://h", "long " * 400_000),
]


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, refers_to string, sha int")
    got = [tuple(r) for r in warc.round_trip(pages, least).collect()]
    assert sorted(got, key=str) == brute(ROWS, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normalised_file(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    rows = spark.createDataFrame([(k, f"http://{k}", bytearray(b"page %d " % k * k), None) for k in range(50)], "page_id long, url string, payload binary, refers_to long").coalesce(1)
    names = spark.createDataFrame([(r.name,) for r in warc.write_monolithic(rows, raw).collect()], "name string")
    done = warc.normalise(names, raw, out).collect()
    assert [r.members for r in done] == [51]
    name = done[0].name
    whole = gzip.decompress((tmp_path / "raw" / f"{name}.warc.gz").read_bytes())
    data = (tmp_path / "out" / f"{name}.warc.gz").read_bytes()
    assert gzip.decompress(data) == whole and done[0].bytes == len(data)
    at = 0
    for line in (tmp_path / "out" / f"{name}.idx").read_text().splitlines():
        offset, length, own = line.split()
        assert int(offset) == at
        member = zlib.decompressobj(31)
        one = member.decompress(data[at : at + int(length)])
        assert member.eof and one.startswith(b"WARC/1.1\r\n") and own.encode() in one
        at += int(length)
    assert at == len(data)


def test_damaged_streams():
    one = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<a>")], b"block")
    two = gzip.compress(one) + gzip.compress(one)
    assert list(warc.records(warc.inflated(io.BytesIO(two)))) == [one, one]
    for bad in (two[:-9], gzip.compress(one[:-6]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.records(warc.inflated(io.BytesIO(bad))))
