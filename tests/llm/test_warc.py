import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest

from compare import SMALL, assert_same
from keyfold.llm import warc
from keyfold.llm.queries import op7_warc


def test_query_against_sql(spark):
    assert_same(op7_warc(spark, SMALL), warc.SQL)


def test_revisits_nulls_and_odd_values(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    rows = [(5, "http://a/ b\r\nX: y", "same é\r\n\r\nbody"), (3, None, "same é\r\n\r\nbody"), (9, "u", ""), (8, "u", None), (None, "u", "own"), (None, "u", "x" * 100_000), (7, "u", "own"), (3, None, "same é\r\n\r\nbody")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(2)
    got = sorted([(r[0], r[1], r[3], r[4]) for r in warc.round_trip(spark, df, f"file://{tmp_path}/w").collect()], key=str)
    n = len("same é\r\n\r\nbody".encode())
    want = [(5, n, "revisit", 3), (3, n, "response", None), (3, n, "response", None), (9, 0, "revisit", 8), (8, 0, "response", None), (None, 3, "revisit", 7), (None, 100_000, "response", None), (7, 3, "response", None)]
    assert got == sorted(want, key=str)
    few = warc.round_trip(spark, df, f"file://{tmp_path}/v", least=4).filter("record_type = 'revisit'")
    assert few.count() == 1
    assert warc.round_trip(spark, df.limit(0), f"file://{tmp_path}/e").count() == 0


def source(raw):
    return pa.BufferReader(raw)


def test_members_written_by_others():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("é.txt", b"abc" * 5)
        z.writestr("packed", b"a" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 with the mark"
    z = warc.ZipRanges(source(buf.getvalue()))
    assert b"".join(z.chunks("é.txt", 4)) == b"abc" * 5
    with pytest.raises(ValueError, match="compressed"):
        z.data_at("packed")
    with pytest.raises(ValueError, match="end record"):
        warc.ZipRanges(source(b"nothing here"))


def test_zip64_directory():
    """A member whose sizes and offset stand in the extra field, and an end record in ZIP64 form."""
    data, name = b"0123456789", b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 10, 10)
    body = b"pad!" + local + data
    extra = struct.pack("<HH3s", 0x9999, 3, b"xyz") + struct.pack("<HHQQQ", 1, 24, 10, 10, 4)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(body))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    z = warc.ZipRanges(source(body + entry + end64 + locator + end))
    assert b"".join(z.chunks("m")) == data and z.members["m"].header_at == 4


def test_a_wrong_digest_is_noticed():
    raw = warc.record(warc.Page(1, "u", b"payload"), warc.payload_digest(b"payload"), "2024-01-01T00:00:00Z")
    assert warc.parse_record(raw)[:2] == (1, 7)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"payload", b"pAyload"))


def foreign(kind, body, uri, *more, http=b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"):
    block = http + body
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:%08d>" % len(uri), b"WARC-Target-URI: " + uri, *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["cdxj", "cdx.gz", None])
def test_archives_that_others_wrote(spark, tmp_path, index):
    """Two WARC files, one not packed; numbers as text; an index in gzip members, or none; records that are no pages."""
    import gzip
    import json

    first = [foreign(b"warcinfo", b"about", b"i", http=b""), foreign(b"response", b"one", b"http://www.A.org/x"), foreign(b"revisit", b"", b"http://a.org/x?y", b"WARC-Payload-Digest: sha1:" + warc.payload_digest(b"one").encode())]
    second = [foreign(b"request", b"GET", b"rq", http=b""), foreign(b"resource", b"plain", b"file:z", http=b""), foreign(b"response", b"3\r\nabc\r\n0\r\n\r\n", b"http://b.org", b"WARC-Payload-Digest: sha1:" + b"A" * 32, http=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n")]
    lines, data = [], {"first.warc.gz": [gzip.compress(r) for r in first], "second.warc": second}
    for name, records in data.items():
        at = 0
        for r in records:
            lines.append(f"key 2024 {json.dumps({'offset': str(at), 'length': str(len(r)), 'filename': name})}\n".encode())
            at += len(r)
    with zipfile.ZipFile(tmp_path / "other.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for name, records in data.items():
            z.writestr(f"archive/{name}", b"".join(records))
        if index:
            lines = [b"!meta 0 {}\n", *sorted(lines)]
            z.writestr(f"indexes/{'index' if index == 'cdxj' else 'all'}.{index}", b"".join(gzip.compress(x) for x in lines) if "gz" in index else b"".join(lines))
    got = warc.read_records(spark.createDataFrame([(f"file://{tmp_path}/other.zip",)], "archive string")).collect()
    one = warc.payload_digest(b"one")
    want = {
        (None, 3, one, "response", None, "http://www.A.org/x"), (None, 0, one, "revisit", None, "http://a.org/x?y"),
        (None, 5, warc.payload_digest(b"plain"), "response", None, "file:z"), (None, 13, warc.payload_digest(b"3\r\nabc\r\n0\r\n\r\n"), "response", None, "http://b.org"),
    }
    assert len(got) == 4 and {(*r[:5], r["url"]) for r in got} == want


def test_written_indexes_and_ids(spark, tmp_path):
    import json

    rows = [(i, f"https://www.Example.com:8080/P{i % 3}?Q=1", "body" if i % 2 else f"own {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    (m,) = warc.write_archives(df, f"file://{tmp_path}/w").collect()
    with zipfile.ZipFile(m["archive"].removeprefix("file://")) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and not z.testzip()
        lines, data = z.read(warc.INDEX).splitlines(), z.read(warc.DATA)
    assert lines == sorted(lines) and len(lines) == 9
    ids = set()
    for line in lines:
        key, date, about = line.decode().split(" ", 2)
        about = json.loads(about)
        assert key == warc.surt(about["url"]) and key.startswith("com,example:8080)/p") and date == "20240101000000" and about["filename"] == "data.warc.gz"
        at, n = int(about["offset"]), int(about["length"])
        raw = zlib.decompress(data[at : at + n], 31)
        page = warc.parse_record(raw)
        assert about["digest"] == f"sha1:{page[2]}" and page[6] == about["url"] and (b"\nWARC-Refers-To-Target-URI: https" in raw) == (page[3] == "revisit")
        ids.add(page[5])
    assert len(ids) == 9
    assert warc.surt("urn:page:7") == "urn:page:7" and warc.surt("http://a.b:80") == "b,a)/"
