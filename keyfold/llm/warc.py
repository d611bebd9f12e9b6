"""WARC records in ZIP-packaged archives: written one archive at a time, read by ranges without extraction.

An archive is a ZIP file whose members are stored, not compressed: WARC files below ``archive/``, by convention a gzip
member per record, and CDXJ indexes below ``indexes/``, which name each record's file, offset and length. A reader finds
the members through the central directory (with its ZIP64 form) and then reads the ranges that the indexes name; an
archive without an index is walked through record by record. Archives that others wrote are read alike.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.shared import columns, last_staged, staged, staged_folders

#: What is written. Any WARC files and indexes in these folders are read.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_IS_DATA, _IS_INDEX = re.compile(r"archive/.+\.warc(\.gz)?"), re.compile(r"indexes/.+\.cdxj?(\.gz)?")
#: An archive is closed beyond so many bytes; a range to read ends beyond so many.
ARCHIVE_BYTES, RANGE_BYTES = 1 << 30, 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own, for what a page's row says and the format has no field for.
PAGE, OF_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"


def open_folder(uri: str) -> tuple[FileSystem, str]:
    """Any file system that Arrow knows: file, s3, gs, hdfs."""
    return FileSystem.from_uri(uri)


# --- records ---------------------------------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """White space and control characters would end or fold a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def target_of(page_id: int | None, url: str | None) -> str:
    return _header_value(url) if url else f"urn:page:{'' if page_id is None else page_id}"


def surt(url: str) -> str:
    """The key that an index is sorted by: the host's labels from the top, then path and query, in lower case."""
    parts = urlsplit(url)
    if not parts.netloc:
        return url.lower()
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    port = f":{port}" if port and (parts.scheme.lower(), port) not in (("http", "80"), ("https", "443")) else ""
    return f"{','.join(reversed(labels))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


@dataclass(frozen=True)
class Page:
    page_id: int | None
    url: str | None
    payload: bytes
    #: Page and target of the response that this one repeats, if it does.
    refers_to: int | None = None
    refers_url: str | None = None


def record(page: Page, digest: str, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if page.refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_of(page.page_id, page.url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page.page_id is not None:
        head.append(f"{PAGE}: {page.page_id}")
    if page.refers_to is None:
        block += page.payload
    else:
        head += [f"WARC-Refers-To-Target-URI: {target_of(page.refers_to, page.refers_url)}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {REVISIT}", f"{OF_PAGE}: {page.refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def index_line(page: Page, digest: str, date: str, offset: int, length: int) -> str:
    target = target_of(page.page_id, page.url)
    about = {
        "url": target, "mime": "text/html" if page.refers_to is None else "warc/revisit", "status": "200", "digest": f"sha1:{digest}",
        "length": str(length), "offset": str(offset), "filename": DATA.rpartition("/")[2],
    }
    return f"{surt(target)} {re.sub('[^0-9]', '', date)[:14]} {json.dumps(about)}\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on with the one before it."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _split(raw: bytes) -> tuple[bytes, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    return head, rest


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]+", text) else None


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, str | None, str | None] | None:
    """RECORD's values from one record, or None if it holds no page (warcinfo, request, metadata and so on).

    A payload whose SHA-1 digest is not the one that the record states raises, unless it was stored as it was sent, in
    chunks. A revisit has the size that its HTTP head tells, 0 without one.
    """
    head, rest = _split(raw)
    h = parse_headers(head)
    kind, block = h.get("warc-type"), rest[: int(h["content-length"])]
    if kind not in ("response", "revisit", "resource"):
        return None
    http, payload = _split(block) if block.startswith(b"HTTP/") else (b"", block)
    sent, said = parse_headers(http), h.get("warc-payload-digest", "")
    known = said.partition(":")[2] if said.lower().startswith("sha1:") else None
    beside = (_number(h.get(OF_PAGE.lower())), h.get("warc-record-id", "").strip("<>") or None, h.get("warc-target-uri", "").strip("<>") or None)
    page = _number(h.get(PAGE.lower()))
    if kind == "revisit":
        return page, _number(sent.get("content-length")) or 0, known or "", "revisit", *beside
    found = payload_digest(payload)
    if known and len(known) == 32 and found != known and "chunked" not in sent.get("transfer-encoding", ""):
        raise ValueError(f"record {h.get('warc-record-id')}: its payload has digest {found}, its header says {known}")
    return page, len(payload), found, "response", *beside


# --- ZIP -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    encrypted: bool
    size: int
    stored_size: int
    header_at: int


class ZipRanges:
    """The directory of a ZIP file, and ranges of its stored members. ``source`` has read_at(n, offset) and size()."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.length = source, source.size()
        self.members = {m.name: m for m in self._directory()}

    def _at(self, offset: int, n: int) -> bytes:
        got = self.source.read_at(n, offset)
        if len(got) != n:
            raise ValueError(f"the archive ends inside {n} bytes at {offset}")
        return got

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and offset of the central directory."""
        tail_at = max(0, self.length - 22 - 65535)
        tail = self._at(tail_at, self.length - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: it has no end record")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if (entries == 0xFFFF or 0xFFFFFFFF in (size, offset)) and tail_at + at >= 20:
            locator = self._at(tail_at + at - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                large = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if large[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 end record is not where its locator points")
                entries, size, offset = struct.unpack_from("<QQQ", large, 32)
        return entries, size, offset

    def _directory(self) -> Iterator[Member]:
        entries, size, offset = self._end()
        table, at = self._at(offset, size), 0
        for _ in range(entries):
            sig, flags, method, stored, full, n, x, c, where = struct.unpack_from("<4s4xHH8xIIHHH8xI", table, at)
            if sig != b"PK\x01\x02":
                raise ValueError(f"no directory entry at {offset + at}")
            name = table[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = table[at + 46 + n : at + 46 + n + x]
            full, stored, where = _zip64(extra, full, stored, where)
            yield Member(name, method, bool(flags & 1), full, stored, where)
            at += 46 + n + x + c

    def data_at(self, name: str) -> int:
        """Where a stored member's first byte is."""
        m = self.members[name]
        if m.method != 0 or m.encrypted:
            raise ValueError(f"{name} is compressed or encrypted; only stored members can be read by range")
        local = self._at(m.header_at, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header at {m.header_at}")
        n, x = struct.unpack_from("<HH", local, 26)
        return m.header_at + 30 + n + x

    def chunks(self, name: str, n: int = 1 << 20) -> Iterator[bytes]:
        at, left = self.data_at(name), self.members[name].size
        while left:
            yield self._at(at, min(n, left))
            at, left = at + min(n, left), left - min(n, left)

    def lines(self, name: str) -> Iterator[bytes]:
        """A member's lines, unpacked if it is gzip (of one or more members)."""
        source = self.chunks(name)
        if name.endswith(".gz"):
            source = (data for data, _ in unpacked(source))
        rest = b""
        for chunk in source:
            *whole, rest = (rest + chunk).split(b"\n")
            yield from whole
        yield rest


def unpacked(chunks: Iterator[bytes], most: int = 1 << 20) -> Iterator[tuple[bytes, int]]:
    """Pieces of what gzip members hold; beside the last piece of each, the packed bytes that end with it, else 0."""
    unpack, used = zlib.decompressobj(31), 0
    for chunk in chunks:
        while chunk:
            data = unpack.decompress(chunk, most)
            left = unpack.unconsumed_tail or unpack.unused_data
            used += len(chunk) - len(left)
            yield data, used if unpack.eof else 0
            if unpack.eof:
                unpack = zlib.decompressobj(31)
                left = left.lstrip(b"\0") if not left.strip(b"\0") else left
            chunk = left


def _zip64(extra: bytes, full: int, stored: int, where: int) -> tuple[int, int, int]:
    """Fields that are all ones stand in extra field 1, in this order, those alone."""
    at, values = 0, [full, stored, where]
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for k, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[k] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + n
    return values[0], values[1], values[2]


# --- writing ---------------------------------------------------------------------------------------------------------


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """(key, refers_to, refers_url): which rows repeat the payload of a page with a smaller id, and that page.

    Only ids and digests move here. Rows are keyed by id and payload, so that a payload that very many pages share is
    not one key when texts are moved.
    """
    rows = pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit(""))).alias("d"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    many = rows.filter(F.col("n") >= least).groupBy("d", "n").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("records")).filter("records > 1")
    named = staged(many.drop("records"), "payloads")
    first = rows.join(named, ["d", "n"]).filter("page_id = low").groupBy("d", "n").agg(F.min("url").alias("low_url"))
    again = rows.join(named, ["d", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("low")) & F.col("low").isNotNull())
    again = again.select("page_id", "d", "n", "low").distinct().join(first, ["d", "n"])
    return again.select(_key(F.col("page_id"), F.col("d")).alias("key"), F.col("low").alias("refers_to"), F.col("low_url").alias("refers_url"))


def _key(page_id: Column, digest: Column) -> Column:
    return F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest)


def write_archives(pages: DataFrame, folder: str, *, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest (archive, records).

    Every task writes archives of its own, under names never used before, and reports those it has closed; what a lost
    or repeated task leaves is in no manifest. Nulls of html are empty payloads, nulls of url have a URN instead.
    """
    before = staged_folders()
    again = staged(_revisits(pages, least), "revisits")
    rows = pages.select("page_id", "url", "html", _key(F.col("page_id"), F.sha1(F.coalesce("html", F.lit("")))).alias("key"))
    rows = rows.join(again, "key", "left").select("page_id", "url", "html", "refers_to", "refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        fs.create_dir(top, recursive=True)
        names = ("page_id", "url", "html", "refers_to", "refers_url")
        source = (Page(i, u, (h or "").encode(), r, ru) for b in batches for i, u, h, r, ru in zip(*([v.as_py() for v in c] for c in columns(b, *names)), strict=True))
        page = next(source, None)
        while page is not None:
            name, index, at = f"{uuid.uuid4().hex}.zip", [], 0
            with fs.open_output_stream(f"{top}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(DATA, "w", force_zip64=True) as data:
                    while page is not None and at < ARCHIVE_BYTES:
                        digest = payload_digest(page.payload)
                        pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                        packed = pack.compress(record(page, digest, date)) + pack.flush()
                        data.write(packed)
                        index.append(index_line(page, digest, date, at, len(packed)).encode())
                        at += len(packed)
                        page = next(source, None)
                archive.writestr(INDEX, b"".join(sorted(index)))
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["archive", "records"])

    return last_staged(rows.mapInArrow(run, "archive string, records long"), "manifest", before)


# --- reading ---------------------------------------------------------------------------------------------------------


def _indexed(z: ZipRanges, indexes: list[str]) -> Iterator[tuple[int, int]]:
    """Where each record that the indexes name begins in the archive, and its length."""
    data = [m for m in z.members if _IS_DATA.fullmatch(m)]
    base: dict[str, int] = {}
    for name in indexes:
        for line in z.lines(name):
            if (at := line.find(b"{")) < 0 or line.startswith(b"!"):
                continue
            entry = json.loads(line[at:])
            if "offset" not in entry or "length" not in entry:
                continue
            said = entry.get("filename")
            member = next((m for m in (said, f"archive/{said}") if m in z.members), None) if said else data[0] if len(data) == 1 else None
            if member is None:
                raise ValueError(f"{name} names {said!r}, which the archive does not hold")
            if member not in base:
                base[member] = z.data_at(member)
            yield base[member] + int(entry["offset"]), int(entry["length"])


def _walked(z: ZipRanges) -> Iterator[tuple[int, int]]:
    """The same without an index: gzip members one after the other, or records by their own lengths."""
    for name in (m for m in z.members if _IS_DATA.fullmatch(m)):
        base, size = z.data_at(name), z.members[name].size
        if name.endswith(".gz"):
            start = 0
            for _, end in unpacked(z.chunks(name)):
                if end:
                    yield base + start, end - start
                    start = end
            continue
        at = 0
        while at < size:
            head = z._at(base + at, min(1 << 16, size - at))
            end = head.find(b"\r\n\r\n")
            if end < 0:
                break
            length = end + 4 + int(parse_headers(head[:end])["content-length"]) + 4
            yield base + at, min(length, size - at)
            at += length


def read_ranges(archives: DataFrame) -> DataFrame:
    """(archive, start, lengths): runs of adjacent records, from each archive's directory and indexes."""

    def runs(z: ZipRanges) -> Iterator[tuple[int, list[int]]]:
        indexes = [m for m in z.members if _IS_INDEX.fullmatch(m)]
        start, end, lengths = 0, -1, []
        for at, n in sorted(set(_indexed(z, indexes) if indexes else _walked(z))):
            if lengths and (at != end or end - start >= RANGE_BYTES):
                yield start, lengths
                lengths = []
            start = start if lengths else at
            lengths.append(n)
            end = at + n
        if lengths:
            yield start, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column(0).to_pylist()):
            fs, path = open_folder(uri)
            with fs.open_input_file(path) as source:
                for start, lengths in runs(ZipRanges(source)):
                    yield pa.record_batch([pa.array([uri]), pa.array([start], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], names=["archive", "start", "lengths"])

    return archives.select("archive").mapInArrow(run, "archive string, start long, lengths array<long>")


def read_records(archives: DataFrame) -> DataFrame:
    """RECORD: a row per response, revisit or resource of the archives named.

    page_id and refers_to are null in archives that others wrote; record_id and url are those of the record.
    """
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[f.split(" ")[1]] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, lengths in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, path = open_folder(uri)
                with fs.open_input_file(path) as source:
                    raw, at, rows = source.read_at(sum(lengths), start), 0, []
                for n in lengths:
                    one = raw[at : at + n]
                    rows.append(parse_record(zlib.decompress(one, 31) if one[:2] == b"\x1f\x8b" else one))
                    at += n
                if rows := [r for r in rows if r is not None]:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ranges = read_ranges(archives).repartition(archives.sparkSession.sparkContext.defaultParallelism * 4)
    return ranges.mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, *, least: int = 0) -> DataFrame:
    """Write ``pages`` below ``folder`` and read the records back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id is the response and the
    others revisit it. Rows repeated with that page_id are responses too. A null page_id is never the smallest; if all
    are null, all are responses. A very long payload is a record as it is. An empty table gives an empty result. Further
    columns are not looked at.
    """
    return read_records(write_archives(pages, folder, least=least)).drop("record_id", "url")


SQL = """
with p as (select page_id, coalesce(html, '') html, cast(strlen(coalesce(html, '')) as bigint) payload_bytes, sha1(coalesce(html, '')) h from pages),
f as (select *, min(page_id) over (partition by h, payload_bytes) low from p)
select page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, cast((5*k)//4 + 1 as bigint), 2) as integer) >> cast(3 - (5*k) % 4 as integer)) & 31) + 1 as bigint), 1)), '') payload_digest,
 case when page_id = low then 'response' else 'revisit' end record_type,
 case when page_id = low then null else low end refers_to
from f
"""
