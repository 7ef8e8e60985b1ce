"""WARC records in ZIP archives: a writer, and a reader that extracts nothing.

An archive is a ZIP file with two stored members: `archive/data.warc`, the records one
after the other, and `indexes/index.cdx`, a line per record with its place and length.
The reader finds the end record and, where its fields are full, the ZIP64 end record
and locator; walks the central directory; reads the local header to know where a
stored member's bytes begin; then reads single records by range from that place.
All it asks of a source is `read(offset, length)`.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Bytes of payload after which a writer begins the next archive.
ARCHIVE_BYTES = 4 << 20
#: Smaller payloads are written in full each time.
LEAST = 1000
_DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


# --- writing -------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to a revisit that leaves the payload out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    body = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def archive(records: list[bytes], zip64: bool = False) -> bytes:
    """A ZIP archive of the records and their index, both stored; zip64 forces the 64-bit fields."""
    lines, at = [], 0
    for i, r in enumerate(records):
        lines.append(f"{i} {at} {len(r)}\n")
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((DATA, records), (INDEX, [x.encode() for x in lines])):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                for p in parts:
                    f.write(p)
    return _with_zip64_end(out.getvalue()) if zip64 else out.getvalue()


def _with_zip64_end(raw: bytes) -> bytes:
    """The archive with a ZIP64 end record and locator, its plain end record's fields full."""
    at = raw.rindex(b"PK\x05\x06")
    count, size, start = struct.unpack("<HII", raw[at + 10 : at + 20])
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
    return raw[:at] + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


# --- reading -------------------------------------------------------------------------------------------------

Read = Callable[[int, int], bytes]


class ZipReader:
    """The stored members of a ZIP archive, by range reads."""

    def __init__(self, read: Read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - 65_535)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            mark, _, at, _ = struct.unpack("<4sIQI", read(tail_at + end - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", read(at, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
        self.members = dict(self._directory(read(start, length), count))

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            mark, method, packed, size, n, m, k, offset = struct.unpack("<4s6xH8xIIHHH8xI", raw[at : at + 46])
            if mark != b"PK\x01\x02":
                raise ValueError("broken central directory")
            name = raw[at + 46 : at + 46 + n].decode()
            extra, i = raw[at + 46 + n : at + 46 + n + m], 0
            while i + 4 <= len(extra):
                kind, long = struct.unpack_from("<HH", extra, i)
                if kind == 1:  # ZIP64: only the fields that are full above, in this order
                    more = iter(struct.unpack_from(f"<{long // 8}Q", extra, i + 4))
                    size = next(more) if size == 0xFFFFFFFF else size
                    packed = next(more) if packed == 0xFFFFFFFF else packed
                    offset = next(more) if offset == 0xFFFFFFFF else offset
                i += 4 + long
            yield name, (method, offset, packed)
            at += 46 + n + m + k

    def range(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member, without reading the rest of it."""
        method, offset, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        n, m = struct.unpack("<26xHH", self.read(offset, 30))
        length = size - start if length is None else min(length, size - start)
        return self.read(offset + 30 + n + m + start, length)

    def places(self) -> Iterator[tuple[int, int]]:
        """Where each record stands in the data member, from the index."""
        for line in self.range(INDEX).splitlines():
            _, start, length = line.split()
            yield int(start), int(length)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for start, length in self.places():
            yield parse(self.range(DATA, start, length))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, names in lower case, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def in_memory(raw: bytes | memoryview) -> tuple[Read, int]:
    view = memoryview(raw)
    return (lambda at, n: bytes(view[at : at + n])), len(view)


def in_file(file: io.BufferedIOBase) -> tuple[Read, int]:
    """Range reads of any file that can seek, from a local disk or an object store's client."""
    size = file.seek(0, io.SEEK_END)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read, size


# --- Spark ---------------------------------------------------------------------------------------------------


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            html = pc.fill_null(batch.column(2).cast(pa.large_string()), "").cast(pa.large_binary())
            for page, url, payload, digest, n, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                held.append(record(page, url, payload.as_py(), digest, n, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held, zip64=True)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held, zip64=True)], pa.binary())], names=["content"])

    return run


def archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content): ZIP archives of one WARC record a page, a bounded number of bytes each.

    Of pages with equal payloads of at least `least` bytes the one with the largest id
    is written in full and the others as revisits of it (repeated rows of that id are
    all written in full). A null html is an empty payload; null ids are written in
    full and never referred to; a null url is empty. Archives are rows of a binary
    column, since a store that only Spark reads has no file that a task could open.
    """
    rows = only(pages, page_id, url, html).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumns({"digest": F.sha1(payload), "n": F.octet_length(payload).cast("long")})
    # ids and digests only; partial sums, so that a hot payload is no hot task
    best = rows.where(f"n >= {least} and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("d"), "best")
    kinds = rows.join(best, (F.col("digest") == F.col("d")) & (F.col("n") >= least), "left")
    kinds = kinds.select("page_id", "url", "html", "digest", "n", F.when(F.col("best") != F.col("page_id"), F.col("best")).alias("refers"))
    return kinds.mapInArrow(_write(archive_bytes), "content binary")


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _row(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    page, refers = fields["warc-record-id"][10:-1], fields.get("warc-refers-to")
    return (int(page) if page else None, fields["warc-target-uri"], stated, digest, kind, int(refers[10:-1]) if refers else None, payload if kind == "response" else None)


def _read(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [_row(*r) for r in ZipReader(*in_memory(content.as_buffer())).records()]
                columns = dict(zip(_FIELDS, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(_FIELDS, ())
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], _FIELDS[c]) for c in names], names=names)

    return run


def read_archives(content: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes and payload_digest (both of the full payload), record_type, refers_to and, if asked for, payload of each record.

    A response's payload is checked against its digest; a revisit has none (null).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return content.select("content").mapInArrow(_read(list(_FIELDS)[: 6 + payloads]), schema)


def report(pages: DataFrame) -> DataFrame:
    back = read_archives(written(archives(pages), "archives"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
