"""Objects, packs, indexes and bundles as bytes that a repository's own tools read.

Every row is made by the task that has the objects; a pack holds what a task gets up to a
number of bytes, so many tasks write many packs and none is made in one place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .packs import WIDTH
from .store import KINDS

_NUMBER = {name: n for n, name in KINDS.items()}
#: Bytes of content after which a task begins the next pack.
PACK_BYTES = 64 << 20


def _header(kind: str, content: bytes) -> bytes:
    return f"{kind} {len(content)}\0".encode()


def oid_of(kind: str, content: bytes) -> str:
    return hashlib.sha1(_header(kind, content) + content).hexdigest()


def loose(kind: str, content: bytes) -> tuple[str, bytes]:
    """(path under `objects`, bytes) of a loose object."""
    oid = oid_of(kind, content)
    return f"{oid[:2]}/{oid[2:]}", zlib.compress(_header(kind, content) + content)


def loose_files(objects: DataFrame) -> DataFrame:
    """(path, raw) of the loose files of objects (type, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [loose(k, c) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "raw"])

    return objects.select("type", "content").mapInArrow(run, "path string, raw binary")


def pack(objects: Iterable[tuple[str, bytes]]) -> tuple[bytes, bytes]:
    """(pack, its index) of objects (type, content), each in full and each id once."""
    parts, rows, at = [], {}, 12
    for kind, content in objects:
        oid = oid_of(kind, content)
        if oid in rows:
            continue
        size, head = len(content), bytearray()
        byte, size = _NUMBER[kind] << 4 | size & 15, size >> 4
        while size:
            head.append(byte | 128)
            byte, size = size & 127, size >> 7
        head.append(byte)
        raw = bytes(head) + zlib.compress(content)
        rows[oid] = (zlib.crc32(raw), at)
        parts.append(raw)
        at += len(raw)
    body = struct.pack(">4sII", b"PACK", 2, len(rows)) + b"".join(parts)
    body += hashlib.sha1(body).digest()
    return body, pack_index(rows, body[-WIDTH:])


def pack_index(rows: dict[str, tuple[int, int]], checksum: bytes) -> bytes:
    """The index of a pack from oid -> (crc, offset); offsets of 2 GB and more stand in a table of their own."""
    oids = sorted(rows)
    fan, n = [], 0
    for first in range(256):
        while n < len(oids) and int(oids[n][:2], 16) <= first:
            n += 1
        fan.append(n)
    long: list[int] = []
    small = []
    for o in oids:
        offset = rows[o][1]
        if offset >= 1 << 31:
            long.append(offset)
            offset = 1 << 31 | len(long) - 1
        small.append(offset)
    raw = b"\xfftOc" + struct.pack(">I256I", 2, *fan) + b"".join(map(bytes.fromhex, oids))
    raw += struct.pack(f">{n}I", *(rows[o][0] for o in oids)) + struct.pack(f">{n}I", *small) + struct.pack(f">{len(long)}Q", *long) + checksum
    return raw + hashlib.sha1(raw).digest()


def packs(objects: DataFrame, most: int = PACK_BYTES) -> DataFrame:
    """(name, pack, idx): a pack for every `most` bytes of content that a task has of objects (type, content)."""

    def one(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        body, idx = pack(held)
        return pa.RecordBatch.from_arrays([pa.array([f"pack-{body[-WIDTH:].hex()}"]), pa.array([body], pa.binary()), pa.array([idx], pa.binary())], names=["name", "pack", "idx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((kind, content))
                size += len(content)
                if size >= most:
                    yield one(held)
                    held, size = [], 0
        if held:
            yield one(held)

    return objects.select("type", "content").mapInArrow(run, "name string, pack binary, idx binary")


def bundle(refs: dict[str, str], requires: Iterable[str], body: bytes) -> bytes:
    """A bundle of version 2: what it requires, its refs, and a pack."""
    lines = ["# v2 git bundle", *(f"-{o} " for o in requires), *(f"{o} {name}" for name, o in refs.items())]
    return ("\n".join(lines) + "\n\n").encode() + body


def index_file(entries: Iterable[tuple]) -> bytes:
    """An index of version 2, or 3 where a flag needs it, from entries like those of ``store.index_entries``, in any order."""
    rows = sorted(entries, key=lambda e: (e[0].encode(), e[1]))
    extended = any(e[14] or e[15] for e in rows)
    out = bytearray(struct.pack(">4sII", b"DIRC", 3 if extended else 2, len(rows)))
    for path, stage, mode, oid, size, mtime, mtime_ns, ctime, ctime_ns, dev, ino, uid, gid, valid, skip, intent in rows:
        name = path.encode()
        more = bool(skip or intent)
        flags = min(len(name), 0xFFF) | stage << 12 | more << 14 | bool(valid) << 15
        entry = struct.pack(">10I", ctime, ctime_ns, mtime, mtime_ns, dev, ino, int(mode, 8), uid, gid, size) + bytes.fromhex(oid) + struct.pack(">H", flags)
        entry += struct.pack(">H", bool(skip) << 14 | bool(intent) << 13) if more else b""
        entry += name
        out += entry + b"\0" * (8 - len(entry) % 8)
    return bytes(out) + hashlib.sha1(out).digest()
