"""Readers of a store's side files: pack indexes, multi-pack indexes, commit graphs, bundles, bitmaps.

They answer where an object is and how commits hang together without touching a pack.
Files come through Spark's own readers; every row is made in the task that read the file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WIDTH = 20
#: What stands for no parent, and for more parents in a list of their own.
NO_PARENT, MORE = 0x70000000, 0x80000000


def pack_index(raw: bytes) -> list[tuple[str, int, int]]:
    """(oid, crc, offset) of an index of version 2, in order of oid."""
    if raw[:8] != b"\xfftOc\x00\x00\x00\x02":
        raise ValueError("not a pack index of version 2")
    n = struct.unpack(">I", raw[8 + 255 * 4 : 8 + 256 * 4])[0]
    at = 8 + 256 * 4
    oids = [raw[at + i * WIDTH : at + (i + 1) * WIDTH].hex() for i in range(n)]
    at += n * WIDTH
    crcs = struct.unpack(f">{n}I", raw[at : at + 4 * n])
    at += 4 * n
    small = struct.unpack(f">{n}I", raw[at : at + 4 * n])
    at += 4 * n
    # an offset with the top bit set is a place in the table of long ones
    offsets = [struct.unpack(">Q", raw[at + 8 * (x & 0x7FFFFFFF) : at + 8 * (x & 0x7FFFFFFF) + 8])[0] if x & 0x80000000 else x for x in small]
    return list(zip(oids, crcs, offsets, strict=True))


def _chunks(raw: bytes, mark: bytes, count_at: int, first: int) -> dict[bytes, bytes]:
    """The chunks of a file that begins with a mark and has a table of chunks at `first`."""
    if raw[:4] != mark or raw[4] != 1:
        raise ValueError(f"not a {mark.decode()} file of version 1")
    out = {}
    for i in range(raw[count_at]):
        name, begin = struct.unpack(">4sQ", raw[first + 12 * i : first + 12 * i + 12])
        out[name] = raw[begin : struct.unpack(">Q", raw[first + 12 * i + 16 : first + 12 * i + 24])[0]]
    return out


def multi_pack_index(raw: bytes) -> list[tuple[str, str, int]]:
    """(oid, pack, offset) of a multi-pack index of version 1."""
    c = _chunks(raw, b"MIDX", 6, 12)
    packs = [p.decode() for p in c[b"PNAM"].rstrip(b"\0").split(b"\0")]
    n = struct.unpack(">I", c[b"OIDF"][-4:])[0]
    out = []
    for i in range(n):
        pack, offset = struct.unpack(">II", c[b"OOFF"][8 * i : 8 * i + 8])
        if offset & 0x80000000 and b"LOFF" in c:
            offset = struct.unpack(">Q", c[b"LOFF"][8 * (offset & 0x7FFFFFFF) : 8 * (offset & 0x7FFFFFFF) + 8])[0]
        out.append((c[b"OIDL"][WIDTH * i : WIDTH * i + WIDTH].hex(), packs[pack], offset))
    return out


def commit_graph(raw: bytes) -> list[tuple[str, str, list[str], int, int]]:
    """(oid, tree, parents, generation, ts) of a commit graph of one layer."""
    c = _chunks(raw, b"CGPH", 6, 8)
    if raw[7]:
        raise ValueError("the graph has layers below, whose commits it counts first")
    n = struct.unpack(">I", c[b"OIDF"][-4:])[0]
    oids = [c[b"OIDL"][WIDTH * i : WIDTH * i + WIDTH].hex() for i in range(n)]
    out = []
    for i in range(n):
        row = c[b"CDAT"][(WIDTH + 16) * i : (WIDTH + 16) * (i + 1)]
        one, two, high, low = struct.unpack(">IIII", row[WIDTH:])
        parents = [] if one == NO_PARENT else [one]
        if two & MORE and two != NO_PARENT:
            at = two & 0x7FFFFFFF
            while True:
                x = struct.unpack(">I", c[b"EDGE"][4 * at : 4 * at + 4])[0]
                parents.append(x & 0x7FFFFFFF)
                at += 1
                if x & MORE:
                    break
        elif two != NO_PARENT:
            parents.append(two)
        out.append((oids[i], row[:WIDTH].hex(), [oids[p] for p in parents], high >> 2, (high & 3) << 32 | low))
    return out


def bundle_header(raw: bytes) -> tuple[int, list[str], list[tuple[str, str]], int]:
    """(version, prerequisites, refs (name, oid), where the pack begins) of a bundle."""
    end = raw.index(b"\n\n")
    first, *lines = raw[:end].decode("utf-8", "replace").split("\n")
    m = re.fullmatch(r"# v([23]) git bundle", first)
    if m is None:
        raise ValueError("not a bundle of version 2 or 3")
    lines = [x for x in lines if not x.startswith("@")]
    return int(m[1]), [x[1:41] for x in lines if x.startswith("-")], [(x[41:], x[:40]) for x in lines if not x.startswith("-")], end + 2


def ewah(raw: bytes, at: int = 0) -> tuple[int, int]:
    """(the set bits as one number, where the bitmap ends) of a compressed bitmap: runs of equal words, then words as they are."""
    _, words = struct.unpack(">II", raw[at : at + 8])
    at += 8
    values = struct.unpack(f">{words}Q", raw[at : at + 8 * words])
    out = place = i = 0
    while i < words:
        mark = values[i]
        i += 1
        run, literal = mark >> 1 & 0xFFFFFFFF, mark >> 33
        if mark & 1:
            out |= ((1 << 64 * run) - 1) << place
        place += 64 * run
        for w in values[i : i + literal]:
            out |= w << place
            place += 64
        i += literal
    return out, at + 8 * words + 4


def folded(start: int, operations: list[tuple[str, int]]) -> int:
    """A closure by bitmaps: or, xor and and-not one after the other."""
    for how, bits in operations:
        start = {"or": start | bits, "xor": start ^ bits, "andnot": start & ~bits}[how]
    return start


def members(bits: int) -> list[int]:
    """The places of the set bits."""
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _read(spark: SparkSession, folder: str, pattern: str, parse: Callable[[bytes], list[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(raw)
                name = path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def pack_entries(spark: SparkSession, git_dir: str) -> DataFrame:
    """(pack, oid, crc, offset) of all packs."""
    return _read(spark, f"{git_dir}/objects/pack", "pack-*.idx", pack_index, "pack string, oid string, crc long, offset long", [pa.string(), pa.int64(), pa.int64()])


def located(spark: SparkSession, git_dir: str) -> DataFrame:
    """(file, oid, pack, offset) by the multi-pack index."""
    return _read(spark, f"{git_dir}/objects/pack", "multi-pack-index", multi_pack_index, "file string, oid string, pack string, offset long", [pa.string(), pa.string(), pa.int64()])


def graph(spark: SparkSession, git_dir: str) -> DataFrame:
    """(file, oid, tree, parents, generation, ts) by the commit graph, without reading a commit."""
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]
    return _read(spark, f"{git_dir}/objects/info", "commit-graph", commit_graph, "file string, oid string, tree string, parents array<string>, generation long, ts long", types)


def bundle_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, name, oid) of a bundle: its refs, and what it requires."""
    parse = lambda raw: [("requires", None, o) for o in bundle_header(raw)[1]] + [("ref", n, o) for n, o in bundle_header(raw)[2]]
    folder, _, name = path.rpartition("/")
    return _read(spark, folder, name, parse, "file string, kind string, name string, oid string", [pa.string()] * 3)
