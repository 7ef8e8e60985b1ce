"""Readers of repository files: loose objects, packs, indexes, refs, ref logs, configuration.

Files come through Spark's own readers, so any store that Spark opens will do; a
file's bytes are decoded in the task that read it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_OBJECTS = "oid string, type string, size long, content binary"


def _oid(kind: str, content: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(content)}\0".encode() + content).hexdigest()


def loose_object(raw: bytes) -> tuple[str, bytes]:
    head, _, content = zlib.decompress(raw).partition(b"\0")
    return head.split(b" ")[0].decode(), content


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target that copies from the base and inserted bytes make up."""
    at = 0

    def size() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = delta[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    if size() != len(base):
        raise ValueError("the delta is of another base")
    target, out = size(), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if not op & 128:
            if not op:
                raise ValueError("reserved delta instruction")
            out += delta[at : at + op]
            at += op
            continue
        offset = length = 0
        for k in range(7):
            if op >> k & 1:
                byte = delta[at]
                at += 1
                if k < 4:
                    offset |= byte << 8 * k
                else:
                    length |= byte << 8 * (k - 4)
        out += base[offset : offset + (length or 0x10000)]
    if len(out) != target:
        raise ValueError("the delta's size is wrong")
    return bytes(out)


#: Bytes that a decompressor gets at once.
_FED = 1 << 16


def _inflated(raw: bytes, at: int) -> tuple[bytes, int]:
    """What is compressed from a place on, and where that ends; only its own bytes are touched."""
    z, out = zlib.decompressobj(), []
    while not z.eof:
        part = raw[at : at + _FED]
        if not part:
            raise ValueError("the pack ends inside an object")
        out.append(z.decompress(part))
        at += len(part)
    return b"".join(out), at - len(z.unused_data)


def pack_objects(raw: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(oid, type, content) of each object of a pack; deltas against objects of other packs raise KeyError."""
    mark, version, count = struct.unpack(">4sII", raw[:12])
    if mark != b"PACK" or version not in (2, 3):
        raise ValueError("not a pack")
    done: dict[int, tuple[str, bytes]] = {}
    by_oid: dict[str, int] = {}
    waiting: list[tuple[int, str, bytes]] = []
    at = 12
    for _ in range(count):
        start = at
        b = raw[at]
        at += 1
        kind, shift = b >> 4 & 7, 4
        while b & 128:
            b = raw[at]
            at += 1
            shift += 7
        base: int | str | None = None
        if kind == 6:
            b = raw[at]
            at += 1
            back = b & 127
            while b & 128:
                b = raw[at]
                at += 1
                back = (back + 1) << 7 | b & 127
            base = start - back
        elif kind == 7:
            base = raw[at : at + 20].hex()
            at += 20
        content, at = _inflated(raw, at)
        if base is None:
            done[start] = (KINDS[kind], content)
            by_oid[_oid(*done[start])] = start
        elif isinstance(base, int):
            k, old = done[base] if base in done else (None, None)
            if k is None:
                waiting.append((start, base, content))
                continue
            done[start] = (k, apply_delta(old, content))
            by_oid[_oid(*done[start])] = start
        else:
            waiting.append((start, base, content))
    while waiting:
        left = []
        for start, base, delta in waiting:
            at_base = base if isinstance(base, int) else by_oid.get(base)
            if at_base is None or at_base not in done:
                left.append((start, base, delta))
                continue
            k, old = done[at_base]
            done[start] = (k, apply_delta(old, delta))
            by_oid[_oid(*done[start])] = start
        if len(left) == len(waiting):
            raise KeyError("a delta's base isn't in the pack")
        waiting = left
    for k, content in done.values():
        yield _oid(k, content), k, content


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path.endswith(".pack"):
                rows = list(pack_objects(raw))
            else:
                k, content = loose_object(raw)
                rows = [(_oid(k, content), k, content)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["oid", "type", "size", "content"])


def objects(spark: SparkSession, git_dir: str) -> DataFrame:
    """(oid, type, size, content) of loose and packed objects, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{git_dir}/objects")
    wanted = files.where(F.col("path").rlike(r"/objects/([0-9a-f]{2}/[0-9a-f]{38}|pack/[^/]+\.pack)$")).select("path", "content")
    return wanted.mapInArrow(_decoded, _OBJECTS).dropDuplicates(["oid"])


def commits(objects: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, committer, message) decoded with SQL functions."""
    from histframe.functions.scalar import identity

    text = objects.where("type = 'commit'").select("oid", F.decode("content", "UTF-8").alias("t"))
    head = F.substring_index("t", "\n\n", 1)
    field = lambda n: F.regexp_extract(head, rf"(?m)^{n} (.*)$", 1)
    body = F.expr("substring(t, instr(t, '\n\n') + 2)")
    return text.select("oid", field("tree").alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"), identity(field("author")).alias("author"), identity(field("committer")).alias("committer"), body.alias("message"))


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for oid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = n = 0
            while at < len(raw):
                space, end = raw.index(b" ", at), raw.index(b"\0", at)
                rows.append((oid, n, raw[space + 1 : end].decode("utf-8", "replace"), raw[at:space].decode(), raw[end + 1 : end + 21].hex()))
                at, n = end + 21, n + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])], names=["tree_oid", "pos", "name", "mode", "oid"])


def tree_entries(objects: DataFrame) -> DataFrame:
    """(tree_oid, pos, name, mode, oid) of every tree."""
    return objects.where("type = 'tree'").select("oid", "content").mapInArrow(_tree_rows, "tree_oid string, pos int, name string, mode string, oid string")


def flat_tree(entries: DataFrame, root: str, most_levels: int = 2048) -> DataFrame:
    """(path, mode, oid) of the leaves under a tree, a join per level; ValueError where the tree is deeper."""
    level = entries.where(F.col("tree_oid") == root).select(F.col("name").alias("path"), "mode", "oid")
    leaves = None
    for _ in range(most_levels):
        found = level.where("mode not in ('40000', '040000')")
        leaves = found if leaves is None else leaves.unionByName(found)
        down = level.where("mode in ('40000', '040000')")
        if down.isEmpty():
            break
        level = down.select("path", F.col("oid").alias("tree_oid")).join(entries, "tree_oid").select(F.concat_ws("/", "path", "name").alias("path"), "mode", "oid")
    else:
        raise ValueError(f"the tree has more than {most_levels} levels")
    return leaves


def refs(spark: SparkSession, git_dir: str) -> DataFrame:
    """(name, oid, symbolic, peeled): HEAD, loose refs, then packed refs that no loose one hides."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(git_dir)
    name = F.regexp_extract("path", r"/(HEAD|packed-refs|refs/.*)$", 1)
    text = files.where(F.col("path").rlike(r"/(HEAD|packed-refs|refs/[^\n]+)$") & ~F.col("path").rlike("/logs/")).select(name.alias("name"), F.decode("content", "UTF-8").alias("t"))
    line = F.trim(F.regexp_replace("t", r"\n$", ""))
    loose = text.where("name != 'packed-refs'").select("name", F.when(~line.startswith("ref: "), line).alias("oid"), F.when(line.startswith("ref: "), F.trim(F.substring(line, 6, 1000))).alias("symbolic"), F.lit(None).cast("string").alias("peeled"), F.lit(0).alias("rank"))
    packed = text.where("name = 'packed-refs'").select(F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^([0-9a-f]{40} \S+(?:\n\^[0-9a-f]{40})?)"), F.lit(1))).alias("e"))
    packed = packed.select(F.regexp_extract("e", r"^\S+ (\S+)", 1).alias("name"), F.substring("e", 1, 40).alias("oid"), F.lit(None).cast("string").alias("symbolic"), F.expr("nullif(regexp_extract(e, '\\\\^([0-9a-f]{40})', 1), '')").alias("peeled"), F.lit(1).alias("rank"))
    both = loose.unionByName(packed)
    return both.groupBy("name").agg(F.min_by(F.struct("oid", "symbolic", "peeled"), "rank").alias("r")).select("name", "r.*")


def reflogs(spark: SparkSession, git_dir: str) -> DataFrame:
    """(ref, seq, old_oid, new_oid, name, email, ts, tz, message), oldest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{git_dir}/logs")
    rows = files.select(F.regexp_extract("path", r"/logs/(.*)$", 1).alias("ref"), F.posexplode(F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: x != "")).alias("seq", "line"))
    p = r"^([0-9a-f]+) ([0-9a-f]+) (.*?) ?<([^>]*)> (-?\d+) ([+-]\d{4})(?:\t(.*))?$"
    g = lambda i: F.regexp_extract("line", p, i)
    return rows.select("ref", F.col("seq").cast("long").alias("seq"), g(1).alias("old_oid"), g(2).alias("new_oid"), g(3).alias("name"), g(4).alias("email"), g(5).cast("long").alias("ts"), g(6).alias("tz"), g(7).alias("message"))


_ENTRY = "path string, stage int, mode string, oid string, size long, mtime long, mtime_ns long, ctime long, ctime_ns long, dev long, ino long, uid long, gid long, assume_valid boolean, skip_worktree boolean, intent_to_add boolean"
_ENTRY_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 9, *[pa.bool_()] * 3]


def index_entries(raw: bytes) -> list[tuple]:
    """The entries of an index file of version 2 or 3, as in ``index``; its trailing hash is checked."""
    mark, version, count = struct.unpack(">4sII", raw[:12])
    if mark != b"DIRC" or version not in (2, 3):
        raise ValueError("not an index of version 2 or 3")
    if hashlib.sha1(raw[:-20]).digest() != raw[-20:] and any(raw[-20:]):
        raise ValueError("the index's hash is wrong")
    out, at = [], 12
    for _ in range(count):
        ctime, ctime_ns, mtime, mtime_ns, dev, ino, mode, uid, gid, size = struct.unpack(">10I", raw[at : at + 40])
        oid, flags = raw[at + 40 : at + 60].hex(), struct.unpack(">H", raw[at + 60 : at + 62])[0]
        more = struct.unpack(">H", raw[at + 62 : at + 64])[0] if flags & 0x4000 else 0
        name_at = at + 62 + 2 * bool(flags & 0x4000)
        end = raw.index(b"\0", name_at)
        out.append((raw[name_at:end].decode("utf-8", "replace"), flags >> 12 & 3, f"{mode:o}", oid, size, mtime, mtime_ns, ctime, ctime_ns, dev, ino, uid, gid, bool(flags & 0x8000), bool(more & 0x4000), bool(more & 0x2000)))
        at += (end - at + 8) // 8 * 8
    return out


def index(spark: SparkSession, git_dir: str) -> DataFrame:
    """(path, stage, mode, oid, size, times, device, number, owner and flags) of a repository's index; no rows where there is none."""
    names = [c.strip().split(" ")[0] for c in _ENTRY.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = index_entries(raw)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ENTRY_TYPES)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "index").load(git_dir)
    return files.select("content").mapInArrow(run, _ENTRY)


def parse_config(text: str) -> list[tuple[str, str, str | None]]:
    """(section or section.subsection, name, value) in order; a name alone has no value."""
    out, section = [], ""
    for raw in text.replace("\\\n", "").split("\n"):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if m := re.match(r'\[([\w.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\]\s*(.*)', line):
            section = m[1].lower() + ("" if m[2] is None else "." + re.sub(r"\\(.)", r"\1", m[2]))
            line = m[3]
            if not line or line[0] in "#;":
                continue
        name, eq, value = line.partition("=")
        if eq:
            parts = re.findall(r'"((?:[^"\\]|\\.)*)"|([^"#;]+)|([#;].*)', value.strip())
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), "".join(a or b for a, b, _ in parts)).strip()
        out.append((section, name.strip().lower(), value if eq else None))
    return out
