"""Entry streams as tar and ZIP files, and state tables as the text files that a repository keeps.

An archive is one file, so it is written by one reader of the sorted rows, which come
one partition at a time and are never held together.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histframe.functions.values import code_units


def _sorted(entries: DataFrame) -> Iterator:
    return entries.orderBy("key").toLocalIterator()


def _raw(content: str | bytes | None) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content or b"")


def write_tar(entries: DataFrame, path: str, ts: int = 0) -> int:
    """A tar of archive entries (path, mode, content, key); the number of its members."""
    n = 0
    with tarfile.open(path, "w", format=tarfile.USTAR_FORMAT) as out:
        for r in _sorted(entries):
            info = tarfile.TarInfo(r.path.rstrip("/"))
            info.mtime, raw = ts, _raw(r.content)
            info.mode = 0o775 if r.path.endswith("/") or r.mode == "100755" else 0o664
            if r.path.endswith("/"):
                info.type = tarfile.DIRTYPE
            elif r.mode == "120000":
                info.type, info.linkname, raw = tarfile.SYMTYPE, raw.decode(), b""
            info.size = len(raw)
            out.addfile(info, io.BytesIO(raw))
            n += 1
    return n


def write_zip(entries: DataFrame, path: str, ts: tuple[int, int, int, int, int, int] = (1980, 1, 1, 0, 0, 0)) -> int:
    """A ZIP of archive entries; links are members whose content is where they lead."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for r in _sorted(entries):
            info = zipfile.ZipInfo(r.path, ts)
            info.external_attr = (0o40775 if r.path.endswith("/") else int(r.mode, 8)) << 16
            info.compress_type = zipfile.ZIP_STORED if r.path.endswith("/") else zipfile.ZIP_DEFLATED
            out.writestr(info, _raw(r.content))
            n += 1
    return n


def packed_refs(refs: DataFrame) -> DataFrame:
    """(ord, line) of a packed-refs file of refs (name, oid, peeled): a head line, then by name each ref and behind it what it peels to. No refs, no lines."""
    key = code_units(F.col("name"))
    rows = refs.select(key.alias("k"), F.explode(F.array_compact(F.array(F.struct(F.lit(1).alias("n"), F.concat("oid", F.lit(" "), "name").alias("line")), F.when(F.col("peeled").isNotNull(), F.struct(F.lit(2).alias("n"), F.concat(F.lit("^"), "peeled").alias("line")))))).alias("x"))
    head = refs.limit(1).select(F.lit("").alias("ord"), F.lit("# pack-refs with: peeled fully-peeled sorted ").alias("line"))
    return head.unionByName(rows.select(F.concat("k", F.lit("."), F.col("x.n").cast("string")).alias("ord"), "x.line"))


def sparse_text(patterns: DataFrame, cone: bool) -> DataFrame:
    """(ord, line) of a sparse-checkout file: patterns (pattern) as they are, in order of ord, or for a cone the directories (pattern) with their parents."""
    if not cone:
        return patterns.select(F.col("ord").cast("string").alias("ord"), F.col("pattern").alias("line"))
    d = patterns.select(F.trim(F.regexp_replace("pattern", "^/|/$", "")).alias("d")).where("d != ''").distinct()
    parts = d.select(F.split("d", "/").alias("p")).where(F.size("p") > 1)
    above = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice(F.col("p"), F.lit(1), i), "/"))).alias("d")).distinct().join(d, "d", "left_anti")
    root = patterns.limit(1).select(F.explode(F.array(F.struct(F.lit("!0").alias("ord"), F.lit("/*").alias("line")), F.struct(F.lit("!1").alias("ord"), F.lit("!/*/").alias("line")))).alias("x")).select("x.*")
    hollow = above.select(F.explode(F.array(F.struct(F.concat("d", F.lit("/0")).alias("ord"), F.concat(F.lit("/"), "d", F.lit("/")).alias("line")), F.struct(F.concat("d", F.lit("/1")).alias("ord"), F.concat(F.lit("!/"), "d", F.lit("/*/")).alias("line")))).alias("x")).select("x.*")
    return root.unionByName(hollow).unionByName(d.select(F.concat("d", F.lit("/0")).alias("ord"), F.concat(F.lit("/"), "d", F.lit("/")).alias("line")))


def log_lines(log: DataFrame) -> DataFrame:
    """(ref, seq, line) of log entries (ref, seq, old_oid, new_oid, name, email, ts, tz, message); no old id is the id of zeros."""
    zero = "0" * 40
    who = F.concat("name", F.lit(" <"), "email", F.lit("> "), F.col("ts").cast("string"), F.lit(" "), "tz")
    message = F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit("\t"), F.trim(F.regexp_replace("message", r"\s+", " ")))).otherwise("")
    return log.select("ref", "seq", F.concat(F.coalesce("old_oid", F.lit(zero)), F.lit(" "), F.coalesce("new_oid", F.lit(zero)), F.lit(" "), who, message).alias("line"))
