"""Reading by revision and path: what `show`, `archive` and `cat-file` give, contents beside changes, stash snapshots."""

from __future__ import annotations

from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histframe.functions.scalar import blob_oid, mode_kind
from histframe.functions.values import code_units, heading

from .ordered import numbered

T = TypeVar("T")


def required(found: T | None, reason: str) -> T:
    """What was found; LookupError with the reason where that is nothing."""
    if found is None:
        raise LookupError(reason)
    return found


def to_array(df: DataFrame, limit: int) -> list:
    """All rows, of which there may be `limit`; ValueError beyond."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def commit_headers(commits: DataFrame) -> DataFrame:
    """(oid, parents, ts): the graph's columns alone, so that nothing else is read."""
    return commits.select("oid", F.array_compact(F.array("parent0", "parent1")).alias("parents"), "ts")


def load_blobs(rows: DataFrame, blobs: DataFrame, slot: str = "oid") -> DataFrame:
    """rows with the content of the blob in `slot`, null where there is none. Filter rows first: only their blobs are read."""
    b = blobs.select(F.col("oid").alias("_oid"), "content").dropDuplicates(["_oid"])
    return rows.join(b, F.col(slot) == F.col("_oid"), "left").drop("_oid")


def blob_chunks(blobs: DataFrame, size: int = 64 << 10) -> DataFrame:
    """(oid, n, chunk): contents as bytes in pieces of `size`, the last one shorter; an empty blob has none."""
    raw = F.col("content").cast("binary")
    n = F.ceil(F.octet_length(raw) / size).cast("int")
    # array_repeat and not sequence: no pieces make an empty array
    pieces = blobs.select("oid", raw.alias("raw"), F.posexplode(F.array_repeat(F.lit(0), n)).alias("n", "_"))
    return pieces.select("oid", "n", F.substring("raw", F.col("n") * size + 1, F.lit(size)).alias("chunk"))


def workdir_entries(rows: DataFrame) -> DataFrame:
    """(path, kind, mode, oid, target) of working copy rows (path, mode, content): the id is the content's, target is where a link leads."""
    kind = mode_kind(F.col("mode"))
    return rows.select("path", kind.alias("kind"), "mode", blob_oid(F.col("content")).alias("oid"), F.when(kind == "symlink", F.col("content").cast("string")).alias("target"))


def files_at(asked: DataFrame, revisions: DataFrame, trees: DataFrame, blobs: DataFrame) -> DataFrame:
    """(rev, path, oid, content) of asked (rev, path): rev by revisions (rev, tree), the path by trees (tree, path, oid), content by blobs; nulls where a step finds nothing."""
    at = asked.join(revisions.select("rev", F.col("tree").alias("_tree")), "rev", "left")
    t = trees.select(F.col("tree").alias("_t"), F.col("path").alias("_p"), "oid")
    found = at.join(t, (at["_tree"] == t["_t"]) & (at["path"] == t["_p"]), "left").select("rev", "path", "oid")
    return load_blobs(found, blobs).select("rev", "path", "oid", "content")


def patch_files(changes: DataFrame, blobs: DataFrame, textconv: Column | None = None) -> DataFrame:
    """changes (.., old_oid, new_oid) with old_content and new_content; a side that isn't there is null.

    textconv: an expression over `content` that both sides go through.
    """
    shown = blobs if textconv is None else blobs.withColumn("content", textconv)
    old = load_blobs(changes, shown, "old_oid").withColumnRenamed("content", "old_content")
    return load_blobs(old, shown, "new_oid").withColumnRenamed("content", "new_content")


def archive_entries(tree: DataFrame, blobs: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """(path, mode, oid, key): leaves and the directories above them, with a slash at the end; in the order of `key` a directory comes before what it holds.

    With blobs also content, null for directories and module links.
    """
    leaf = tree.select(F.concat(F.lit(prefix), "path").alias("path"), "mode", "oid")
    parts = leaf.select(F.split("path", "/").alias("p")).where(F.size("p") > 1)
    dirs = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice(F.col("p"), F.lit(1), i), "/"))).alias("d")).distinct()
    both = leaf.unionByName(dirs.select(F.concat("d", F.lit("/")).alias("path"), F.lit("40000").alias("mode"), F.lit(None).cast("string").alias("oid")))
    # bytes in hex compare like bytes, and a directory's own slash ends its key
    out = both.withColumn("key", F.hex(F.encode("path", "UTF-8")))
    return out if blobs is None else load_blobs(out, blobs)


def shown(asked: DataFrame, commits: DataFrame, changes: DataFrame, tags: DataFrame, trees: DataFrame, blobs: DataFrame) -> DataFrame:
    """(oid, type, ord, text): what each asked (oid) shows, a line a row.

    A commit gives its subject and its changes (oid, path, kind); a tag (oid, name,
    target) its name, then what its target shows, through any chain of up to five tags;
    a tree its names (tree_oid, pos, name, mode), directories with a slash; a blob its
    lines.
    """
    ids = asked.select("oid", F.col("oid").alias("at"), F.lit(0).alias("hop"))
    level, named = ids, None
    for k in range(1, 6):
        t = tags.select(F.col("oid").alias("at"), "name", "target")
        step = level.join(t, "at")
        head = step.select("oid", F.lit("tag").alias("type"), F.lit(k - 1).cast("long").alias("ord"), F.concat(F.lit("tag "), "name").alias("text"))
        named = head if named is None else named.unionByName(head)
        level = step.select("oid", F.col("target").alias("at"), F.lit(k).alias("hop"))
        ids = ids.unionByName(level)
    base = F.col("hop").cast("long") * 1_000_000_000
    c = ids.join(commits.select(F.col("oid").alias("at"), "subject"), "at")
    head = c.select("oid", F.lit("commit").alias("type"), base.alias("ord"), F.concat(F.lit("commit "), F.col("at").cast("string"), F.lit(" "), "subject").alias("text"))
    listed = c.join(changes.select(F.col("oid").alias("at"), F.col("path").cast("string").alias("path"), "kind"), "at")
    body = listed.select("oid", F.lit("commit").alias("type"), (base + 1).alias("ord"), F.concat("kind", F.lit(" "), "path").alias("text"))
    tree = ids.join(trees.select(F.col("tree_oid").alias("at"), "pos", "name", "mode"), "at")
    names = tree.select("oid", F.lit("tree").alias("type"), (base + F.col("pos")).alias("ord"), F.concat("name", F.when(F.col("mode") == "40000", "/").otherwise("")).alias("text"))
    lines = ids.join(blobs.select(F.col("oid").alias("at"), "content"), "at").select("oid", "hop", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    return named.unionByName(head).unionByName(body).unionByName(names).unionByName(lines.select("oid", F.lit("blob").alias("type"), (base + F.col("n")).alias("ord"), "text"))


def stash_snapshots(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """(oid, index_tree, workdir_tree, untracked_tree) of stash entries (oid): the trees of the second parent, of itself, and of the third where there is one."""
    tree = commits.select(F.col("oid").alias("_c"), F.col("tree").alias("_t"))
    own = entries.select("oid").join(commits.select("oid", "parents", F.col("tree").alias("workdir_tree")), "oid")
    side = lambda df, n, name: df.withColumn("_p", F.try_element_at("parents", F.lit(n))).join(tree, F.col("_p") == F.col("_c"), "left").withColumnRenamed("_t", name).drop("_p", "_c")
    return side(side(own, 2, "index_tree"), 3, "untracked_tree").select("oid", "index_tree", "workdir_tree", "untracked_tree")


def worktrees(entries: DataFrame) -> DataFrame:
    """entries (path, is_main, ..) with the main one first, then by path."""
    return entries.orderBy(F.desc("is_main"), "path")


def stat_clean(racy: bool = True) -> Column:
    """Whether an index entry `i` surely stands for the file `s` as it is, by times, owner, number and size; over struct columns i and s, and index_mtime_s and index_mtime_ns.

    An entry marked as valid is clean; one that isn't older than the index itself may
    have changed unseen, so it isn't (`racy`). Numbers count modulo 2^32, as they are stored.
    """
    same = F.lit(True)
    for c in ("mtime_s", "mtime_ns", "ctime_s", "ctime_ns", "uid", "gid"):
        same &= F.col(f"i.{c}") == F.col(f"s.{c}")
    for c in ("ino", "size"):
        same &= F.pmod(F.col(f"i.{c}"), F.lit(1 << 32)) == F.pmod(F.col(f"s.{c}"), F.lit(1 << 32))
    fresh = (F.col("i.mtime_s") > F.col("index_mtime_s")) | (F.col("i.mtime_s") == F.col("index_mtime_s")) & (F.col("i.mtime_ns") >= F.col("index_mtime_ns"))
    return F.coalesce(F.col("i.assume_valid") | (same & ~fresh if racy else same), F.lit(False))


def entry_same(entry: str = "i", stat: str = "s") -> Column:
    """Whether all stored fields of an entry and a file are equal, device and mode among them."""
    out = F.lit(True)
    for c in ("ctime_s", "ctime_ns", "mtime_s", "mtime_ns", "dev", "ino", "mode", "uid", "gid", "size"):
        out &= F.col(f"{entry}.{c}").eqNullSafe(F.col(f"{stat}.{c}"))
    return out


def ref_order(refs: DataFrame) -> DataFrame:
    """refs with pos, their place by name; range partitions, no single task."""
    return numbered(refs.withColumn("_k", code_units(F.col("name"))), "_k").drop("_k")


def funcname_rows(lines: DataFrame, file: str = "path", pos: str = "n", line: str = "line") -> DataFrame:
    """lines with heading: that of the nearest heading line at or before it in its file, which heads a hunk that begins there."""
    w = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(heading(F.col(line)), ignorenulls=True).over(w))
