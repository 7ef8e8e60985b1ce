"""Content queries: line search, whitespace, line counts, similarity, renames, blame, merges, patch series.

What SQL can say stays in SQL. Line differences go through ``mapInArrow`` with one pair
a row; groups are one file or one series, which a single reader of it would hold too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histframe.functions import linediff
from histframe.functions.scalar import is_binary, normalized_line, split_lines
from histframe.scratch import written

MOST_SCORE = 60_000
#: Least score of a rename, candidates kept for each destination, and the default limit: no more than limit x limit pairs.
RENAME_SCORE, KEPT, LIMIT = 30_000, 4, 1000


def lines(blobs: DataFrame) -> DataFrame:
    """(path, n, line): lines from 1, without their newline."""
    return blobs.select("path", F.posexplode(split_lines(F.col("content"))).alias("i", "l")).select("path", (F.col("i") + 1).cast("long").alias("n"), F.regexp_replace("l", r"\n$", "").alias("line"))


def _pattern(text: str, fixed: bool, word: bool, ignore_case: bool) -> str:
    body = "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text) if fixed else f"(?:{text})"
    body = rf"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])" if word else body
    return ("(?i)" if ignore_case else "") + body


def grep(blobs: DataFrame, patterns: list[str], fixed: bool = False, word: bool = False, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """(path, n, line, spans): lines that any pattern hits, with the number of hits; binary files give one row with n 0."""
    compiled = [_pattern(p, fixed, word, ignore_case) for p in patterns]
    hits = sum((F.regexp_count("line", F.lit(p)) for p in compiled), F.lit(0))
    binary = is_binary(F.col("content"))
    found = lines(blobs.where(~binary)).withColumn("spans", hits)
    found = found.where(F.col("spans") == 0 if invert else F.col("spans") > 0).select("path", "n", "line", F.when(F.lit(invert), 0).otherwise(F.col("spans")).cast("long").alias("spans"))
    some = F.lit(False)
    for p in compiled:
        some |= F.col("content").rlike(p)
    flagged = blobs.where(binary & (F.lit(invert) | some)).select("path", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("line"), F.lit(0).cast("long").alias("spans"))
    return found.unionByName(flagged)


def whitespace_only(pairs: DataFrame, mode: str = "all", blank_lines: bool = False) -> DataFrame:
    """pairs (old, new) with `ws_only`: whether only white space differs by the mode, and with blank_lines also blank lines."""

    def keyed(c: Column) -> Column:
        out = F.transform(split_lines(F.coalesce(c, F.lit(""))), lambda x: normalized_line(x, mode))
        return F.filter(out, lambda x: ~x.rlike(r"^\s*$")) if blank_lines else out

    return pairs.withColumn("ws_only", keyed(F.col("old")) == keyed(F.col("new")))


def _schema(df: DataFrame, **more: str):
    from pyspark.sql.types import StructType

    out = StructType([*df.schema.fields])
    for name, kind in more.items():
        out.add(name, kind)
    return out


def _per_pair(pairs: DataFrame, call, columns: dict[str, str], inputs: tuple[str, ...]) -> DataFrame:
    """pairs with what `call` makes of the input columns, row by row in Arrow batches."""
    at = [pairs.columns.index(c) for c in inputs]
    types = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [call(*r) for r in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            made = [pa.array([r[k] for r in rows], types[t]) for k, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns])

    return pairs.mapInArrow(run, _schema(pairs, **columns))


def numstat(pairs: DataFrame, mode: str = "exact") -> DataFrame:
    """pairs (old, new) with added and deleted lines, as a whitespace mode sees them; null counts for binary sides."""
    binary = is_binary(F.coalesce("old", F.lit(""))) | is_binary(F.coalesce("new", F.lit("")))
    marked = pairs.withColumn("binary", binary)
    counted = _per_pair(marked, lambda o, n, b: (None, None) if b else linediff.counts(o, n, mode), {"added": "long", "deleted": "long"}, ("old", "new", "binary"))
    return counted


def patches(pairs: DataFrame) -> DataFrame:
    """pairs (path, old, new) with the patch text and its identity."""

    def call(path, old, new):
        text = linediff.patch(path, old, new)
        return text, linediff.patch_id(text)

    return _per_pair(pairs, call, {"patch": "string", "patch_id": "string"}, ("path", "old", "new"))


def rendered(changes: DataFrame, context: int = linediff.CONTEXT) -> DataFrame:
    """changes (path, kind, old_path, old_oid, new_oid, old_mode, new_mode, old, new, score) with the patch text of each, extended headers and all."""
    inputs = ("kind", "path", "old_path", "old_oid", "new_oid", "old_mode", "new_mode", "old", "new", "score")
    return _per_pair(changes, lambda *x: (linediff.rendered(*x, context=context),), {"patch": "string"}, inputs)


def merge(triples: DataFrame, favour: str | None = None) -> DataFrame:
    """triples (base, ours, theirs) with the merged text and the number of conflicts."""
    return _per_pair(triples, lambda b, o, t: linediff.merge(b or "", o or "", t or "", favour=favour), {"merged": "string", "conflicts": "long"}, ("base", "ours", "theirs"))


# --- similarity -----------------------------------------------------------------------------------------------


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, sizes = [], [], []
        for oid, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held: dict[bytes, int] = {}
            for line in linediff.lines_of((content or "").encode()):
                for i in range(0, len(line), 64):
                    c = line[i : i + 64]
                    held[c] = held.get(c, 0) + len(c)
            for c, n in held.items():
                ids.append(oid), hashes.append(int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True)), sizes.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64())], names=["oid", "chunk", "bytes"])


def chunks(blobs: DataFrame) -> DataFrame:
    """(oid, chunk, bytes): pieces that end at a newline or after 64 bytes, with their bytes in the blob."""
    return blobs.select("oid", "content").dropDuplicates(["oid"]).mapInArrow(_chunk_rows, "oid string, chunk long, bytes long")


def similarity(blobs: DataFrame, pairs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(src, dst, score): shared bytes of chunks in 60,000ths of the larger size, for pairs of ids with sizes.

    held: the blobs' chunks, where they are known already.
    """
    c = chunks(blobs) if held is None else held
    left = c.select(F.col("oid").alias("src"), "chunk", F.col("bytes").alias("x"))
    right = c.select(F.col("oid").alias("dst"), "chunk", F.col("bytes").alias("y"))
    shared = pairs.join(left, "src").join(right, ["dst", "chunk"]).groupBy("src", "dst").agg(F.sum(F.least("x", "y")).alias("common"))
    size = blobs.select("oid", "size").dropDuplicates(["oid"])
    sized = pairs.join(size.select(F.col("oid").alias("src"), F.col("size").alias("s")), "src").join(size.select(F.col("oid").alias("dst"), F.col("size").alias("d")), "dst").join(shared, ["src", "dst"], "left")
    most = F.greatest("s", "d")
    return sized.select("src", "dst", F.when(most == 0, 0).otherwise(F.floor(F.coalesce("common", F.lit(0)) * MOST_SCORE / most)).cast("long").alias("score"))


def rename_pairs(deleted: DataFrame, added: DataFrame, held: DataFrame, least: int = RENAME_SCORE) -> DataFrame:
    """(src, dst): ids that may reach the score, least > 0, over (oid, size) and the chunks of all.

    Chunks stand in one order, rare ones first. A blob's head is what has at least the
    share `least` of its bytes from there on. The first chunk that a pair shares is in
    both heads, or the shared bytes wouldn't reach the share of the larger one; so a
    join of the heads finds every pair, and common chunks mostly stay out of it.
    """
    size = deleted.select("oid", "size").unionByName(added.select("oid", "size")).dropDuplicates(["oid"])
    often = held.groupBy("chunk").agg(F.count("*").alias("often"))
    rest = Window.partitionBy("oid").orderBy(F.desc("often"), F.desc("chunk")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.join(often, "chunk").withColumn("rest", F.sum("bytes").over(rest)).join(size, "oid")
    heads = written(ranked.where(F.col("rest") * MOST_SCORE >= F.col("size") * least).select("oid", "chunk", "size"), "heads")
    side = lambda df, oid, n: heads.join(df.select("oid").distinct(), "oid").select(F.col("oid").alias(oid), "chunk", F.col("size").alias(n))
    pairs = side(deleted, "src", "s").join(side(added, "dst", "d"), "chunk")
    return pairs.where(F.least("s", "d") * MOST_SCORE >= F.greatest("s", "d") * least).select("src", "dst").distinct()


def inexact_renames(deleted: DataFrame, added: DataFrame, least: int = RENAME_SCORE, limit: int = LIMIT) -> DataFrame:
    """(src_path, dst_path, score): best pairs first, each path once.

    With more than limit x limit pairs none are looked for; limit 0 takes any number.
    """
    if limit and deleted.count() * added.count() > limit * limit:
        return deleted.sparkSession.createDataFrame([], "src_path string, dst_path string, score long")
    blobs = deleted.unionByName(added)
    held = written(chunks(blobs), "chunks")
    return _best_first(_scored_slots(deleted, added, blobs, held, least).withColumn("copy", F.lit(0))).select("src_path", "dst_path", "score")


def _scored_slots(deleted: DataFrame, added: DataFrame, blobs: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """(src_path, dst_path, score, slot): the pairs that reach the score, up to four a destination."""
    scores = similarity(blobs, written(rename_pairs(deleted, added, held, least), "pairs"), held).where(F.col("score") >= least)
    named = scores.join(deleted.select(F.col("path").alias("src_path"), F.col("oid").alias("src")), "src").join(added.select(F.col("path").alias("dst_path"), F.col("oid").alias("dst")), "dst")
    return named.select("src_path", "dst_path", "score").groupBy("dst_path").applyInPandas(_slots, "src_path string, dst_path string, score long, slot long")


def _slots(rows: pd.DataFrame) -> pd.DataFrame:
    """The sources that a destination keeps, each with its slot."""
    slots: list = []
    for r in rows.sort_values("src_path").itertuples(index=False):
        if len(slots) < KEPT:
            slots.append(r)
            continue
        at = min(range(KEPT), key=lambda i: (slots[i].score, i))  # the earliest of the least
        if r.score > slots[at].score:
            slots[at] = r
    return pd.DataFrame([(r.src_path, r.dst_path, r.score, k) for k, r in enumerate(slots)], columns=["src_path", "dst_path", "score", "slot"])


def _best_first(pairs: DataFrame) -> DataFrame:
    """(src_path, dst_path, score, copy): what is taken when pairs go by score, renames first, destination and slot.

    Each destination is used once, and each source by one rename; copies leave their
    source free. A pair that comes first for all that it uses is taken in any case;
    these go in one round, with all that they rule out, until no pair is left.
    """
    left = written(pairs.withColumn("_key", F.struct((-F.col("score")).alias("s"), "copy", "dst_path", "slot")), "pairs")
    taken = None
    while not left.isEmpty():
        firsts = left.groupBy("dst_path").agg(F.min("_key").alias("_key"))
        sources = left.where("copy = 0").groupBy(F.col("src_path").alias("_s")).agg(F.min("_key").alias("_k"))
        now = left.join(firsts, ["dst_path", "_key"]).join(sources, F.col("src_path") == F.col("_s"), "left").where((F.col("copy") == 1) | (F.col("_key") == F.col("_k")))
        now = written(now.select("src_path", "dst_path", "score", "copy"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        used = now.where("copy = 0").select("src_path", F.lit(0).alias("copy"))
        left = written(left.join(now.select("dst_path"), "dst_path", "left_anti").join(used, ["src_path", "copy"], "left_anti"), "pairs")
    return pairs.select("src_path", "dst_path", "score", "copy").limit(0) if taken is None else taken


BREAK_SCORE, MERGE_SCORE = 30_000, 36_000


def rewrites(modified: DataFrame, blobs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(path, break_score, dissimilarity) of modified (path, old_oid, new_oid): the bytes that went and came, at most the larger size, and the bytes that went, in 60,000ths of the larger and of the old size."""
    c = chunks(blobs) if held is None else held
    size = blobs.select("oid", "size").dropDuplicates(["oid"])
    sized = modified.select("path", "old_oid", "new_oid").join(size.select(F.col("oid").alias("old_oid"), F.col("size").alias("s")), "old_oid").join(size.select(F.col("oid").alias("new_oid"), F.col("size").alias("d")), "new_oid")
    left = c.select(F.col("oid").alias("old_oid"), "chunk", F.col("bytes").alias("x"))
    right = c.select(F.col("oid").alias("new_oid"), "chunk", F.col("bytes").alias("y"))
    shared = sized.select("old_oid", "new_oid").distinct().join(left, "old_oid").join(right, ["new_oid", "chunk"]).groupBy("old_oid", "new_oid").agg(F.sum(F.least("x", "y")).alias("common"))
    j = sized.join(shared, ["old_oid", "new_oid"], "left")
    common, most = F.coalesce("common", F.lit(0)), F.greatest("s", "d")
    gone = F.least(F.col("s") + F.col("d") - 2 * common, most)
    part = lambda x, of: F.when(of == 0, 0).otherwise(F.floor(x * MOST_SCORE / of)).cast("long")
    return j.select("path", part(gone, most).alias("break_score"), part(F.col("s") - common, F.col("s")).alias("dissimilarity"))


def renames(diff: DataFrame, blobs: DataFrame, least: int = RENAME_SCORE, copies: str = "off", copy_least: int | None = None, breaks: tuple[int, int] | None = None, preimage: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(path, kind, old_path, old_oid, new_oid, score) of a diff (path, kind, old_oid, new_oid): its adds as renames and copies where contents are alike.

    breaks (break score, merge score; a merge score of 0 is the usual one) first takes
    rewritten files apart into a delete and an add; what finds no partner becomes a
    modify again, with its dissimilarity as score from the merge score on. Then equal
    ids, as in ``snapshot.exact_renames``; then alike ones. copies "on" also looks at
    the old versions of changed files, "harder" at all of `preimage` (path, oid). With
    more than limit x limit pairs of adds and sources none are looked for, or with
    "harder" only those of "on"; limit 0 takes any number.
    """
    from .snapshot import exact_renames

    held = written(chunks(blobs), "chunks")
    size = blobs.select("oid", "size", "content").dropDuplicates(["oid"])
    work, broken = diff.select("path", "kind", "old_oid", "new_oid"), None
    if breaks is not None:
        scored = rewrites(work.where("kind = 'modify'"), blobs, held).where(F.col("break_score") >= (breaks[0] or BREAK_SCORE))
        broken = written(work.where("kind = 'modify'").join(scored.select("path", "dissimilarity"), "path"), "broken")
        halves = broken.select("path", F.lit("delete").alias("kind"), "old_oid", F.lit(None).cast("string").alias("new_oid")).unionByName(broken.select("path", F.lit("add").alias("kind"), F.lit(None).cast("string").alias("old_oid"), "new_oid"))
        work = work.join(broken.select("path", "kind"), ["path", "kind"], "left_anti").unionByName(halves)
    exact = written(exact_renames(work), "exact")
    adds = exact.where("kind = 'add'").select("path", F.col("new_oid").alias("oid")).join(size, "oid")
    gone = exact.where("kind = 'delete'").select("path", F.col("old_oid").alias("oid")).join(size, "oid")
    changed = gone.unionByName(exact.where("kind in ('modify', 'type-change')").select("path", F.col("old_oid").alias("oid")).join(size, "oid"))
    whole = None if preimage is None else preimage.select("path", "oid").join(size, "oid")
    sources = {"off": None, "on": changed, "harder": whole}[copies]
    few = lambda n: not limit or adds.count() * n <= limit * limit
    if copies == "harder" and not few(sources.count()):
        sources = changed
    pairs = []
    if few(gone.count() if sources is None else sources.count()):
        pairs.append(_scored_slots(gone, adds, blobs, held, least).withColumn("copy", F.lit(0)))
        if sources is not None:
            pairs.append(_scored_slots(sources, adds, blobs, held, copy_least or least).withColumn("copy", F.lit(1)))
    out = exact.withColumn("score", F.when(F.col("kind") == "rename", MOST_SCORE).cast("long"))
    if pairs:
        taken = written(_best_first(pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])), "matched")
        kind = F.when(F.col("copy") == 1, "copy").otherwise("rename")
        old = diff.where("old_oid is not null").select(F.col("path").alias("src_path"), "old_oid")
        if preimage is not None:
            old = old.unionByName(preimage.select(F.col("path").alias("src_path"), F.col("oid").alias("old_oid"))).dropDuplicates(["src_path"])
        found = taken.join(old, "src_path").join(adds.select(F.col("path").alias("dst_path"), F.col("oid").alias("new_oid")), "dst_path")
        found = found.select(F.col("dst_path").alias("path"), kind.alias("kind"), F.col("src_path").alias("old_path"), "old_oid", "new_oid", "score")
        used = taken.where("copy = 0").select(F.col("src_path").alias("path"), F.lit("delete").alias("kind")).unionByName(taken.select(F.col("dst_path").alias("path"), F.lit("add").alias("kind")))
        out = out.join(used, ["path", "kind"], "left_anti").select(*out.columns).unionByName(found.select(*out.columns))
    if broken is None:
        return out
    out = written(out, "renamed")
    halves = out.where("kind in ('delete', 'add')").join(broken.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("n")).where("n = 2").select("path")
    back = broken.join(halves, "path").select("path", F.lit("modify").alias("kind"), F.lit(None).cast("string").alias("old_path"), "old_oid", "new_oid", F.when(F.col("dissimilarity") >= (breaks[1] or MERGE_SCORE), F.col("dissimilarity")).alias("score"))
    kept = out.join(halves.withColumn("_b", F.lit(True)), "path", "left").where("not (kind in ('delete', 'add') and coalesce(_b, false))")
    return kept.select(*out.columns).unionByName(back.select(*out.columns))


# --- histories of one file ------------------------------------------------------------------------------------


def _blame(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("version")
    texts = rows["content"].tolist()
    origin = linediff.blame(texts)
    names = rows["version"].tolist()
    return pd.DataFrame({"file": rows["file"].iloc[0], "line": range(1, len(origin) + 1), "origin": [names[v] for v in origin]})


def blame(versions: DataFrame) -> DataFrame:
    """(file, line, origin): the version that each line of a file's last version came with; a file's history is one group."""
    return versions.groupBy("file").applyInPandas(_blame, "file long, line long, origin long")


def steps(versions: DataFrame) -> DataFrame:
    """(file, version, old, new): each version beside the one before it."""
    w = Window.partitionBy("file").orderBy("version")
    return versions.select("file", "version", F.lag("content").over(w).alias("old"), F.col("content").alias("new"))


def range_diff(series: DataFrame) -> DataFrame:
    """(series, old, new, status) of rows (series, side, n, patch), side "old" or "new"; one group a series."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        old, new = (rows.loc[rows["side"] == s, "patch"].tolist() for s in ("old", "new"))
        found = linediff.correspond(old, new)
        return pd.DataFrame({"series": rows["series"].iloc[0], "old": pd.array([x[0] for x in found], "Int64"), "new": pd.array([x[1] for x in found], "Int64"), "status": [x[2] for x in found]})

    return series.groupBy("series").applyInPandas(one, "series long, old long, new long, status string")
