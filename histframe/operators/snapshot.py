"""Snapshot algebra: joins on path, classification, tree and index differences, three-way merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histframe.functions.scalar import mode_kind, parent_dir

from .ordered import lagged


def _slots(sources: dict[str, DataFrame]) -> list[DataFrame]:
    """Each source as (path, occ, slot): rows of one path are numbered by stage, since the join pairs occurrences."""
    out = []
    for name, df in sources.items():
        order = F.col("stage") if "stage" in df.columns else F.lit(0)
        occ = F.row_number().over(Window.partitionBy("path").orderBy(order)) if "stage" in df.columns else F.lit(1)
        out.append(df.select("path", occ.alias("occ"), F.struct(*(c for c in df.columns if c != "path")).alias(name)))
    return out


def outer_join(**sources: DataFrame) -> DataFrame:
    """(path, occ, a struct for each source): full outer, the n-th row of a path with the n-th row of the others.

    Two sources are joined. More are put under each other and gathered by path, which
    shuffles every row once, where a chain of outer joins would shuffle its results again.
    """
    slots = _slots(sources)
    if len(slots) < 3:
        return reduce(lambda a, b: a.join(b, ["path", "occ"], "full_outer"), slots)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), slots)
    return rows.groupBy("path", "occ").agg(*(F.max(name).alias(name) for name in sources))


def inner_join(**sources: DataFrame) -> DataFrame:
    """(path, a struct for each source) where every source has the path; first occurrences only."""
    return reduce(lambda a, b: a.join(b, "path"), (s.where("occ = 1").drop("occ") for s in _slots(sources)))


def same_entry(a: str, b: str) -> Column:
    return (F.col(f"{a}.oid") == F.col(f"{b}.oid")) & (F.col(f"{a}.mode") == F.col(f"{b}.mode"))


def change_kind(old: str, new: str) -> Column:
    """add, delete, type-change, modify, or null for none."""
    o, n = F.col(old), F.col(new)
    return (
        F.when(o.isNull() & n.isNull(), None).when(o.isNull(), "add").when(n.isNull(), "delete").when(same_entry(old, new), None)
        .when(mode_kind(F.col(f"{old}.mode")) != mode_kind(F.col(f"{new}.mode")), "type-change").otherwise("modify")
    )


def _flat(joined: DataFrame, old: str, new: str) -> DataFrame:
    return joined.select("path", change_kind(old, new).alias("kind"), *(F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in ((old, "old"), (new, "new")) for c in ("oid", "mode"))).where("kind is not null")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, old_oid, old_mode, new_oid, new_mode) of the paths that differ."""
    return _flat(outer_join(old=old, new=new), "old", "new")


def index_diff(index: DataFrame, tree: DataFrame) -> DataFrame:
    """The stage-0 index against a tree."""
    return tree_diff(tree, index.where("stage = 0").drop("stage"))


def status(head: DataFrame, index: DataFrame, workdir: DataFrame) -> DataFrame:
    """(path, staged, unstaged, untracked, unmerged): one record for each path that isn't clean.

    staged: head to index, `mode-changed` where only the mode differs. unstaged: index
    to working copy. A path with conflict stages is only unmerged. All rows of a path
    are gathered at once, so that each is shuffled once.
    """
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, source: str, stage: Column) -> DataFrame:
        columns = [c for s in ("head", "index", "workdir") for c in ((F.col("oid") if s == source else none).alias(f"{s}_oid"), (F.col("mode") if s == source else none).alias(f"{s}_mode"))]
        return df.select("path", stage.alias("stages"), *columns)

    no = F.lit(0)
    # the bits of stages 1 to 3; the rows of stage 0 have the index's columns
    open_ = index.where("stage > 0").select("path", F.when(F.col("stage") == 1, 1).when(F.col("stage") == 2, 2).otherwise(4).alias("stages"), *(none.alias(f"{s}_{c}") for s in ("head", "index", "workdir") for c in ("oid", "mode")))
    every = rows(head, "head", no).unionByName(rows(index.where("stage = 0"), "index", no)).unionByName(rows(workdir, "workdir", no)).unionByName(open_)
    one = every.groupBy("path").agg(F.bit_or("stages").alias("stages"), *(F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in ("head", "index", "workdir") for c in ("oid", "mode")))
    j = one.select("path", "stages", *(F.when(F.col(f"{s}_oid").isNotNull(), F.struct(F.col(f"{s}_oid").alias("oid"), F.col(f"{s}_mode").alias("mode"))).alias(s) for s in ("head", "index", "workdir")))
    clear, bit = F.col("stages") == 0, lambda n: F.col("stages").bitwiseAND(n) != 0
    only_mode = lambda a, b: (F.col(f"{a}.oid") == F.col(f"{b}.oid")) & (F.col(f"{a}.mode") != F.col(f"{b}.mode"))
    kind = lambda a, b: F.when(only_mode(a, b) & (mode_kind(F.col(f"{a}.mode")) == mode_kind(F.col(f"{b}.mode"))), "mode-changed").otherwise(change_kind(a, b))
    out = j.select(
        "path", F.when(clear, kind("head", "index")).alias("staged"), F.when(clear & F.col("index").isNotNull(), kind("index", "workdir")).alias("unstaged"),
        (clear & F.col("index").isNull() & F.col("workdir").isNotNull()).alias("untracked"), F.when(~clear, unmerged_kind(bit(1), bit(2), bit(4))).alias("unmerged"),
    )
    return out.where("staged is not null or unstaged is not null or untracked or unmerged is not null")


def unmerged_entries(index: DataFrame) -> DataFrame:
    """(path, kind, base_oid, ours_oid, theirs_oid) of the paths with stages 1 to 3."""
    p = index.where("stage > 0").groupBy("path").pivot("stage", [1, 2, 3]).agg(F.first("oid"))
    return p.select("path", unmerged_kind(F.col("1").isNotNull(), F.col("2").isNotNull(), F.col("3").isNotNull()).alias("kind"), F.col("1").alias("base_oid"), F.col("2").alias("ours_oid"), F.col("3").alias("theirs_oid"))


def unmerged_kind(base: Column, ours: Column, theirs: Column) -> Column:
    return (
        F.when(base & ours & theirs, "both-modified").when(ours & theirs, "both-added").when(base & ours, "deleted-by-them").when(base & theirs, "deleted-by-us")
        .when(base, "both-deleted").when(ours, "added-by-us").otherwise("added-by-them")
    )


def changeset(index: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action): what makes the stage-0 index equal to a tree: add, update, delete or noop."""
    j = outer_join(old=index.where("stage = 0").drop("stage"), new=target)
    return j.select("path", F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(same_entry("old", "new"), "noop").otherwise("update").alias("action"))


def would_overwrite(changed: DataFrame, index: DataFrame, workdir: DataFrame) -> DataFrame:
    """(path, reason): changed paths whose working copy would be lost: `modified` against the index, or `untracked`."""
    zero = index.where("stage = 0").select("path", F.struct("oid", "mode").alias("i"))
    disk = workdir.select("path", F.struct("oid", "mode").alias("w"))
    j = changed.select("path").distinct().join(zero, "path", "left").join(disk, "path", "left")
    return j.select("path", F.when(F.col("w").isNull(), None).when(F.col("i").isNull(), "untracked").when(F.col("i") != F.col("w"), "modified").alias("reason")).where("reason is not null")


def workdir_delta(index: DataFrame, workdir: DataFrame) -> DataFrame:
    """(path, delta) of each stage-0 entry: absent, type-changed, modified, mode-changed or unchanged."""
    j = index.where("stage = 0").select("path", F.struct("oid", "mode").alias("i")).join(workdir.select("path", F.struct("oid", "mode").alias("w")), "path", "left")
    delta = (
        F.when(F.col("w").isNull(), "absent").when(mode_kind(F.col("i.mode")) != mode_kind(F.col("w.mode")), "type-changed")
        .when(F.col("i.oid") != F.col("w.oid"), "modified").when(F.col("i.mode") != F.col("w.mode"), "mode-changed").otherwise("unchanged")
    )
    return j.select("path", delta.alias("delta"))


def verify(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows with _raced: whether a second scan saw another oid or mode, or nothing."""
    b = again.select("path", F.struct("oid", "mode").alias("_b"))
    return rows.join(b, "path", "left").withColumn("_raced", ~F.coalesce(F.struct("oid", "mode") == F.col("_b"), F.lit(False))).drop("_b")


def merge_trees(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, outcome, oid, mode, conflict): three-way merge by path; rows for content-merge are left to ``content.merge``."""
    j = outer_join(b=base, o=ours, t=theirs)
    b, o, t = (F.col(x).isNotNull() for x in "bot")
    eq = lambda x, y: F.coalesce(same_entry(x, y), F.lit(False))
    kind = lambda x: mode_kind(F.col(f"{x}.mode"))
    link = lambda x: kind(x) == "symlink"
    git = lambda x: F.coalesce(kind(x) == "gitlink", F.lit(False))
    regular = lambda x: kind(x) == "file"
    ladder = [
        (~o & ~t, "resolved-deleted", None, None),
        (~b & ~(o & t), "resolved-known", "side", None),
        (b & ~(o & t) & (eq("o", "b") | eq("t", "b")), "resolved-deleted", None, None),
        (b & ~(o & t), "conflict", None, "modify-delete"),
        (~b & eq("o", "t"), "resolved-known", "o", None),
        (~b & ((regular("o") & link("t")) | (link("o") & regular("t"))), "conflict", None, "distinct-types"),
        (~b & ~(regular("o") & regular("t")), "conflict", None, "add-add"),
        (~b, "content-merge", None, None),
        (eq("o", "b") & eq("t", "b"), "unchanged", "o", None),
        (eq("o", "b"), "resolved-known", "t", None),
        (eq("t", "b"), "resolved-known", "o", None),
        (eq("o", "t"), "resolved-known", "o", None),
        ((git("o") | git("t")) & git("b") & git("o") & git("t"), "conflict", None, "gitlink"),
        (git("o") | git("t"), "conflict", None, "type-change"),
        (link("o") & link("t"), "conflict", None, "content"),
        (link("o") != link("t"), "conflict", None, F.when(git("b"), "type-change").otherwise("distinct-types")),
    ]
    outcome, conflict, pick = (F.lit("content-merge"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    for test, name, side, why in reversed(ladder):
        outcome = F.when(test, name).otherwise(outcome)
        conflict = F.when(test, F.lit(why) if why is None or isinstance(why, str) else why).otherwise(conflict)
        pick = F.when(test, F.when(o, "o").otherwise("t") if side == "side" else F.lit(side)).otherwise(pick)
    take = lambda c: F.when(F.col("pick") == "o", F.col(f"o.{c}")).when(F.col("pick") == "t", F.col(f"t.{c}"))
    return j.withColumns({"outcome": outcome, "conflict": conflict, "pick": pick}).select("path", "outcome", take("oid").alias("oid"), take("mode").alias("mode"), "conflict")


def exact_renames(diff: DataFrame) -> DataFrame:
    """The diff with deletes and adds of one id as renames.

    An id with exactly one delete feeds every add that has it; its delete goes once it
    is used. Rows: (path, kind, old_path, old_oid, new_oid).
    """
    deletes = diff.where("kind = 'delete'").groupBy("old_oid").agg(F.count("*").alias("n"), F.first("path").alias("source")).where("n = 1").select(F.col("old_oid").alias("id"), "source")
    adds = diff.where("kind = 'add'").select("path", "new_oid").join(deletes, F.col("new_oid") == F.col("id"), "left")
    renamed = adds.select("path", F.when(F.col("source").isNull(), "add").otherwise("rename").alias("kind"), F.col("source").alias("old_path"), F.col("id").alias("old_oid"), "new_oid")
    used = renamed.where("kind = 'rename'").select(F.col("old_path").alias("path")).distinct()
    kept = diff.where("kind != 'add'").join(used.withColumn("gone", F.lit(True)), "path", "left").where("not (kind = 'delete' and coalesce(gone, false))")
    return renamed.unionByName(kept.select("path", "kind", F.lit(None).cast("string").alias("old_path"), "old_oid", "new_oid"))


def group_by_dir(rows: DataFrame) -> DataFrame:
    """(dir, first_path, last_path, n) of each run of rows, in path order, that share a directory."""
    r = lagged(rows.select("path", parent_dir(F.col("path")).alias("dir")), "dir", "path")
    starts = r.withColumn("starts", ~F.col("previous").eqNullSafe(F.col("dir")))
    # a run's number: starts so far in its range and in those before
    inside = Window.partitionBy("_range").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    runs = starts.withColumn("s", F.sum(F.col("starts").cast("int")).over(inside))
    per = runs.groupBy("_range").agg(F.sum(F.col("starts").cast("int")).alias("k"))
    offsets = per.select("_range", F.coalesce(F.sum("k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("k0"))
    return runs.join(F.broadcast(offsets), "_range").groupBy("dir", (F.col("s") + F.col("k0")).alias("run")).agg(F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.count("*").alias("n")).drop("run")


def out_of_order(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """(pos, path, previous): rows whose path comes before that of the row in front."""
    return lagged(rows.select(pos, "path"), "path", pos).where("path < previous").select(pos, "path", "previous")


def walk_tree(tree: DataFrame) -> DataFrame:
    """(path, kind, depth): every leaf and every directory above one."""
    parts = tree.select("path", F.split("path", "/").alias("p"), F.col("mode"))
    dirs = parts.where(F.size("p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice(F.col("p"), F.lit(1), i), "/"))).alias("path")).distinct()
    depth = F.size(F.split("path", "/")).cast("long")
    return tree.select("path", mode_kind(F.col("mode")).alias("kind"), depth.alias("depth")).unionByName(dirs.select("path", F.lit("directory").alias("kind"), depth.alias("depth")))
