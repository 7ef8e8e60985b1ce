"""State changes as pure functions from tables to tables: staging, resetting, committing, refs, stash, notes, sparse sets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import pruned
from .snapshot import merge_trees, outer_join, would_overwrite

EMPTY_TREE = hashlib.sha1(b"tree 0\0").hexdigest()


@dataclass(frozen=True)
class State:
    """index (path, stage, oid, mode), workdir (path, oid, mode), refs (name, oid), reflog (ref, seq, old_oid, new_oid, ts, message)."""

    index: DataFrame
    workdir: DataFrame
    refs: DataFrame
    reflog: DataFrame


class Refused(ValueError):
    """A change that would lose content."""


def _replaced(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with stage-0 rows put in the place of all stages of their paths."""
    return index.join(rows.select("path"), "path", "left_anti").unionByName(rows.select("path", F.lit(0).alias("stage"), "oid", "mode"))


def add(state: State, where: Column, ignore: list[tuple[str, str, str]] | None = None) -> State:
    """Stage the working copy's rows that `where` selects; tracked paths that are gone are unstaged, ignored new ones skipped."""
    chosen = state.workdir.where(where)
    tracked = state.index.select("path").distinct()
    if ignore:
        # what lies in an ignored directory is ignored
        chosen = chosen.where(~pruned(F.col("path"), ignore)).unionByName(chosen.where(pruned(F.col("path"), ignore)).join(tracked, "path", "left_semi"))
    gone = state.index.where(where).select("path").distinct().join(state.workdir.select("path"), "path", "left_anti")
    return replace(state, index=_replaced(state.index.join(gone, "path", "left_anti"), chosen))


def remove(state: State, head: DataFrame, where: Column, cached: bool = False, force: bool = False) -> State:
    """Take paths out of the index, and out of the working copy unless cached; refuses where content would be lost."""
    chosen = state.index.where(where).select("path").distinct()
    if not force:
        zero = state.index.where("stage = 0").drop("stage")
        j = outer_join(head=head, index=zero, workdir=state.workdir).join(chosen, "path", "left_semi")
        staged = F.col("head").isNull() | (F.col("head") != F.col("index"))
        local = F.col("workdir").isNotNull() & (F.col("workdir") != F.col("index"))
        lost = j.where(staged & local if cached else staged | local)
        if not lost.isEmpty():
            raise Refused("local or staged changes would be lost")
    workdir = state.workdir if cached else state.workdir.join(chosen, "path", "left_anti")
    return replace(state, index=state.index.join(chosen, "path", "left_anti"), workdir=workdir)


def move(state: State, source: str, target: str) -> State:
    """Rename a path, or all under a directory, in index and working copy; ids stay."""
    path = F.col("path")
    under = (path == source) | path.startswith(source + "/")
    renamed = F.when(under, F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 20))).otherwise(path)
    if not state.index.where((path == target) | path.startswith(target + "/")).isEmpty():
        raise Refused(f"{target} exists")
    return replace(state, index=state.index.withColumn("path", renamed), workdir=state.workdir.withColumn("path", renamed))


def reset(state: State, tree: DataFrame, ref: str, oid, ts: int, mode: str = "mixed") -> State:
    """Point a ref at a commit; mixed also sets the index to its tree, hard the working copy's tracked paths too."""
    state = update_ref(state, ref, oid, ts, f"reset: moving to {oid}")
    if mode == "soft":
        return state
    index = tree.select("path", F.lit(0).alias("stage"), "oid", "mode")
    if mode == "mixed":
        return replace(state, index=index)
    untracked = state.workdir.join(state.index.select("path").distinct(), "path", "left_anti").join(tree.select("path"), "path", "left_anti")
    return replace(state, index=index, workdir=untracked.unionByName(tree.select("path", "oid", "mode")))


def checkout(state: State, tree: DataFrame) -> State:
    """Go to a tree, keeping local changes to paths that it doesn't change; refuses to overwrite others."""
    zero = state.index.where("stage = 0").drop("stage")
    changed = outer_join(old=zero, new=tree).where(~F.col("old").eqNullSafe(F.col("new"))).select("path")
    if not would_overwrite(changed, state.index, state.workdir).isEmpty():
        raise Refused("local changes would be overwritten")
    kept = state.workdir.join(changed, "path", "left_anti")
    return replace(state, index=tree.select("path", F.lit(0).alias("stage"), "oid", "mode"), workdir=kept.unionByName(tree.join(changed, "path", "left_semi").select("path", "oid", "mode")))


def update_ref(state: State, ref: str, oid, ts: int, message: str, expected=None) -> State:
    """Set a ref and note it in its log; with `expected` only if it stands there."""
    old = state.refs.where(F.col("name") == ref).limit(1).collect()
    before = old[0].oid if old else None
    if expected is not None and before != expected:
        raise Refused(f"{ref} is at {before}")
    spark = state.refs.sparkSession
    refs = state.refs.where(F.col("name") != ref).unionByName(spark.createDataFrame([(ref, oid)], state.refs.select("name", "oid").schema))
    last = state.reflog.where(F.col("ref") == ref).agg(F.max("seq")).first()[0]
    entry = spark.createDataFrame([(ref, 0 if last is None else last + 1, before, oid, ts, message)], state.reflog.select("ref", "seq", "old_oid", "new_oid", "ts", "message").schema)
    return replace(state, refs=refs, reflog=state.reflog.unionByName(entry))


def delete_ref(state: State, ref: str) -> State:
    return replace(state, refs=state.refs.where(F.col("name") != ref), reflog=state.reflog.where(F.col("ref") != ref))


def rename_ref(state: State, old: str, new: str) -> State:
    if not state.refs.where(F.col("name") == new).isEmpty():
        raise Refused(f"{new} exists")
    to = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    return replace(state, refs=state.refs.withColumn("name", to("name")), reflog=state.reflog.withColumn("ref", to("ref")))


def tree_oid(index: DataFrame) -> str:
    """The id of the tree that the stage-0 index describes, hashed from the deepest directory up."""
    level = index.where("stage = 0").select("path", "mode", "oid")
    while True:
        deep = level.agg(F.max(F.size(F.split("path", "/")))).first()[0]
        if deep is None:
            return EMPTY_TREE
        here = level.where(F.size(F.split("path", "/")) == deep)
        name = F.substring_index("path", "/", -1)
        # a directory sorts as if its name ended in a slash
        order = F.encode(F.when(F.col("mode") == "40000", F.concat(name, F.lit("/"))).otherwise(name), "UTF-8")
        entry = F.concat(F.encode(F.concat("mode", F.lit(" "), name), "UTF-8"), F.lit(bytearray(b"\0")), F.unhex("oid"))
        raw = F.aggregate(F.array_sort(F.collect_list(F.struct(order.alias("k"), entry.alias("e")))), F.lit(bytearray(b"")), lambda acc, x: F.concat(acc, x["e"]))
        made = here.groupBy(F.expr("array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1), '/')").alias("path")).agg(raw.alias("raw"))
        size = F.encode(F.concat(F.lit("tree "), F.octet_length("raw").cast("string")), "UTF-8")
        trees = made.select("path", F.lit("40000").alias("mode"), F.sha1(F.concat(size, F.lit(bytearray(b"\0")), "raw")).alias("oid"))
        if deep == 1:
            return trees.first().oid
        level = level.where(F.size(F.split("path", "/")) < deep).unionByName(trees)


def commit_oid(tree: str, parents: list[str], author: str, committer: str, message: str) -> str:
    """The id of a commit; identities are lines "Name <mail> seconds zone"."""
    body = f"tree {tree}\n" + "".join(f"parent {p}\n" for p in parents) + f"author {author}\ncommitter {committer}\n\n{message}"
    raw = body.encode()
    return hashlib.sha1(b"commit %d\0" % len(raw) + raw).hexdigest()


def commit(state: State, ref: str, author: str, message: str, ts: int) -> tuple[State, str]:
    """The state with a commit of the index on a ref, and its id; refuses an index with conflicts."""
    if not state.index.where("stage > 0").isEmpty():
        raise Refused("the index has conflicts")
    old = state.refs.where(F.col("name") == ref).limit(1).collect()
    oid = commit_oid(tree_oid(state.index), [old[0].oid] if old else [], author, author, message)
    return update_ref(state, ref, oid, ts, f"commit{'' if old else ' (initial)'}: {message.split(chr(10))[0]}"), oid


def merge_into(state: State, base: DataFrame, ours: DataFrame, theirs: DataFrame) -> State:
    """The index after a three-way merge by path: resolved rows at stage 0, conflicts and content merges at stages 1 to 3.

    Picking a commit is base = its parent; reverting one is base = it, theirs = its parent.
    """
    m = merge_trees(base, ours, theirs)
    zero = m.where("outcome in ('resolved-known', 'unchanged')").select("path", F.lit(0).alias("stage"), "oid", "mode")
    open_ = m.where("outcome in ('conflict', 'content-merge')").select("path")
    staged = [t.join(open_, "path", "left_semi").select("path", F.lit(k).alias("stage"), "oid", "mode") for k, t in ((1, base), (2, ours), (3, theirs))]
    return replace(state, index=zero.unionByName(staged[0]).unionByName(staged[1]).unionByName(staged[2]))


def stash_push(state: State, head: DataFrame, oid: str, ts: int, message: str) -> State:
    """Note the stash and take index and tracked working copy back to head."""
    state = update_ref(state, "refs/stash", oid, ts, message)
    log = state.reflog
    back = reset(state, head, "refs/stash", oid, ts, "hard")
    return replace(back, reflog=log)


def stash_drop(state: State, n: int) -> State:
    """Drop stash@{n}; the entry after it takes over its old id and the ref stands at the newest left."""
    from .logs import without

    own = F.col("ref") == "refs/stash"
    left = without(state.reflog.where(own), n)
    tip = left.orderBy(F.desc("seq")).limit(1).collect()
    refs = state.refs.where(F.col("name") != "refs/stash")
    if tip:
        refs = refs.unionByName(refs.sparkSession.createDataFrame([("refs/stash", tip[0].new_oid)], refs.select("name", "oid").schema))
    return replace(state, refs=refs, reflog=state.reflog.where(~own).unionByName(left))


def note_add(notes: DataFrame, object_oid: str, note_oid: str, force: bool = False) -> DataFrame:
    if not force and not notes.where(F.col("object_oid") == object_oid).isEmpty():
        raise Refused(f"{object_oid} has a note")
    return note_remove(notes, object_oid).unionByName(notes.sparkSession.createDataFrame([(object_oid, note_oid)], notes.schema))


def note_remove(notes: DataFrame, object_oid: str) -> DataFrame:
    return notes.where(F.col("object_oid") != object_oid)


def sparse_apply(state: State, inside: Column) -> tuple[State, DataFrame]:
    """The working copy without what the sparse set leaves out, and the index with skip_worktree; changed files stay."""
    index = state.index.withColumn("skip_worktree", ~inside)
    clean = state.index.where("stage = 0").where(~inside).select("path", "oid", "mode")
    kept = state.workdir.join(clean, ["path", "oid", "mode"], "left_anti")
    back = index.where("not skip_worktree and stage = 0").select("path", "oid", "mode").join(state.workdir.select("path"), "path", "left_anti")
    return replace(state, workdir=kept.unionByName(back)), index


def config_set(config: DataFrame, scope: int, key: str, value: str | None) -> DataFrame:
    """One value for a key in a scope in place of those it had there."""
    order = config.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0] + 1
    row = config.sparkSession.createDataFrame([(scope, order, key, value)], config.select("scope_rank", "ord", "key", "value").schema)
    return config_unset(config, scope, key).unionByName(row)


def config_unset(config: DataFrame, scope: int, key: str) -> DataFrame:
    return config.where((F.col("scope_rank") != scope) | (F.col("key") != key))


def config_rename_section(config: DataFrame, scope: int, old: str, new: str) -> DataFrame:
    hit = (F.col("scope_rank") == scope) & F.col("key").startswith(old + ".")
    return config.withColumn("key", F.when(hit, F.concat(F.lit(new), F.substring("key", len(old) + 1, 1 << 20))).otherwise(F.col("key")))
