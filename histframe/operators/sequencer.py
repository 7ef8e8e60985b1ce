"""Replaying commits: picking, reverting, rebasing, stashes, and going on after conflicts.

A pick of a commit is the three-way merge whose base is its parent; a revert swaps the
two. What is still to do is a small table, so that a run that stopped at a conflict can
go on, skip or go back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import rev_list
from .snapshot import merge_trees
from .transitions import Refused, State, commit, merge_into, reset, update_ref


def pick(head: DataFrame, parent: DataFrame, commit_tree: DataFrame) -> DataFrame:
    """(path, outcome, oid, mode, conflict): what a commit changed, onto head; all three are (path, oid, mode)."""
    return merge_trees(parent, head, commit_tree)


def revert(head: DataFrame, parent: DataFrame, commit_tree: DataFrame) -> DataFrame:
    """The same with the commit as base: its changes are taken back."""
    return merge_trees(commit_tree, head, parent)


def rebase_todo(edges: DataFrame, commits: DataFrame, patch_ids: DataFrame, branch: DataFrame, upstream: DataFrame) -> DataFrame:
    """(oid, ts): what a rebase replays, oldest first by ts: the branch's commits that the upstream lacks, without merges and without those whose patch the upstream has.

    branch and upstream are tips (oid); patch_ids (oid, patch_id).
    """
    own = rev_list(edges, branch, upstream)
    theirs = rev_list(edges, upstream, branch).join(patch_ids, "oid").select("patch_id").distinct()
    merges = edges.where("idx = 1").select(F.col("child").alias("oid"))
    fresh = own.join(merges, "oid", "left_anti").join(patch_ids, "oid", "left").join(theirs, "patch_id", "left_anti")
    return fresh.join(commits.select("oid", "ts"), "oid").select("oid", "ts")


@dataclass(frozen=True)
class Run:
    """A replay: the state, the ref, what is left as (oid, parent tree, tree, message), where the ref stood, and whether it stopped."""

    state: State
    ref: str
    todo: tuple[tuple[str, DataFrame, DataFrame, str], ...]
    began: str
    kind: str
    stopped: bool = False


def _tree(state: State) -> DataFrame:
    return state.index.where("stage = 0").select("path", "oid", "mode")


def _tip(state: State, ref: str) -> str | None:
    found = state.refs.where(F.col("name") == ref).limit(1).collect()
    return found[0].oid if found else None


def start(state: State, ref: str, todo: list[tuple[str, DataFrame, DataFrame, str]], who: str, ts: int, kind: str = "cherry-pick", onto: tuple[str, DataFrame] | None = None) -> Run:
    """Replay commits onto the ref, or for a rebase onto another (oid, tree) first; stops at the first conflict."""
    if not state.index.where("stage > 0").isEmpty():
        raise Refused("the index has conflicts")
    began = _tip(state, ref)
    if onto is not None:
        state = reset(state, onto[1], ref, onto[0], ts, "hard")
    return _on(Run(state, ref, tuple(todo), began, kind), who, ts)


def _on(run: Run, who: str, ts: int) -> Run:
    while run.todo and not run.stopped:
        _, parent, tree, message = run.todo[0]
        head = _tree(run.state)
        base, theirs = (tree, parent) if run.kind == "revert" else (parent, tree)
        state = merge_into(run.state, base, head, theirs)
        if not state.index.where("stage > 0").isEmpty():
            return replace(run, state=state, stopped=True)
        text = f'Revert "{message.split(chr(10))[0]}"\n' if run.kind == "revert" else message
        state, _ = commit(state, run.ref, who, text, ts)
        run = replace(run, state=state, todo=run.todo[1:])
    return run


def go_on(run: Run, index: DataFrame, who: str, ts: int) -> Run:
    """After a conflict was settled in `index`: commit it and replay the rest."""
    if not run.stopped:
        raise Refused("nothing stopped")
    state, _ = commit(replace(run.state, index=index), run.ref, who, run.todo[0][3], ts)
    return _on(replace(run, state=state, todo=run.todo[1:], stopped=False), who, ts)


def skip(run: Run, head: DataFrame, who: str, ts: int) -> Run:
    """Leave the commit that stopped and replay the rest onto head."""
    index = head.select("path", F.lit(0).alias("stage"), "oid", "mode")
    return _on(replace(run, state=replace(run.state, index=index), todo=run.todo[1:], stopped=False), who, ts)


def abort(run: Run, tree: DataFrame, ts: int) -> State:
    """Back to where the ref stood, whose tree is given."""
    return reset(run.state, tree, run.ref, run.began, ts, "hard")


def merge_abort(state: State, head: DataFrame) -> State:
    """The index of head again; the working copy's files without conflicts stay."""
    return replace(state, index=head.select("path", F.lit(0).alias("stage"), "oid", "mode"))


def merge_continue(state: State, ref: str, who: str, message: str, ts: int) -> tuple[State, str]:
    """Commit a merge whose conflicts are settled."""
    return commit(state, ref, who, message, ts)


def stash_apply(state: State, base: DataFrame, stashed: DataFrame) -> State:
    """A stash's working tree merged into the working copy: base is the tree that it was made on. Refuses where a path would conflict."""
    m = merge_trees(base, state.workdir, stashed)
    if not m.where("outcome in ('conflict', 'content-merge')").isEmpty():
        raise Refused("the stash conflicts with the working copy")
    return replace(state, workdir=m.where("outcome in ('resolved-known', 'unchanged')").select("path", "oid", "mode"))


def set_symbolic(refs: DataFrame, name: str, target: str) -> DataFrame:
    """refs (name, oid, symbolic) where `name` leads to another ref."""
    row = refs.sparkSession.createDataFrame([(name, None, target)], refs.select("name", "oid", "symbolic").schema)
    return refs.where(F.col("name") != name).select("name", "oid", "symbolic").unionByName(row)


def tag(state: State, name: str, oid: str, ts: int, force: bool = False) -> State:
    """A tag at an object, whose id is the commit's or that of a tag object; refuses to move one unless forced."""
    if not force and _tip(state, f"refs/tags/{name}") is not None:
        raise Refused(f"the tag {name} exists")
    return update_ref(state, f"refs/tags/{name}", oid, ts, "")
