"""Replays with conflicts, remotes, worktrees, submodules, drivers that fail, line differences at their limit."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from histframe.functions import linediff
from histframe.functions.values import relative_url
from histframe.operators import drivers as D
from histframe.operators import graph as G
from histframe.operators import places as P
from histframe.operators import sequencer as Q
from histframe.operators import transitions as T

ENTRY, WHO = "path string, oid string, mode string", "A <a@b> 1 +0000"


def tree(spark, **files):
    return spark.createDataFrame([(p, o, "100644") for p, o in files.items()], ENTRY)


def files(df):
    return {r.path: r.oid for r in df.collect()}


@pytest.fixture
def state(spark):
    s, _, _ = P.init(spark)
    head = tree(spark, a="1" * 40, b="2" * 40)
    s = T.State(head.select("path", F.lit(0).alias("stage"), "oid", "mode"), head, s.refs, s.reflog)
    return T.commit(s, "refs/heads/main", WHO, "base", 1)[0]


def tip(s):
    return s.refs.first().oid


def test_picks_go_on_after_a_conflict(spark, state):
    base = tree(spark, a="1" * 40, b="2" * 40)
    clean, clash = tree(spark, a="1" * 40, b="3" * 40), tree(spark, a="4" * 40, b="2" * 40)
    other = tree(spark, a="5" * 40, b="2" * 40)
    run = Q.start(state, "refs/heads/main", [("c1", base, clean, "one"), ("c2", other, clash, "two"), ("c3", base, tree(spark, a="1" * 40, b="2" * 40, c="6" * 40), "three")], WHO, 2)
    assert run.stopped and len(run.todo) == 2
    assert {(r.path, r.stage) for r in run.state.index.where("stage > 0").collect()} == {("a", 1), ("a", 2), ("a", 3)}
    settled = tree(spark, a="7" * 40, b="3" * 40).select("path", F.lit(0).alias("stage"), "oid", "mode")
    done = Q.go_on(run, settled, WHO, 3)
    assert not done.stopped and not done.todo and files(done.state.index) == {"a": "7" * 40, "b": "3" * 40, "c": "6" * 40}
    assert done.state.reflog.count() == 4
    skipped = Q.skip(run, tree(spark, a="1" * 40, b="3" * 40), WHO, 3)
    assert files(skipped.state.index) == {"a": "1" * 40, "b": "3" * 40, "c": "6" * 40}
    back = Q.abort(run, base, 4)
    assert tip(back) == tip(state) and files(back.index) == files(base)
    with pytest.raises(T.Refused):
        Q.start(run.state, "refs/heads/main", [], WHO, 5)


def test_revert_takes_changes_back(spark, state):
    base, changed = tree(spark, a="1" * 40), tree(spark, a="1" * 40, b="2" * 40)
    run = Q.start(state, "refs/heads/main", [("c", base, changed, "add b\n")], WHO, 2, kind="revert")
    assert not run.stopped and files(run.state.index) == {"a": "1" * 40}


def test_rebase_onto_another(spark, state):
    onto = tree(spark, a="9" * 40, b="2" * 40)
    run = Q.start(state, "refs/heads/main", [("c", tree(spark, b="2" * 40), tree(spark, b="3" * 40), "b")], WHO, 2, kind="rebase", onto=("f" * 40, onto))
    assert files(run.state.index) == {"a": "9" * 40, "b": "3" * 40} and run.began == tip(state)


def test_stash_apply(spark, state):
    stashed = tree(spark, a="8" * 40, b="2" * 40)
    base = tree(spark, a="1" * 40, b="2" * 40)
    assert files(Q.stash_apply(state, base, stashed).workdir) == {"a": "8" * 40, "b": "2" * 40}
    with pytest.raises(T.Refused):
        Q.stash_apply(T.replace(state, workdir=tree(spark, a="7" * 40, b="2" * 40)), base, stashed)


def test_tags_and_symbolic_refs(spark, state):
    s = Q.tag(state, "v", "a" * 40, 2)
    with pytest.raises(T.Refused):
        Q.tag(s, "v", "b" * 40, 3)
    refs = Q.set_symbolic(P.init(spark)[1], "HEAD", "refs/heads/x")
    assert [tuple(r) for r in refs.collect()] == [("HEAD", None, "refs/heads/x")]


def test_remotes(spark):
    _, _, config = P.init(spark)
    config = P.remote_add(config, "origin", "https://h/x")
    with pytest.raises(T.Refused):
        P.remote_add(config, "origin", "y")
    config = T.config_set(config, P.LOCAL, "branch.main.remote", "origin")
    config = P.remote_set_url(config, "origin", "https://h/y")
    refs = spark.createDataFrame([("refs/remotes/origin/main", "1"), ("refs/heads/main", "1")], "name string, oid string")
    renamed, moved = P.remote_rename(config, refs, "origin", "up")
    assert {r["key"]: r.value for r in renamed.where("key like 'remote%' or key like 'branch%'").collect()} == {"remote.up.url": "https://h/y", "remote.up.fetch": "+refs/heads/*:refs/remotes/up/*", "branch.main.remote": "up"}
    assert {r.name for r in moved.collect()} == {"refs/remotes/up/main", "refs/heads/main"}
    left, gone = P.remote_remove(renamed, moved, "up")
    assert not left.where("key like 'remote%' or key like 'branch%'").count() and {r.name for r in gone.collect()} == {"refs/heads/main"}


def test_worktrees(spark):
    none = spark.createDataFrame([], "id string, path string, ref string, locked boolean")
    w = P.worktree_add(P.worktree_add(none, "/x/shared", "refs/heads/a"), "/y/shared", "refs/heads/b")
    assert {(r.id, r.path) for r in w.collect()} == {("shared", "/x/shared"), ("shared1", "/y/shared")}
    with pytest.raises(T.Refused):
        P.worktree_add(w, "/z", "refs/heads/a")
    w = P.worktree_move(w, "/x/shared", "/x/other")
    assert {r.path for r in P.worktree_remove(w, "/y/shared").collect()} == {"/x/other"}
    with pytest.raises(T.Refused):
        P.worktree_remove(w.withColumn("locked", F.lit(True)), "/x/other")


def test_submodules(spark):
    _, _, config = P.init(spark)
    index, modules = spark.createDataFrame([], "path string, stage int, oid string, mode string"), spark.createDataFrame([], "name string, path string, url string")
    index, modules = P.submodule_add(index, modules, "lib", "../lib", "1" * 40)
    with pytest.raises(T.Refused):
        P.submodule_add(index, modules, "lib", "x", "1" * 40)
    config = P.submodule_init(config, modules, "https://h/a")
    value = lambda c: {r["key"]: r.value for r in c.where("key like 'submodule%'").collect()}
    assert value(config) == {"submodule.lib.url": "https://h/lib", "submodule.lib.active": "true"}
    assert value(P.submodule_sync(config, modules.withColumn("url", F.lit("../new")), "https://h/a"))["submodule.lib.url"] == "https://h/new"
    assert value(P.submodule_deinit(config, "lib")) == {}
    heads = spark.createDataFrame([("lib", "2" * 40)], "path string, oid string")
    assert [tuple(r) for r in P.submodule_update(index, heads).collect()] == [("lib", "2" * 40, "1" * 40)]


def test_urls_without_a_part_left(spark):
    rows = spark.createDataFrame([("./a", "../../../x"), ("host:p", "../../x"), ("/a", "../x"), ("a", "../x")], "b string, u string")
    assert [r[0] for r in rows.select(relative_url(F.col("b"), F.col("u"))).collect()] == [None, ".:x", "/x", "x"]


def test_drivers_that_fail(spark):
    def broken(_):
        raise OSError

    rows = spark.createDataFrame([("x", "kept"), (None, "plain")], "driver string, content string")
    loose = D.Registry(clean={"x": broken})
    assert {r.content for r in D.apply_filter(rows, loose, "clean").collect()} == {"kept", "plain"}
    with pytest.raises(Exception, match="DriverFailed"):
        D.apply_filter(rows, D.Registry(clean={"x": broken}, required=frozenset({"x"})), "clean").collect()


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_line_differences_are_shortest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") + "\n" for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs, gave_up = linediff.diff(a, b)
        assert not gave_up
        assert sum(r.a_len for r in runs if r.kind == "ours-only") + sum(r.b_len for r in runs if r.kind == "theirs-only") == slow_distance(a, b)
        assert [x for r in runs for x in (a[r.a : r.a + r.a_len] if r.kind != "theirs-only" else [])] == a
        assert [x for r in runs for x in (b[r.b : r.b + r.b_len] if r.kind != "ours-only" else [])] == b


def test_line_differences_take_little_memory():
    a, b = [f"a{i}\n" for i in range(700)], [f"b{i}\n" for i in range(700)]
    tracemalloc.start()
    runs, _ = linediff.diff(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r.a_len + r.b_len for r in runs) == 1400 and peak < 6 << 20  # 70 MB with a copy of the frontier a step


def brute_ancestors(edges):
    parents = {}
    for c, p, _ in edges:
        parents.setdefault(c, set()).add(p)
    nodes = {x for c, p, _ in edges for x in (c, p)}

    def all_of(n):
        seen, todo = {n}, [n]
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p), todo.append(p)
        return seen

    return {n: all_of(n) for n in nodes}


def test_counts_independence_and_octopus_bases(spark):
    rng = random.Random(7)
    edges = [(i, j, k) for i in range(1, 40) for k, j in enumerate(rng.sample(range(i), min(i, rng.choice([1, 1, 1, 2]))))]
    edges = [(-c, -p, k) for c, p, k in edges]
    above = brute_ancestors(edges)
    frame = spark.createDataFrame(edges, "child long, parent long, idx int")
    nodes = spark.createDataFrame([(n,) for n in above], "oid long")
    assert {r.oid: r.n for r in G.ancestor_counts(frame, nodes).collect()} == {n: len(a) for n, a in above.items()}
    some = rng.sample(sorted(above), 12)
    assert {r.oid for r in G.independent(frame, spark.createDataFrame([(n,) for n in some], "oid long")).collect()} == {n for n in some if not any(n in above[m] for m in some if m != n)}
    groups = [(g, n) for g in range(5) for n in rng.sample(sorted(above), 3)]
    want = set()
    for g in range(5):
        common = set.intersection(*(above[n] for h, n in groups if h == g))
        want |= {(g, c) for c in common if not any(c in above[d] for d in common if d != c)}
    assert {tuple(r) for r in G.octopus_merge_bases(frame, spark.createDataFrame(groups, "grp long, oid long")).collect()} == want
    limited = {r.oid for r in G.closure(frame, spark.createDataFrame([(0, some[0])], "seed int, oid long"), levels=3).collect()}
    full = {r.oid: r.depth for r in G.closure(frame, spark.createDataFrame([(0, some[0])], "seed int, oid long")).collect()}
    assert set(full) == above[some[0]] and limited == {o for o, d in full.items() if d <= 3}
