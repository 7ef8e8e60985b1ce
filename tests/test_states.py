"""State transitions, streams and order helpers."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from histframe.operators import graph, logs, ordered, snapshot
from histframe.operators import transitions as T
from histframe.streaming import reflog as stream

ENTRY = "path string, oid string, mode string"
BLOBS = {"a": "74614c9224e259adae80b04d6a0e3f483407324d", "b": "b1bdbca984c25c202cc85c2e3ad97c50d20afb6f"}


def frame(spark, rows, schema=ENTRY):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def state(spark):
    work = frame(spark, [("a.txt", BLOBS["a"], "100644"), ("b.txt", BLOBS["b"], "100644"), ("x.log", "3" * 40, "100644")])
    return T.State(frame(spark, [], "path string, stage int, oid string, mode string"), work, frame(spark, [], "name string, oid string"), frame(spark, [], "ref string, seq long, old_oid string, new_oid string, ts long, message string"))


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def commit_id(tree, parents, who, message):
    body = f"tree {tree}\n" + "".join(f"parent {p}\n" for p in parents) + f"author {who}\ncommitter {who}\n\n{message}"
    return hashlib.sha1(b"commit %d\0" % len(body) + body.encode()).hexdigest()


def test_commits_have_the_known_ids(state):
    who = "Tester <t@x.dev> 1700000000 +0000"
    one = T.add(state, F.col("path") == "a.txt")
    assert T.tree_oid(one.index) == "3a854a72e3d92d84858c79cdb3030c430e38cd86"
    one, first = T.commit(one, "refs/heads/main", who, "seed commit\n", 1)
    assert first == commit_id("3a854a72e3d92d84858c79cdb3030c430e38cd86", [], who, "seed commit\n")
    two, second = T.commit(T.add(one, F.lit(True), [("root", "", "*.log\n")]), "refs/heads/main", who, "second commit\n", 2)
    assert second == commit_id("865436ac89733a201b08305873bec940ae19fba6", [first], who, "second commit\n")
    assert rows(two.refs, "name", "oid") == {("refs/heads/main", second)}
    assert [tuple(r) for r in two.reflog.orderBy("seq").select("old_oid", "new_oid").collect()] == [(None, first), (first, second)]


def test_nested_tree_id(spark):
    index = frame(spark, [("d/a.txt", 0, BLOBS["a"], "100644"), ("d.txt", 0, BLOBS["b"], "100644"), ("z", 1, "f" * 40, "100644")], "path string, stage int, oid string, mode string")
    entry = lambda m, n, o: f"{m} {n}\0".encode() + bytes.fromhex(o)
    tree = lambda raw: hashlib.sha1(b"tree %d\0" % len(raw) + raw).hexdigest()
    inner = tree(entry("100644", "a.txt", BLOBS["a"]))
    assert T.tree_oid(index) == tree(entry("100644", "d.txt", BLOBS["b"]) + entry("40000", "d", inner))
    assert T.tree_oid(index.limit(0)) == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def test_moves_removals_and_refusals(spark, state):
    s = T.add(state, F.lit(True))
    head = s.index.select("path", "oid", "mode")
    moved = T.move(s, "a.txt", "d/a.txt")
    assert ("d/a.txt",) in rows(moved.index, "path") and ("d/a.txt",) in rows(moved.workdir, "path")
    with pytest.raises(T.Refused):
        T.move(s, "a.txt", "b.txt")
    gone = T.remove(s, head, F.col("path") == "a.txt")
    assert ("a.txt",) not in rows(gone.index, "path") | rows(gone.workdir, "path")
    dirty = T.State(s.index, s.workdir.withColumn("oid", F.lit("9" * 40)), s.refs, s.reflog)
    with pytest.raises(T.Refused):
        T.remove(dirty, head, F.col("path") == "a.txt")
    with pytest.raises(T.Refused):
        T.checkout(dirty, frame(spark, [("a.txt", "8" * 40, "100644")]))
    there = T.checkout(s, frame(spark, [("a.txt", "8" * 40, "100644")]))
    assert rows(there.workdir, "path", "oid") == {("a.txt", "8" * 40)}


def test_reset_modes(spark, state):
    s = T.add(state, F.lit(True))
    tree = frame(spark, [("a.txt", "7" * 40, "100644")])
    soft, mixed, hard = (T.reset(s, tree, "refs/heads/m", "c" * 40, 5, m) for m in ("soft", "mixed", "hard"))
    assert rows(soft.index, "path") == rows(s.index, "path")
    assert rows(mixed.index, "path", "oid") == {("a.txt", "7" * 40)} and rows(mixed.workdir, "path") == rows(s.workdir, "path")
    assert rows(hard.workdir, "path", "oid") == {("a.txt", "7" * 40)}
    assert rows(hard.refs, "oid") == {("c" * 40,)}
    with pytest.raises(T.Refused):
        T.update_ref(hard, "refs/heads/m", "d" * 40, 6, "x", expected="0" * 40)


def test_stash_stack(spark, state):
    s = T.add(state, F.lit(True))
    head = s.index.select("path", "oid", "mode")
    for i in range(3):
        s = T.stash_push(s, head, str(i) * 40, i, f"stash {i}")
    assert [r.oid[0] for r in logs.stash_stack(s.reflog).orderBy("n").collect()] == ["2", "1", "0"]
    s = T.stash_drop(s, 1)
    left = s.reflog.orderBy("seq").collect()
    assert [(r.old_oid, r.new_oid) for r in left] == [(None, "0" * 40), ("0" * 40, "2" * 40)]
    s = T.stash_drop(s, 0)
    assert rows(s.refs, "name", "oid") == {("refs/stash", "0" * 40)}


def test_merge_into_keeps_conflicts_staged(spark, state):
    base, ours, theirs = (frame(spark, r) for r in ([("a", "1", "100644"), ("b", "1", "100644")], [("a", "2", "100644"), ("b", "1", "100644")], [("a", "3", "100644"), ("b", "4", "100644"), ("c", "5", "100644")]))
    m = T.merge_into(state, base, ours, theirs)
    assert rows(m.index, "path", "stage", "oid") == {("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("b", 0, "4"), ("c", 0, "5")}


def test_notes_config_and_sparse(spark, state):
    n = T.note_add(frame(spark, [("o1", "n1")], "object_oid string, note_oid string"), "o2", "n2")
    with pytest.raises(T.Refused):
        T.note_add(n, "o1", "n3")
    assert rows(T.note_add(n, "o1", "n3", force=True), "object_oid", "note_oid") == {("o1", "n3"), ("o2", "n2")}
    c = frame(spark, [(0, 0, "core.a", "1"), (1, 1, "core.a", "2")], "scope_rank int, ord int, key string, value string")
    c = T.config_rename_section(T.config_set(c, 1, "core.a", "9"), 0, "core", "kern")
    assert rows(c, "scope_rank", "key", "value") == {(0, "kern.a", "1"), (1, "core.a", "9")}
    s, index = T.sparse_apply(T.add(state, F.lit(True)), F.col("path") == "a.txt")
    assert rows(s.workdir, "path") == {("a.txt",)} and rows(index.where("skip_worktree"), "path") == {("b.txt",), ("x.log",)}


def test_join_pairs_occurrences(spark):
    i = frame(spark, [("p", 1, "x", "m"), ("p", 2, "y", "m")], "path string, stage int, oid string, mode string")
    h = frame(spark, [("p", "h", "m")])
    got = snapshot.outer_join(h=h, i=i).orderBy("occ").collect()
    assert [(r.h is not None, r.i.oid) for r in got] == [(True, "x"), (False, "y")]


def test_cut_is_no_difference(spark):
    """What the stop commit reaches is still given if another way leads there."""
    e = spark.createDataFrame([(4, 3, 0), (4, 2, 1), (3, 1, 0), (2, 1, 0), (1, 0, 0)], "child long, parent long, idx int")
    tip, stop = (spark.createDataFrame([(x,)], "oid long") for x in (4, 3))
    assert rows(graph.reachable(e, tip, stop=stop), "oid") == {(4,), (2,), (1,), (0,)}
    assert rows(graph.rev_list(e, tip, stop), "oid") == {(4,), (2,)}


def test_order_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.pos for r in ordered.numbered(df, "k").collect())
    assert all(r.previous == (r.k - 1 if r.k else None) for r in ordered.lagged(df.withColumn("v", F.col("k")), "v", "k").collect())


def test_streams_equal_batches(spark, small, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(source)
    log = stream.read(spark, source)
    batch = spark.read.parquet(source).select(F.col("user_id").alias("ref"), F.col("event_id").alias("new_oid"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("message"))
    got = stream.drained(stream.tips(log), "tips", "complete", str(tmp_path / "c1"))
    assert rows(got, "ref", "oid", "entries") == rows(stream.tips(batch), "ref", "oid", "entries")
    kept = stream.drained(stream.retained(log, "2024-01-20"), "kept", "append", str(tmp_path / "c2"))
    assert rows(kept, "new_oid") == rows(stream.retained(batch, "2024-01-20"), "new_oid")
    wins = stream.drained(stream.windowed(log, late="60 days"), "wins", "update", str(tmp_path / "c3"))
    best = wins.groupBy("start", "message").agg(F.max("n").alias("n"))
    want = batch.groupBy(F.window("ts", "1 hour"), "message").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "message", "n")
    assert rows(best, "start", "message", "n") == rows(want, "start", "message", "n")


def test_values_are_carried_over_many_ranges(spark):
    import random

    rng = random.Random(4)
    rows = []
    for g, n in (("a", 3), ("hot", 400), ("none", 50), ("z", 5)):
        rows += [(g, i, None if g == "none" or rng.random() < 0.97 else f"{g}{i}") for i in range(n)]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, k int, v string")
    want, last = {}, {}
    for g, k, v in sorted(rows):
        last[g] = v or last.get(g)
        want[g, k] = last[g]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = {(r.g, r.k): r.carried for r in ordered.carried(frame, "v", "g", "k").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
