"""State changes over the part lens: what index, working copy, refs, notes and configuration are after each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histframe.operators import transitions as T
from histframe.sources import lenses as L
from histframe.sources import store

from .snapshots import LENS, MERGE


def _state(spark, sf) -> T.State:
    c = L.table(spark, sf, "customer")
    refs = c.select(F.concat(F.lit("refs/heads/c"), F.col("c_custkey").cast("string")).alias("name"), F.sha1(F.col("c_custkey").cast("string")).alias("oid"))
    log = spark.createDataFrame([], "ref string, seq long, old_oid string, new_oid string, ts long, message string")
    return T.State(L.index(spark, sf), L.workdir(spark, sf), refs, log)


def _shown(index: DataFrame | None = None, workdir: DataFrame | None = None) -> DataFrame:
    """(place, path, stage, oid, mode) of both."""
    rows = [] if index is None else [index.select(F.lit("index").alias("place"), "path", F.col("stage").cast("int").alias("stage"), "oid", "mode")]
    rows += [] if workdir is None else [workdir.select(F.lit("workdir").alias("place"), "path", F.lit(None).cast("int").alias("stage"), "oid", "mode")]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


_I = "SELECT 'index' AS place, path, CAST(stage AS INTEGER) AS stage, oid, mode FROM "
_W = " UNION ALL SELECT 'workdir', path, NULL, oid, mode FROM "


def add(spark, sf):
    """All of some brands is staged, but for what an ignore file names."""
    s = T.add(_state(spark, sf), F.col("path").startswith("Brand#1") | F.col("path").startswith("tmp/"), [("root", "", "tmp/\n")])
    return _shown(s.index)


ADD = f"""WITH {LENS}, chosen AS (SELECT * FROM workdir WHERE path LIKE 'Brand#1%'), gone AS (SELECT path FROM idx WHERE path LIKE 'Brand#1%' AND path NOT IN (SELECT path FROM workdir)),
i AS (SELECT * FROM idx WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM chosen) UNION ALL SELECT path, 0, oid, mode FROM chosen) {_I} i"""


def remove(spark, sf):
    s = T.remove(_state(spark, sf), L.head(spark, sf), F.col("path").like("Brand#2%"), force=True)
    return _shown(s.index, s.workdir)


REMOVE = f"WITH {LENS}, i AS (SELECT * FROM idx WHERE path NOT LIKE 'Brand#2%'), w AS (SELECT * FROM workdir WHERE path NOT IN (SELECT path FROM idx WHERE path LIKE 'Brand#2%')) {_I} i {_W} w"


def move(spark, sf):
    s = T.move(_state(spark, sf), "Brand#3", "moved/here")
    return _shown(s.index, s.workdir)


_MOVED = "CASE WHEN path LIKE 'Brand#3/%' THEN 'moved/here' || substr(path, 8) ELSE path END AS path"
MOVE = f"WITH {LENS}, i AS (SELECT * REPLACE ({_MOVED.removesuffix(' AS path')} AS path) FROM idx), w AS (SELECT * REPLACE ({_MOVED.removesuffix(' AS path')} AS path) FROM workdir) {_I} i {_W} w"


def reset_mixed(spark, sf):
    s = T.reset(_state(spark, sf), L.head(spark, sf), "refs/heads/c1", "f" * 40, 1)
    return _shown(s.index, s.workdir)


def reset_hard(spark, sf):
    s = T.reset(_state(spark, sf), L.head(spark, sf), "refs/heads/c1", "f" * 40, 1, "hard")
    return _shown(s.index, s.workdir)


_HEAD = "i AS (SELECT path, 0 AS stage, oid, mode FROM head)"
_HARD = "w AS (SELECT * FROM workdir WHERE path NOT IN (SELECT path FROM idx) AND path NOT IN (SELECT path FROM head) UNION ALL SELECT * FROM head)"


def checkout(spark, sf):
    """From a clean head, with untracked files, to the tree of what is staged."""
    head, state = L.head(spark, sf), _state(spark, sf)
    extra = state.workdir.where("path like 'tmp/%'")
    clean = T.State(head.select("path", F.lit(0).alias("stage"), "oid", "mode"), head.unionByName(extra.select(*head.columns)), state.refs, state.reflog)
    s = T.checkout(clean, state.index.where("stage = 0").select("path", "oid", "mode"))
    return _shown(s.index, s.workdir)


CHECKOUT = f"WITH {LENS}, i AS (SELECT path, 0 AS stage, oid, mode FROM zero), w AS (SELECT path, oid, mode FROM zero UNION ALL SELECT * FROM workdir WHERE path LIKE 'tmp/%') {_I} i {_W} w"


def merge(spark, sf):
    """The index after a three-way merge, with the stages of what stays open."""
    base, ours, theirs = L.merge_sides(spark, sf)
    return _shown(T.merge_into(_state(spark, sf), base, ours, theirs).index)


_MERGED = MERGE[: MERGE.index("\nSELECT path, CASE")] + ",\nm AS (" + MERGE[MERGE.index("\nSELECT path, CASE") + 1 :] + ")"
MERGED = f"""{_MERGED}, open AS (SELECT path FROM m WHERE outcome IN ('conflict', 'content-merge')), i AS (SELECT path, 0 AS stage, oid, mode FROM m WHERE outcome IN ('resolved-known', 'unchanged')
UNION ALL SELECT path, 1, oid, mode FROM b WHERE path IN (SELECT path FROM open) UNION ALL SELECT path, 2, oid, mode FROM o WHERE path IN (SELECT path FROM open) UNION ALL SELECT path, 3, oid, mode FROM t WHERE path IN (SELECT path FROM open)) {_I} i"""


def stash(spark, sf):
    """Two stashes, of which the older one is dropped, and the state that they leave."""
    s, head = _state(spark, sf), L.head(spark, sf)
    for n, oid in enumerate("abc"):
        s = T.stash_push(s, head, oid * 40, n, f"stash {oid}")
    s = T.stash_drop(s, 1)
    log = s.reflog.where("ref = 'refs/stash'").select(F.lit("log").alias("place"), "message", F.lit(None).cast("int").alias("stage"), "new_oid", "old_oid").toDF("place", "path", "stage", "oid", "mode")
    refs = s.refs.where("name = 'refs/stash'").select(F.lit("ref").alias("place"), F.col("name").alias("path"), F.lit(None).cast("int").alias("stage"), "oid", F.lit(None).cast("string").alias("mode"))
    return _shown(s.index, s.workdir).unionByName(log).unionByName(refs)


STASH = f"""WITH {LENS}, {_HEAD}, {_HARD} {_I} i {_W} w UNION ALL SELECT 'log', 'stash a', NULL, repeat('a', 40), NULL UNION ALL SELECT 'log', 'stash c', NULL, repeat('c', 40), repeat('a', 40) UNION ALL SELECT 'ref', 'refs/stash', NULL, repeat('c', 40), NULL"""


def refs(spark, sf):
    """A ref moved, one renamed with its log, one deleted, and one made."""
    s = T.update_ref(_state(spark, sf), "refs/heads/c1", "a" * 40, 5, "moved")
    s = T.update_ref(s, "refs/heads/c2", "b" * 40, 6, "again")
    s = T.update_ref(s, "refs/heads/new", "c" * 40, 7, "made")
    s = T.delete_ref(T.rename_ref(s, "refs/heads/c2", "refs/heads/other"), "refs/heads/c4")
    log = s.reflog.select(F.col("ref").alias("name"), F.col("new_oid").alias("oid"), F.col("old_oid").alias("old"), "message")
    return s.refs.select("name", "oid", F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("message")).unionByName(log)


REFS = """WITH c AS (SELECT c_custkey AS k, 'refs/heads/c' || CAST(c_custkey AS VARCHAR) AS name, sha1(CAST(c_custkey AS VARCHAR)) AS oid FROM customer)
SELECT CASE WHEN k = 2 THEN 'refs/heads/other' ELSE name END AS name, CASE k WHEN 1 THEN repeat('a', 40) WHEN 2 THEN repeat('b', 40) ELSE oid END AS oid, NULL AS old, NULL AS message FROM c WHERE k <> 4
UNION ALL SELECT 'refs/heads/new', repeat('c', 40), NULL, NULL UNION ALL SELECT 'refs/heads/c1', repeat('a', 40), oid, 'moved' FROM c WHERE k = 1 UNION ALL SELECT 'refs/heads/other', repeat('b', 40), oid, 'again' FROM c WHERE k = 2 UNION ALL SELECT 'refs/heads/new', repeat('c', 40), NULL, 'made'"""


def notes(spark, sf):
    n = L.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("object_oid"), F.sha1(F.concat_ws("|", "quality", "toxic")).alias("note_oid"))
    first = n.agg(F.min(F.col("object_oid").cast("long"))).first()[0]
    n = T.note_add(n, "new", "n" * 40)
    return T.note_remove(T.note_add(n, "new", "m" * 40, force=True), str(first))


NOTES = "SELECT CAST(doc_id AS VARCHAR) AS object_oid, sha1(CAST(quality AS VARCHAR) || '|' || CAST(toxic AS VARCHAR)) AS note_oid FROM labels WHERE doc_id <> (SELECT min(doc_id) FROM labels) UNION ALL SELECT 'new', repeat('m', 40)"


def sparse(spark, sf):
    """Only some brands stay checked out; what was changed outside of them stays too."""
    s, index = T.sparse_apply(_state(spark, sf), F.col("path").like("Brand#1%"))
    return _shown(index.where("skip_worktree"), s.workdir)


SPARSE = f"""WITH {LENS}, i AS (SELECT * FROM idx WHERE path NOT LIKE 'Brand#1%'), k AS (SELECT w.* FROM workdir w WHERE NOT EXISTS (SELECT 1 FROM zero z WHERE z.path = w.path AND z.oid = w.oid AND z.mode = w.mode AND z.path NOT LIKE 'Brand#1%')),
w AS (SELECT * FROM k UNION ALL SELECT path, oid, mode FROM zero WHERE path LIKE 'Brand#1%' AND path NOT IN (SELECT path FROM workdir)) {_I} i {_W} w"""


def config(spark, sf):
    """Nations as settings of three scopes: some set anew, some unset, a section under another name."""
    n, k = L.table(spark, sf, "nation"), F.col("n_nationkey")
    key = F.concat(F.when(k % 2 == 0, "core.").otherwise("old.sub."), F.lower("n_name"))
    c = n.select((k % 3).cast("int").alias("scope_rank"), k.cast("long").alias("ord"), key.alias("key"), F.col("n_name").alias("value"))
    c = T.config_set(c, 0, "core.algeria", "set")
    c = T.config_set(c, 1, "core.fresh", None)
    c = T.config_unset(c, 2, "core.brazil")
    return T.config_rename_section(c, 1, "old", "new").select("scope_rank", "key", "value")


CONFIG = """WITH c AS (SELECT CAST(n_nationkey % 3 AS INTEGER) AS scope_rank, CASE WHEN n_nationkey % 2 = 0 THEN 'core.' ELSE 'old.sub.' END || lower(n_name) AS key, n_name AS value FROM nation)
SELECT scope_rank, CASE WHEN scope_rank = 1 AND key LIKE 'old.%' THEN 'new' || substr(key, 4) ELSE key END AS key, value FROM c WHERE NOT (scope_rank = 0 AND key = 'core.algeria') AND NOT (scope_rank = 2 AND key = 'core.brazil')
UNION ALL SELECT 0, 'core.algeria', 'set' UNION ALL SELECT 1, 'core.fresh', NULL"""


# --- encoding and decoding ------------------------------------------------------------------------------------


def tree_objects(spark, sf):
    """Parts of a brand as a tree object's bytes, read back as entries."""
    p = L.table(spark, sf, "part")
    entry = F.concat(F.encode(F.concat(F.when(F.col("p_partkey") % 7 == 0, "40000").otherwise("100644"), F.lit(" p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")), "UTF-8"), F.lit(bytearray(b"\0")), F.unhex(F.sha1("p_name")))
    raw = F.aggregate(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), entry.alias("e")))), F.lit(bytearray(b"")), lambda acc, x: F.concat(acc, x["e"]))
    trees = p.groupBy(F.col("p_brand").alias("oid")).agg(raw.alias("content")).withColumn("type", F.lit("tree"))
    return store.tree_entries(trees)


TREES = "SELECT p_brand AS tree_oid, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pos, 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, CASE WHEN p_partkey % 7 = 0 THEN '40000' ELSE '100644' END AS mode, sha1(p_name) AS oid FROM part"


def commit_objects(spark, sf):
    """Orders as commit objects' bytes, read back as commits."""
    o, k = L.table(spark, sf, "orders"), F.col("o_orderkey")
    parents = F.concat(*(F.when(k % 3 > i, F.concat(F.lit("parent "), F.sha1((k + i).cast("string")), F.lit("\n"))).otherwise("") for i in range(2)))
    text = F.concat(F.lit("tree "), F.sha1(k.cast("string")), F.lit("\n"), parents, F.lit("author A <a@b> "), k.cast("string"), F.lit(" +0100\ncommitter C <c@d> 5 -0230\n\n"), F.col("o_orderpriority"), F.lit("\n\ntree no\n"))
    c = store.commits(o.select(k.alias("oid"), F.lit("commit").alias("type"), F.encode(text, "UTF-8").alias("content")))
    return c.select("oid", "tree", F.array_join("parents", ",").alias("parents"), F.col("author.name").alias("author"), F.col("author.ts").alias("ts"), F.col("committer.tz").alias("tz"), "message")


COMMITS = """SELECT o_orderkey AS oid, sha1(CAST(o_orderkey AS VARCHAR)) AS tree, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN sha1(CAST(o_orderkey AS VARCHAR)) ELSE sha1(CAST(o_orderkey AS VARCHAR)) || ',' || sha1(CAST(o_orderkey + 1 AS VARCHAR)) END AS parents,
'A' AS author, o_orderkey AS ts, '-0230' AS tz, o_orderpriority || chr(10) || chr(10) || 'tree no' || chr(10) AS message FROM orders"""


def flat_tree(spark, sf):
    """Brands over types over parts as three levels of trees."""
    p = L.table(spark, sf, "part").select(F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_partkey").cast("string").alias("k"), F.sha1("p_name").alias("oid"))
    row = lambda tree, name, mode, oid: F.struct(tree.alias("tree_oid"), name.alias("name"), F.lit(mode).alias("mode"), oid.alias("oid"))
    inner = F.concat("b", F.lit("/"), "t")
    rows = p.select(F.explode(F.array(row(F.lit("root"), F.col("b"), "40000", F.col("b")), row(F.col("b"), F.col("t"), "40000", inner), row(inner, F.col("k"), "100644", F.col("oid")))).alias("x")).select("x.*").distinct()
    return store.flat_tree(rows, "root")


FLAT = "SELECT p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path, '100644' AS mode, sha1(p_name) AS oid FROM part"

QUERIES = {
    "state_add": add, "state_rm": remove, "state_mv": move, "state_reset_mixed": reset_mixed, "state_reset_hard": reset_hard, "state_checkout": checkout, "state_merge": merge, "state_stash": stash, "state_refs": refs, "state_notes": notes, "state_sparse": sparse, "state_config": config,
    "tree_objects": tree_objects, "commit_objects": commit_objects, "flat_tree": flat_tree,
}
ORACLES = {
    "state_add": ADD, "state_rm": REMOVE, "state_mv": MOVE, "state_reset_mixed": f"WITH {LENS}, {_HEAD} {_I} i {_W} workdir", "state_reset_hard": f"WITH {LENS}, {_HEAD}, {_HARD} {_I} i {_W} w", "state_checkout": CHECKOUT, "state_merge": MERGED, "state_stash": STASH, "state_refs": REFS, "state_notes": NOTES, "state_sparse": SPARSE, "state_config": CONFIG,
    "tree_objects": TREES, "commit_objects": COMMITS, "flat_tree": FLAT,
}
