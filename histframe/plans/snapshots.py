"""Snapshot queries over the part lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from histframe.operators import snapshot as S
from histframe.sources import lenses as L

LENS = """
p AS (SELECT p_partkey AS k, p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path, p_name || '|' || CAST(p_size AS VARCHAR) AS body,
             CASE WHEN p_partkey % 29 = 0 THEN '120000' ELSE '100644' END AS mode, CAST(p_size AS BIGINT) AS size FROM part),
head AS (SELECT path, sha1(body) AS oid, mode FROM p WHERE k % 13 <> 0),
zero AS (SELECT path, sha1(body || CASE WHEN k % 7 = 0 THEN '#i' ELSE '' END) AS oid, CASE WHEN k % 31 = 0 AND mode = '100644' THEN '100755' ELSE mode END AS mode FROM p WHERE k % 11 <> 0 AND k % 17 <> 0),
staged AS (SELECT path, s AS stage, sha1(body || '#' || CAST(s AS VARCHAR)) AS oid, mode FROM p, (VALUES (1, 1), (2, 2), (3, 4)) v(s, bit)
           WHERE k % 11 <> 0 AND k % 17 = 0 AND ((k // 17) % 7 + 1) & bit <> 0),
idx AS (SELECT path, 0 AS stage, oid, mode FROM zero UNION ALL SELECT path, stage, oid, mode FROM staged),
workdir AS (SELECT path, sha1(body || CASE WHEN k % 5 = 0 THEN '#w' ELSE '' END) AS oid, mode FROM p WHERE k % 19 <> 0
            UNION ALL SELECT 'tmp/' || CAST(k AS VARCHAR), sha1(body), '100644' FROM p WHERE k % 23 = 0),
unmerged AS (SELECT path, max(oid) FILTER (WHERE stage = 1) AS base_oid, max(oid) FILTER (WHERE stage = 2) AS ours_oid, max(oid) FILTER (WHERE stage = 3) AS theirs_oid FROM staged GROUP BY path),
conflicts AS (SELECT path, CASE WHEN base_oid IS NOT NULL AND ours_oid IS NOT NULL AND theirs_oid IS NOT NULL THEN 'both-modified' WHEN ours_oid IS NOT NULL AND theirs_oid IS NOT NULL THEN 'both-added'
                    WHEN base_oid IS NOT NULL AND ours_oid IS NOT NULL THEN 'deleted-by-them' WHEN base_oid IS NOT NULL AND theirs_oid IS NOT NULL THEN 'deleted-by-us'
                    WHEN base_oid IS NOT NULL THEN 'both-deleted' WHEN ours_oid IS NOT NULL THEN 'added-by-us' ELSE 'added-by-them' END AS kind, base_oid, ours_oid, theirs_oid FROM unmerged)
"""


def _kind(a: str, b: str) -> str:
    """SQL for the change from a to b, both aliases of (path, oid, mode)."""
    k = lambda x: f"CASE WHEN {x}.mode = '120000' THEN 'symlink' ELSE 'file' END"
    return f"CASE WHEN {a}.path IS NULL AND {b}.path IS NULL THEN NULL WHEN {a}.path IS NULL THEN 'add' WHEN {b}.path IS NULL THEN 'delete' WHEN {a}.oid = {b}.oid AND {a}.mode = {b}.mode THEN NULL WHEN {k(a)} <> {k(b)} THEN 'type-change' ELSE 'modify' END"


def _kind_mode(a: str, b: str) -> str:
    k = lambda x: f"CASE WHEN {x}.mode = '120000' THEN 'symlink' ELSE 'file' END"
    return f"CASE WHEN {a}.oid = {b}.oid AND {a}.mode <> {b}.mode AND {k(a)} = {k(b)} THEN 'mode-changed' ELSE {_kind(a, b)} END"


def _sources(spark, sf):
    return L.head(spark, sf), L.index(spark, sf), L.workdir(spark, sf)


def status(spark, sf):
    return S.status(*_sources(spark, sf))


STATUS = f"""WITH {LENS}, z AS (SELECT * FROM zero), all_paths AS (SELECT path FROM head UNION SELECT path FROM z UNION SELECT path FROM workdir UNION SELECT path FROM conflicts),
j AS (SELECT a.path, c.kind AS unmerged, {_kind_mode("h", "z")} AS s, {_kind_mode("z", "w")} AS u, z.path AS zp, w.path AS wp
      FROM all_paths a LEFT JOIN head h ON h.path = a.path LEFT JOIN z ON z.path = a.path LEFT JOIN workdir w ON w.path = a.path LEFT JOIN conflicts c ON c.path = a.path)
SELECT path, CASE WHEN unmerged IS NULL THEN s END AS staged, CASE WHEN unmerged IS NULL AND zp IS NOT NULL THEN u END AS unstaged, unmerged IS NULL AND zp IS NULL AND wp IS NOT NULL AS untracked, unmerged
FROM j WHERE unmerged IS NOT NULL OR s IS NOT NULL OR (zp IS NOT NULL AND u IS NOT NULL) OR (zp IS NULL AND wp IS NOT NULL)"""


def outer_join(spark, sf):
    h, i, w = _sources(spark, sf)
    j = S.outer_join(head=h, index=i, workdir=w)
    return j.select("path", F.col("occ").cast("int").alias("occ"), F.col("head.oid").alias("head_oid"), F.col("index.stage").alias("stage"), F.col("index.oid").alias("index_oid"), F.col("workdir.oid").alias("workdir_oid"))


OUTER = f"""WITH {LENS}, i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY stage) AS occ FROM idx), h AS (SELECT *, 1 AS occ FROM head), w AS (SELECT *, 1 AS occ FROM workdir)
SELECT coalesce(h.path, i.path, w.path) AS path, CAST(coalesce(h.occ, i.occ, w.occ) AS INTEGER) AS occ, h.oid AS head_oid, i.stage, i.oid AS index_oid, w.oid AS workdir_oid
FROM h FULL JOIN i ON h.path = i.path AND h.occ = i.occ FULL JOIN w ON coalesce(h.path, i.path) = w.path AND coalesce(h.occ, i.occ) = w.occ"""


def inner_join(spark, sf):
    h, i, w = _sources(spark, sf)
    return S.inner_join(head=h, index=i, workdir=w).select("path", F.col("head.oid").alias("head_oid"), F.col("index.oid").alias("index_oid"), F.col("workdir.oid").alias("workdir_oid"))


INNER = f"""WITH {LENS}, i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY stage) AS occ FROM idx)
SELECT h.path, h.oid AS head_oid, i.oid AS index_oid, w.oid AS workdir_oid FROM head h JOIN i ON h.path = i.path AND i.occ = 1 JOIN workdir w ON w.path = h.path"""


def tree_diff(spark, sf):
    return S.tree_diff(L.head(spark, sf), L.workdir(spark, sf))


_DIFF = "SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, {k} AS kind, a.oid AS old_oid, a.mode AS old_mode, b.oid AS new_oid, b.mode AS new_mode FROM {a} a FULL JOIN {b} b ON a.path = b.path) WHERE kind IS NOT NULL"
TREE_DIFF = f"WITH {LENS} " + _DIFF.format(k=_kind("a", "b"), a="head", b="workdir")


def index_diff(spark, sf):
    return S.index_diff(L.index(spark, sf), L.head(spark, sf))


INDEX_DIFF = f"WITH {LENS} " + _DIFF.format(k=_kind("a", "b"), a="head", b="zero")


def unmerged(spark, sf):
    return S.unmerged_entries(L.index(spark, sf))


def changeset(spark, sf):
    return S.changeset(L.index(spark, sf), L.head(spark, sf))


CHANGESET = f"""WITH {LENS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' WHEN a.oid = b.oid AND a.mode = b.mode THEN 'noop' ELSE 'update' END AS action
FROM zero a FULL JOIN head b ON a.path = b.path"""


def would_overwrite(spark, sf):
    h, i, w = _sources(spark, sf)
    return S.would_overwrite(S.index_diff(i, h), i, w)


OVERWRITE = f"""WITH {LENS}, d AS (SELECT path FROM ({_DIFF.format(k=_kind("a", "b"), a="head", b="zero")}))
SELECT * FROM (SELECT d.path, CASE WHEN w.path IS NULL THEN NULL WHEN z.path IS NULL THEN 'untracked' WHEN z.oid <> w.oid OR z.mode <> w.mode THEN 'modified' END AS reason
FROM d LEFT JOIN zero z ON z.path = d.path LEFT JOIN workdir w ON w.path = d.path) WHERE reason IS NOT NULL"""


def workdir_delta(spark, sf):
    return S.workdir_delta(L.index(spark, sf), L.workdir(spark, sf))


DELTA = f"""WITH {LENS} SELECT z.path, CASE WHEN w.path IS NULL THEN 'absent' WHEN (z.mode = '120000') <> (w.mode = '120000') THEN 'type-changed' WHEN z.oid <> w.oid THEN 'modified' WHEN z.mode <> w.mode THEN 'mode-changed' ELSE 'unchanged' END AS delta
FROM zero z LEFT JOIN workdir w ON w.path = z.path"""


def verify_workdir(spark, sf):
    return S.verify(L.head(spark, sf), L.workdir(spark, sf)).select("path", F.col("_raced").alias("raced"))


VERIFY = f"WITH {LENS} SELECT h.path, w.path IS NULL OR h.oid <> w.oid OR h.mode <> w.mode AS raced FROM head h LEFT JOIN workdir w ON w.path = h.path"


def group_by_dir(spark, sf):
    return S.group_by_dir(L.workdir(spark, sf))


GROUP_BY_DIR = f"""WITH {LENS}, d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, row_number() OVER (ORDER BY path) AS i FROM workdir),
r AS (SELECT *, i - row_number() OVER (PARTITION BY dir ORDER BY path) AS run FROM d)
SELECT dir, min(path) AS first_path, max(path) AS last_path, count(*) AS n FROM r GROUP BY dir, run"""


def out_of_order(spark, sf):
    rows = L.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat_ws("/", "p_brand", "p_type").alias("path"))
    return S.out_of_order(rows)


OUT_OF_ORDER = "SELECT * FROM (SELECT p_partkey AS pos, p_brand || '/' || p_type AS path, lag(p_brand || '/' || p_type) OVER (ORDER BY p_partkey) AS previous FROM part) WHERE path < previous"


def merge_trees(spark, sf):
    return S.merge_trees(*L.merge_sides(spark, sf))


_M = """CASE WHEN {c} THEN '120000' ELSE '100644' END"""
MERGE = f"""WITH {LENS},
b AS (SELECT path, sha1(body) AS oid, {_M.format(c="k % 37 = 0")} AS mode FROM p WHERE NOT k % 6 = 0),
o AS (SELECT path, sha1(body || CASE WHEN k % 4 = 1 THEN '#o' ELSE '' END) AS oid, {_M.format(c="k % 37 = 0 OR k % 41 = 0")} AS mode FROM p WHERE NOT k % 10 = 1),
t AS (SELECT path, sha1(body || CASE WHEN k % 9 = 2 OR k % 12 = 1 THEN '#o' ELSE '' END) AS oid, {_M.format(c="k % 37 = 0 OR k % 43 = 0")} AS mode FROM p WHERE NOT k % 15 = 2),
j AS (SELECT p.path, b.oid AS bo, b.mode AS bm, o.oid AS oo, o.mode AS om, t.oid AS t_o, t.mode AS tm FROM p LEFT JOIN b ON b.path = p.path LEFT JOIN o ON o.path = p.path LEFT JOIN t ON t.path = p.path
      WHERE b.path IS NOT NULL OR o.path IS NOT NULL OR t.path IS NOT NULL),
c AS (SELECT *, CASE WHEN oo IS NULL AND t_o IS NULL THEN 1 WHEN bo IS NULL AND (oo IS NULL OR t_o IS NULL) THEN 2 WHEN oo IS NULL AND t_o = bo AND tm = bm OR t_o IS NULL AND oo = bo AND om = bm THEN 3
      WHEN oo IS NULL OR t_o IS NULL THEN 4 WHEN bo IS NULL AND oo = t_o AND om = tm THEN 5 WHEN bo IS NULL AND om <> tm THEN 6 WHEN bo IS NULL AND om = '120000' THEN 7 WHEN bo IS NULL THEN 8
      WHEN oo = bo AND om = bm AND t_o = bo AND tm = bm THEN 9 WHEN oo = bo AND om = bm THEN 10 WHEN t_o = bo AND tm = bm THEN 11 WHEN oo = t_o AND om = tm THEN 12
      WHEN om = '120000' AND tm = '120000' THEN 14 WHEN om <> tm THEN 15 ELSE 17 END AS r FROM j)
SELECT path, CASE WHEN r IN (1, 3) THEN 'resolved-deleted' WHEN r IN (2, 5, 10, 11, 12) THEN 'resolved-known' WHEN r = 9 THEN 'unchanged' WHEN r IN (8, 17) THEN 'content-merge' ELSE 'conflict' END AS outcome,
       CASE WHEN r = 2 THEN coalesce(oo, t_o) WHEN r IN (5, 9, 11, 12) THEN oo WHEN r = 10 THEN t_o END AS oid, CASE WHEN r = 2 THEN coalesce(om, tm) WHEN r IN (5, 9, 11, 12) THEN om WHEN r = 10 THEN tm END AS mode,
       CASE r WHEN 4 THEN 'modify-delete' WHEN 6 THEN 'distinct-types' WHEN 7 THEN 'add-add' WHEN 14 THEN 'content' WHEN 15 THEN 'distinct-types' END AS conflict FROM c"""


def _moved(spark, sf):
    """The head, and a tree in which some paths moved and some were copied."""
    h = L.head(spark, sf)
    k = F.regexp_extract("path", "([0-9]+)$", 1).cast("long")
    moved = h.withColumn("k", k).where("k % 4 != 2").select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "oid", "mode")
    return h, moved


def exact_renames(spark, sf):
    return S.exact_renames(S.tree_diff(*_moved(spark, sf)))


RENAMES = f"""WITH {LENS}, h AS (SELECT *, CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) AS k FROM head),
n AS (SELECT CASE WHEN k % 3 = 0 THEN 'moved/' || path ELSE path END AS path, oid, mode FROM h WHERE k % 4 <> 2),
d AS ({_DIFF.format(k=_kind("a", "b"), a="head", b="n")}),
del AS (SELECT old_oid, count(*) AS n, min(path) AS source FROM d WHERE kind = 'delete' GROUP BY old_oid HAVING count(*) = 1),
r AS (SELECT d.path, CASE WHEN source IS NULL THEN 'add' ELSE 'rename' END AS kind, source AS old_path, del.old_oid, d.new_oid FROM d LEFT JOIN del ON d.new_oid = del.old_oid WHERE d.kind = 'add')
SELECT * FROM r UNION ALL SELECT path, kind, NULL, old_oid, new_oid FROM d WHERE kind <> 'add' AND NOT (kind = 'delete' AND path IN (SELECT old_path FROM r WHERE kind = 'rename'))"""


def walk_tree(spark, sf):
    return S.walk_tree(L.workdir(spark, sf))


WALK = f"""WITH {LENS}, f AS (SELECT path, CASE WHEN mode = '120000' THEN 'symlink' ELSE 'file' END AS kind FROM workdir),
d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path, 'directory' AS kind FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM workdir))
SELECT path, kind, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM (SELECT * FROM f UNION ALL SELECT * FROM d)"""


QUERIES = {"status": status, "join_outer": outer_join, "join_inner": inner_join, "tree_diff": tree_diff, "index_diff": index_diff, "unmerged": unmerged, "changeset": changeset, "would_overwrite": would_overwrite, "workdir_delta": workdir_delta, "verify_workdir": verify_workdir, "group_by_dir": group_by_dir, "assert_ordered": out_of_order, "merge_trees": merge_trees, "exact_renames": exact_renames, "walk_tree": walk_tree}
ORACLES = {"status": STATUS, "join_outer": OUTER, "join_inner": INNER, "tree_diff": TREE_DIFF, "index_diff": INDEX_DIFF, "unmerged": f"WITH {LENS} SELECT path, kind, base_oid, ours_oid, theirs_oid FROM conflicts", "changeset": CHANGESET, "would_overwrite": OVERWRITE, "workdir_delta": DELTA, "verify_workdir": VERIFY, "group_by_dir": GROUP_BY_DIR, "assert_ordered": OUT_OF_ORDER, "merge_trees": MERGE, "exact_renames": RENAMES, "walk_tree": WALK}
