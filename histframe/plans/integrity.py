"""Checks over parts and orders as trees, commits and tags, some of them with faults put in."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from histframe.operators import integrity as I
from histframe.sources import lenses as L

MODES = ["100644", "100644", "120000", "40000", "0100755", "100664", "160000", "040000"]
NAMES = [".", "..", ".git", "", "a/b", ".gitmodules", ".gitattributes", ".gitignore", ".mailmap"]


def _entries(spark, sf):
    """Parts of a brand as a tree; every third one has a telling name, every eleventh the id of zeros."""
    p, k = L.table(spark, sf, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))).otherwise(F.col("p_type"))
    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy(k)) - 1
    return p.select(F.col("p_brand").alias("tree_oid"), pos.alias("pos"), name.alias("name"), F.element_at(F.array(*map(F.lit, MODES)), (k % len(MODES) + 1).cast("int")).alias("mode"), F.when(k % 11 == 0, I.ZERO).otherwise(F.sha1("p_name")).alias("oid"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
ENTRIES = f"""e AS (SELECT p_brand AS tree_oid, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pos, CASE WHEN p_partkey % 3 = 0 THEN {_list(NAMES)}[p_partkey % {len(NAMES)} + 1] ELSE p_type END AS name,
      {_list(MODES)}[p_partkey % {len(MODES)} + 1] AS mode, CASE WHEN p_partkey % 11 = 0 THEN repeat('0', 40) ELSE sha1(p_name) END AS oid FROM part)"""


def tree_faults(spark, sf):
    f = I.tree_faults(_entries(spark, sf))
    return f.withColumns({"severity": I.severity(F.col("msg_id")), "strict": I.severity(F.col("msg_id"), strict=True)})


_TESTS = {
    "zeroPaddedFilemode": "mode LIKE '0%'", "badFilemode": "mode = '100664'", "nullSha1": "oid = repeat('0', 40)", "emptyName": "name = ''", "hasDot": "name = '.'", "hasDotdot": "name = '..'", "hasDotgit": "name = '.git'",
    "fullPathname": "contains(name, '/')", "duplicateEntries": "nth > 1", "treeNotSorted": "before > key", "gitmodulesSymlink": "name = '.gitmodules' AND mode = '120000'", "gitmodulesBlob": "name = '.gitmodules' AND mode NOT IN ('120000', '100644', '100755')",
    "gitattributesSymlink": "name = '.gitattributes' AND mode = '120000'", "gitattributesBlob": "name = '.gitattributes' AND mode NOT IN ('120000', '100644', '100755')", "gitignoreSymlink": "name = '.gitignore' AND mode = '120000'", "mailmapSymlink": "name = '.mailmap' AND mode = '120000'",
}
_WARN = "msg_id IN ('emptyName', 'hasDot', 'hasDotdot', 'hasDotgit', 'fullPathname', 'nullSha1', 'zeroPaddedFilemode')"
_INFO = "msg_id IN ('badFilemode', 'gitattributesSymlink', 'gitignoreSymlink', 'mailmapSymlink')"
TREE_FAULTS = f"""WITH {ENTRIES}, k AS (SELECT *, hex(encode(name || CASE WHEN mode IN ('40000', '040000') THEN '/' ELSE '' END)) AS key, row_number() OVER (PARTITION BY tree_oid, name ORDER BY pos) AS nth FROM e),
b AS (SELECT *, lag(key) OVER (PARTITION BY tree_oid ORDER BY pos) AS before FROM k), f AS ({" UNION ALL ".join(f"SELECT tree_oid, pos, '{m}' AS msg_id FROM b WHERE {t}" for m, t in _TESTS.items())})
SELECT *, CASE WHEN {_INFO} THEN 'info' WHEN {_WARN} THEN 'warning' ELSE 'error' END AS severity, CASE WHEN {_INFO} THEN 'info' ELSE 'error' END AS strict FROM f"""


def special_blobs(spark, sf):
    return I.special_blobs(_entries(spark, sf))


SPECIAL = f"WITH {ENTRIES} SELECT oid, max(name) AS name FROM e WHERE name IN ('.gitmodules', '.gitattributes') GROUP BY oid"

_T, _A, _C = "tree {oid}\n", "author A <a@b> 1 +0000\n", "committer C <c@d> 2 -0130\n"
#: Texts of commits and the faults that they have; {oid} is an id.
COMMITS = [
    (_T + "parent {oid}\n" + _A + _C + "\nbody", []), (_T + _A + _C + "\nbody", []), ("parent {oid}\n" + _A + _C + "\n", ["missingTree"]), ("tree 12\n" + "parent {oid}\nparent x\n" + _A + _C + "\n", ["badTreeSha1", "badParentSha1"]),
    (_T + _C + "\nb", ["missingAuthor"]), (_T + _A + _A + _A + _C + "\nb", ["multipleAuthors", "multipleAuthors"]), (_T + _A + "\nb", ["missingCommitter"]), (_T + "author A\n" + _C + "\nb", ["missingEmail"]),
    (_T + "author A<a@b> 1 +0000\n" + _C + "\nb", ["missingSpaceBeforeEmail"]), (_T + "author  <a@b> 01 +0000\n" + _C + "\nb", ["missingNameBeforeEmail", "zeroPaddedDate"]), (_T + "author A <a@b>1 +0000\n" + _C + "\nb", ["missingSpaceBeforeDate"]),
    (_T + "author A <a@b> x +0000\n" + "committer C <c@d> 9223372036854775808 +0000\n" + "\nb", ["badDate", "badDateOverflow"]), (_T + "author A <a@b> 1 +2400\n" + "committer C <c@d> 9223372036854775807 +0060\n" + "\nb", ["badTimezone", "badTimezone"]), (_T + "author A <a@b 1 +0000\n" + _C + "\nb", ["missingEmail"]),
    (_T + _A + "encoding x\n" + _C + "\nb", []),
]
TAGS = [
    ("object {oid}\ntype commit\ntag v\ntagger A <a@b> 1 +0000\n\nb", []), ("type commit\ntag v\n\nb", ["missingObject"]), ("object 12\ntype commit\ntag v\ntagger A <a@b> 1 +0000\n\nb", ["badObjectSha1"]), ("object {oid}\ntag v\n\nb", ["missingType"]),
    ("object {oid}\ntype thing\ntag v\n\nb", ["missingTypeEntry"]), ("object {oid}\ntype tree\ntagger A <a@b> 1 +0000\n\nb", ["missingTag"]), ("object {oid}\ntype tree\ntag \ntagger A <a@b> 1 +0000\n\nb", ["missingTagEntry"]), ("object {oid}\ntype blob\ntag v\n\nb", ["missingTaggerEntry"]),
    ("object {oid}\ntype tag\ntag v\ntagger A<a@b> 1 +0000\n\nb", ["missingSpaceBeforeEmail"]), ("object {oid}\ntype tag\ntag v\ntagger A <a@b> 92233720368547758070 +0000\n\nb", ["badDateOverflow"]),
]


def _text(cases: list, k: Column, oid: Column) -> Column:
    return F.replace(F.element_at(F.array(*(F.lit(t) for t, _ in cases)), (k % len(cases) + 1).cast("int")), F.lit("{oid}"), oid)


def commit_faults(spark, sf):
    o, k = L.table(spark, sf, "orders"), F.col("o_orderkey")
    return I.commit_faults(o.select(k.alias("oid"), _text(COMMITS, k, F.sha1(k.cast("string"))).alias("text")))


def tag_faults(spark, sf):
    o, k = L.table(spark, sf, "orders"), F.col("o_orderkey")
    return I.tag_faults(o.select(k.alias("oid"), _text(TAGS, k, F.sha1(k.cast("string"))).alias("text")))


def _expected(cases: list) -> str:
    rows = ", ".join(f"({i}, '{m}')" for i, (_, faults) in enumerate(cases) for m in faults)
    return f"SELECT o_orderkey AS oid, msg_id FROM orders JOIN (VALUES {rows}) AS v(n, msg_id) ON o_orderkey % {len(cases)} = n"


def ref_faults(spark, sf):
    """Customers as refs: to an order, some of which are gone, to another ref, or to nothing sensible."""
    c, k = L.table(spark, sf, "customer"), F.col("c_custkey")
    content = F.when(k % 7 == 0, F.concat(F.lit("ref: refs/c"), k.cast("string"))).when(k % 5 == 0, F.lit("not an id")).otherwise(F.sha1((k * 3).cast("string")))
    refs = c.select(F.concat(F.lit("refs/c"), k.cast("string")).alias("name"), F.concat(content, F.lit("\n")).alias("content"))
    return I.ref_faults(refs, L.table(spark, sf, "orders").select(F.sha1(F.col("o_orderkey").cast("string")).alias("oid")))


REF_FAULTS = """WITH c AS (SELECT 'refs/c' || CAST(c_custkey AS VARCHAR) AS ref, c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0)
SELECT ref, 'badRefContent' AS msg_id, NULL AS target FROM c WHERE k % 5 = 0 UNION ALL SELECT ref, 'badRefOid', repeat('0', 40) FROM c WHERE k % 5 = 0
UNION ALL SELECT ref, 'badRefOid', sha1(CAST(k * 3 AS VARCHAR)) FROM c WHERE k % 5 <> 0 AND k * 3 NOT IN (SELECT o_orderkey FROM orders)"""


def collect_roots(spark, sf):
    """Branches, log entries and staged parts, told apart by a letter."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    refs = L.branches(L.commits(spark, sf)).select(s("o", "oid").alias("oid"))
    log = L.reflog(spark, sf).select(s("e", "old_oid").alias("old_oid"), F.when(F.col("new_oid") % 10 == 0, I.ZERO).otherwise(s("e", "new_oid")).alias("new_oid"))
    return I.roots(refs, log, L.index(spark, sf))


def _roots() -> str:
    from .graph import LENS
    from .snapshots import LENS as PARTS

    return f"""WITH {LENS}, {PARTS}, ev AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT DISTINCT oid FROM (SELECT 'o' || CAST(oid AS VARCHAR) AS oid FROM tips UNION ALL SELECT 'e' || CAST(old AS VARCHAR) FROM ev WHERE old IS NOT NULL UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR) FROM ev WHERE event_id % 10 <> 0 UNION ALL SELECT oid FROM idx)"""


QUERIES = {"tree_faults": tree_faults, "special_blobs": special_blobs, "commit_faults": commit_faults, "tag_faults": tag_faults, "ref_faults": ref_faults, "collect_roots": collect_roots}
ORACLES = {"tree_faults": TREE_FAULTS, "special_blobs": SPECIAL, "commit_faults": _expected(COMMITS), "tag_faults": _expected(TAGS), "ref_faults": REF_FAULTS, "collect_roots": _roots()}
