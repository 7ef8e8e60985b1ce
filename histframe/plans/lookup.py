"""Lookup queries over documents, customers and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from histframe.operators import lookup as K
from histframe.operators import revisions as R
from histframe.scratch import written
from histframe.sources import lenses as L

from .graph import LENS


def _oids(spark, sf):
    return L.table(spark, sf, "part").select(F.sha1(F.col("p_partkey").cast("string")).alias("oid"), F.col("p_partkey").alias("k"))


OIDS = "o AS (SELECT sha1(CAST(p_partkey AS VARCHAR)) AS oid, p_partkey AS k FROM part)"


def has_object(spark, sf):
    asked = L.table(spark, sf, "part").select("p_partkey", F.sha1((F.col("p_partkey") * 2).cast("string")).alias("oid"))
    return K.present(asked, _oids(spark, sf))


def oid_prefix(spark, sf):
    asked = _oids(spark, sf).select(F.expr("substring(oid, 1, 4 + cast(k % 2 as int))").alias("prefix")).distinct()
    return K.by_prefix(asked, _oids(spark, sf))


PREFIX = f"""WITH {OIDS}, a AS (SELECT DISTINCT substr(oid, 1, 4 + k % 2) AS prefix FROM o), h AS (SELECT prefix, count(*) AS n, min(oid) AS oid FROM a JOIN o ON starts_with(oid, prefix) GROUP BY prefix)
SELECT prefix, CASE WHEN n = 1 THEN oid END AS oid, n > 1 AS ambiguous FROM h"""


def resolve_ref(spark, sf):
    c = L.table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("refs/c"), x.cast("string"))
    refs = c.select(name(k).alias("name"), F.when(k % 4 == 0, F.col("c_nationkey")).alias("oid"), F.when(k % 4 != 0, name(k - 1)).alias("symbolic"))
    return K.resolved(refs)


RESOLVE = "SELECT 'refs/c' || CAST(c.c_custkey AS VARCHAR) AS name, t.c_nationkey AS oid FROM customer c LEFT JOIN customer t ON t.c_custkey = c.c_custkey - c.c_custkey % 4"


def walk_submodules(spark, sf):
    p = L.table(spark, sf, "part")
    tree = p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("path"), F.sha1("p_name").alias("oid"), F.when(F.col("p_partkey") % 5 == 0, "160000").otherwise("100644").alias("mode"))
    modules = p.where("p_partkey % 10 = 0").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("mod-"), "p_brand").alias("name"), F.concat(F.lit("../"), "p_type").alias("url"))
    return K.submodules(tree, modules)


SUBMODULES = """SELECT 'm' || CAST(p_partkey AS VARCHAR) AS path, sha1(p_name) AS oid, CASE WHEN p_partkey % 10 = 0 THEN 'mod-' || p_brand ELSE 'm' || CAST(p_partkey AS VARCHAR) END AS name, CASE WHEN p_partkey % 10 = 0 THEN '../' || p_type END AS url
FROM part WHERE p_partkey % 5 = 0"""


def object_filter(spark, sf):
    p = L.table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit("commit"), F.lit("tree"), F.lit("blob")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("type"), (F.col("p_size") * 100).alias("size"), (F.col("p_partkey") % 5).alias("depth"))
    return K.object_filter(p, "blob:limit=2k").unionByName(K.object_filter(p, "tree:2")).unionByName(K.object_filter(p, "blob:none"))


FILTER = """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'commit' WHEN 1 THEN 'tree' ELSE 'blob' END AS type, p_size * 100 AS size, p_partkey % 5 AS depth FROM part)
SELECT * FROM p WHERE type <> 'blob' OR size < 2048 UNION ALL SELECT * FROM p WHERE type = 'commit' OR depth < 2 UNION ALL SELECT * FROM p WHERE type <> 'blob'"""


def whatchanged(spark, sf):
    """Order lines are a commit's tree: the part is the path, the quantity the blob."""
    c = L.commits(spark, sf)
    e = L.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("oid"), (F.col("l_partkey") % 40).alias("path")).agg(F.sum(F.col("l_quantity").cast("long")).alias("blob"))
    return K.changed_by_commit(c, e)


WHATCHANGED = f"""WITH {LENS}, t AS (SELECT l_orderkey AS oid, l_partkey % 40 AS path, sum(CAST(l_quantity AS BIGINT)) AS blob FROM lineitem GROUP BY ALL),
s AS (SELECT oid, coalesce(parent0, parent1) AS parent FROM c WHERE parent1 IS NULL OR parent0 IS NULL), n AS (SELECT s.oid, path, blob FROM s JOIN t ON t.oid = s.oid), p AS (SELECT s.oid, path, blob FROM s JOIN t ON t.oid = s.parent)
SELECT * FROM (SELECT coalesce(n.oid, p.oid) AS oid, coalesce(n.path, p.path) AS path, CASE WHEN p.oid IS NULL THEN 'add' WHEN n.oid IS NULL THEN 'delete' WHEN n.blob <> p.blob THEN 'modify' END AS kind FROM n FULL JOIN p ON n.oid = p.oid AND n.path = p.path) WHERE kind IS NOT NULL"""

#: Expressions and what they come to: the rank, from the newest, of a commit of the author that HEAD stands for, and what of it.
EXPRESSIONS = {"HEAD": (1, "oid"), "@": (1, "oid"), "HEAD~2": (3, "oid"), "HEAD^": (2, "oid"), "HEAD~1^{tree}": (2, "tree"), "HEAD~1^~1": (4, "oid"), "HEAD:lines": (1, "blob"), "HEAD@{1}": (2, "oid"), "first~1": (2, "oid"), "tags/first^{commit}": (1, "oid")}


def rev_parse(spark, sf):
    """Expressions over orders as commits: HEAD stands for the first author with five orders, a tag for the newest of these."""
    c, h = L.commits(spark, sf), lambda p, x: F.sha1(F.concat(F.lit(p), x.cast("string")))
    own = c.groupBy("author").agg(F.count("*").alias("n")).where("n >= 5").agg(F.min("author")).first()[0]
    refs = L.branches(c).select("name", h("c", F.col("oid")).alias("oid"), F.lit(None).cast("string").alias("symbolic"))
    newest = c.where(F.col("author") == own).orderBy(F.desc("ts")).limit(1)
    one = spark.createDataFrame([("HEAD", None, f"refs/heads/c{own}")], refs.schema)
    refs = refs.unionByName(one).unionByName(newest.select(F.lit("refs/tags/first").alias("name"), h("t", F.col("oid")).alias("oid"), F.lit(None).cast("string").alias("symbolic")))
    commits = c.select(h("c", F.col("oid")).alias("oid"), h("r", F.col("oid")).alias("tree"), F.transform(F.array_compact(F.array("parent0", "parent1")), lambda x: F.sha1(F.concat(F.lit("c"), x.cast("string")))).alias("parents"))
    tags = newest.select(h("t", F.col("oid")).alias("oid"), h("c", F.col("oid")).alias("object"))
    trees = c.select(h("r", F.col("oid")).alias("tree_oid"), F.lit("lines").alias("name"), F.lit("100644").alias("mode"), h("b", F.col("oid")).alias("oid"))
    w = Window.partitionBy("author").orderBy("ts")
    log = c.where(F.col("author") == own).select(F.lit("HEAD").alias("ref"), (F.row_number().over(w) - 1).cast("long").alias("seq"), h("c", F.lag("oid").over(w)).alias("old_oid"), h("c", F.col("oid")).alias("new_oid"), "ts")
    tables = R.Tables(*(written(t, "revisions") for t in (refs, commits, tags, trees, log)))
    return spark.createDataFrame([(x, tables.resolve(x)) for x in EXPRESSIONS], "expression string, oid string")


_KIND = {"oid": "c", "tree": "r", "blob": "b"}
REV_PARSE = f"""WITH {LENS}, a AS (SELECT min(author) AS author FROM (SELECT author FROM c GROUP BY author HAVING count(*) >= 5)), r AS (SELECT oid, row_number() OVER (ORDER BY ts DESC) AS n FROM c JOIN a USING (author)),
x AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {n}, '{_KIND[kind]}')" for x, (n, kind) in EXPRESSIONS.items())}) AS v(expression, n, kind)) SELECT expression, sha1(kind || CAST(oid AS VARCHAR)) AS oid FROM x JOIN r USING (n)"""

NOW = 1_700_000_000
#: Dates as people write them, and what they come to.
DATES = {"now": NOW, " Yesterday ": NOW - 86_400, "2 days ago": NOW - 172_800, "3.weeks.ago": NOW - 1_814_400, "1 hour ago": NOW - 3_600, "1970-01-02": 86_400, "1970-01-01T00:01:05Z": 65, "2000-02-30": None, "soon": None}


def approximate_dates(spark, sf):
    return spark.createDataFrame([(t, R.approximate_date(t, NOW)) for t in DATES], "text string, ts long")


APPROXIMATE = "SELECT text, CAST(ts AS BIGINT) AS ts FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if n is None else n})" for t, n in DATES.items()) + ") AS v(text, ts)"

QUERIES = {"has_object": has_object, "oid_prefix": oid_prefix, "resolve_ref": resolve_ref, "walk_submodules": walk_submodules, "object_filter": object_filter, "whatchanged": whatchanged, "rev_parse": rev_parse, "approximate_dates": approximate_dates}
ORACLES = {
    "has_object": f"WITH {OIDS} SELECT p_partkey, sha1(CAST(p_partkey * 2 AS VARCHAR)) AS oid, p_partkey * 2 IN (SELECT k FROM o) AS \"exists\" FROM part",
    "oid_prefix": PREFIX, "resolve_ref": RESOLVE, "walk_submodules": SUBMODULES, "object_filter": FILTER, "whatchanged": WHATCHANGED, "rev_parse": REV_PARSE, "approximate_dates": APPROXIMATE,
}
