"""Commit graph queries over the order lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from histframe.operators import graph as G
from histframe.sources import lenses as L

SEC = "CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) * 1000000 + o_orderkey"
LENS = f"""
o AS (SELECT o_orderkey AS oid, o_custkey AS author, {SEC} AS ts, o_orderpriority AS priority, o_orderpriority || ' ' || o_orderstatus AS subject FROM orders),
c AS (SELECT a.oid, lag(a.oid) OVER (PARTITION BY a.author ORDER BY a.ts) AS parent0, b.oid AS parent1, a.author, a.ts, a.subject
      FROM o a ASOF LEFT JOIN (SELECT author + 1 AS next, ts, oid FROM o) b ON a.priority = '1-URGENT' AND a.author = b.next AND a.ts > b.ts),
e AS (SELECT oid AS child, parent0 AS parent, 0 AS idx FROM c WHERE parent0 IS NOT NULL UNION ALL SELECT oid, parent1, CASE WHEN parent0 IS NULL THEN 0 ELSE 1 END FROM c WHERE parent1 IS NOT NULL),
tips AS (SELECT max_by(oid, ts) AS oid, author FROM c GROUP BY author)
"""


def _reach(name: str, seeds: str, edges: str = "e") -> str:
    """SQL for (seed, oid) reachable from the seeds."""
    return f"{name} AS (SELECT seed, oid FROM ({seeds}) UNION SELECT r.seed, e.parent FROM {name} r JOIN {edges} e ON e.child = r.oid)"


def _graph(spark, sf):
    c = L.commits(spark, sf)
    return c, L.edges(c)


def _tips(c, test: str = "true"):
    return L.branches(c).join(c.select("oid", "author"), "oid").where(test).select("oid")


def commits(spark, sf):
    return L.commits(spark, sf)


def walk(spark, sf):
    c, e = _graph(spark, sf)
    return G.reachable(e, _tips(c)).select("oid", F.col("depth").cast("int").alias("depth"))


WALK = f"""WITH RECURSIVE {LENS}, r AS (SELECT oid, 0 AS depth FROM tips UNION SELECT e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.oid)
SELECT oid, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY oid"""


def walk_until(spark, sf):
    c, e = _graph(spark, sf)
    return G.reachable(e, _tips(c), stop=c.where("oid % 7 = 0").select("oid")).select("oid")


UNTIL = f"""WITH RECURSIVE {LENS}, r AS (SELECT oid FROM tips WHERE oid % 7 <> 0 UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid WHERE e.parent % 7 <> 0) SELECT oid FROM r"""


def walk_first_parent(spark, sf):
    c, e = _graph(spark, sf)
    return G.first_parents(e, _tips(c)).select("oid")


FIRST = f"""WITH RECURSIVE {LENS}, r AS (SELECT oid FROM tips UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid AND idx = 0) SELECT oid FROM r"""


def walk_shallow(spark, sf):
    c, e = _graph(spark, sf)
    return G.reachable(G.grafted(e, c.where("oid % 5 = 0").select("oid")), _tips(c)).select("oid")


SHALLOW = f"""WITH RECURSIVE {LENS}, r AS (SELECT oid FROM tips UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid WHERE e.child % 5 <> 0) SELECT oid FROM r"""


def log(spark, sf):
    c, e = _graph(spark, sf)
    return G.log(c, e, _tips(c), excluding=c.where("oid % 50 = 0").select("oid"), before=870_000_000_000_000, parents=(1, 2), limit=200)


LOG = f"""WITH RECURSIVE {LENS}, r AS (SELECT oid FROM tips WHERE oid % 50 <> 0 UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid WHERE e.parent % 50 <> 0)
SELECT oid, author, ts, subject FROM c JOIN r USING (oid) WHERE ts < 870000000000000 AND (parent0 IS NOT NULL OR parent1 IS NOT NULL) ORDER BY ts DESC, oid LIMIT 200"""


def rev_list(spark, sf):
    c, e = _graph(spark, sf)
    return G.rev_list(e, _tips(c, "author % 2 = 0"), _tips(c, "author % 2 = 1"))


_W, _X = (_reach(n, f"SELECT 0 AS seed, oid FROM tips WHERE author % 2 = {k}") for n, k in (("w", 0), ("x", 1)))
REV_LIST = f"WITH RECURSIVE {LENS}, {_W}, {_X} SELECT oid FROM w WHERE oid NOT IN (SELECT oid FROM x)"


def bundle_boundary(spark, sf):
    return G.boundary(_graph(spark, sf)[1], rev_list(spark, sf))


BOUNDARY = f"WITH RECURSIVE {LENS}, {_W}, {_X}, s AS (SELECT oid FROM w WHERE oid NOT IN (SELECT oid FROM x)) SELECT DISTINCT parent AS oid FROM e JOIN s ON e.child = s.oid WHERE parent NOT IN (SELECT oid FROM s)"


def _pairs(c):
    """The tips of neighbouring authors, a pair each."""
    t = L.branches(c).join(c.select("oid", "author"), "oid")
    return t.select(F.col("author").alias("pair"), F.col("oid").alias("a")).join(t.select((F.col("author") - 1).alias("pair"), F.col("oid").alias("b")), "pair")


def merge_base_all(spark, sf):
    c, e = _graph(spark, sf)
    return G.merge_bases(e, _pairs(c))


def merge_base(spark, sf):
    c, e = _graph(spark, sf)
    return G.merge_base(e, _pairs(c))


_BASES = f"""WITH RECURSIVE {LENS}, p AS (SELECT a.author AS pair, a.oid AS a, b.oid AS b FROM tips a JOIN tips b ON a.author = b.author - 1),
{_reach("ra", "SELECT pair AS seed, a AS oid FROM p")}, {_reach("rb", "SELECT pair AS seed, b AS oid FROM p")},
common AS (SELECT seed AS pair, oid FROM ra INTERSECT SELECT seed, oid FROM rb),
best AS (SELECT pair, oid FROM common WHERE (pair, oid) NOT IN (SELECT pair, e.parent FROM common JOIN e ON e.child = oid))"""


def octopus(spark, sf):
    """The tips of three neighbouring authors, a group each."""
    c, e = _graph(spark, sf)
    t = L.branches(c).join(c.select("oid", "author"), "oid")
    return G.octopus_merge_bases(e, t.select(F.floor(F.col("author") / 3).cast("long").alias("grp"), "oid"))


OCTOPUS = f"""WITH RECURSIVE {LENS}, g AS (SELECT author // 3 AS grp, oid FROM tips), {_reach("r", "SELECT {'grp': grp, 'tip': oid} AS seed, oid FROM g")},
n AS (SELECT seed.grp AS grp, oid, count(*) AS n FROM r GROUP BY ALL), common AS (SELECT grp, oid FROM n JOIN (SELECT grp, count(*) AS k FROM g GROUP BY grp) USING (grp) WHERE n = k)
SELECT grp, oid FROM common WHERE (grp, oid) NOT IN (SELECT grp, e.parent FROM common JOIN e ON e.child = oid)"""


def independent(spark, sf):
    c, e = _graph(spark, sf)
    return G.independent(e, c.select("oid"))


INDEPENDENT = f"""WITH RECURSIVE {LENS}, s AS (SELECT oid FROM c), {_reach("r", "SELECT oid AS seed, oid FROM s")} SELECT oid FROM s WHERE oid NOT IN (SELECT oid FROM r WHERE seed <> oid)"""


def describe(spark, sf):
    c, e = _graph(spark, sf)
    return G.described(e, c, L.tags(c), _tips(c))


DESCRIBE = f"""WITH RECURSIVE {LENS}, {_reach("u", "SELECT oid AS seed, oid FROM tips")}, {_reach("g", "SELECT oid AS seed, oid FROM c WHERE oid % 20 = 0")},
total AS (SELECT seed, count(*) AS n FROM u GROUP BY seed), own AS (SELECT seed AS oid, count(*) AS n FROM g GROUP BY seed),
d AS (SELECT u.seed, u.oid, total.n - own.n AS distance, c.ts FROM u JOIN own USING (oid) JOIN total USING (seed) JOIN c USING (oid)),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, ts DESC) = 1)
SELECT t.oid AS target, 'refs/tags/v' || CAST(b.oid AS VARCHAR) AS tag, distance, coalesce(distance = 0, FALSE) AS exact FROM tips t LEFT JOIN b ON b.seed = t.oid"""


def name_rev(spark, sf):
    c, e = _graph(spark, sf)
    tags = L.tags(c).select("oid", "name", "tagger_ts")
    heads = L.branches(c).select("oid", "name", F.lit(None).cast("long").alias("tagger_ts"))
    return G.named(e, tags.unionByName(heads))


NAME_REV = f"""WITH RECURSIVE {LENS}, n AS (SELECT oid, 0 AS other, coalesce(CASE WHEN oid % 20 = 0 THEN ts + 1 END, 4611686018427387904) AS tagger, 'tags/v' || CAST(oid AS VARCHAR) AS ref FROM c WHERE oid % 10 = 0
      UNION ALL SELECT oid, 1, 4611686018427387904, 'c' || CAST(author AS VARCHAR) FROM tips),
r AS (SELECT oid, other, CAST(0 AS BIGINT) AS distance, tagger, ref, '' AS path, CAST(0 AS BIGINT) AS tail FROM n
      UNION ALL SELECT e.parent, other, distance + CASE WHEN idx = 0 THEN 1 ELSE {G.MERGE_HOP} END, tagger, ref, path || CASE WHEN idx = 0 THEN '' ELSE CASE WHEN tail > 0 THEN '~' || CAST(tail AS VARCHAR) ELSE '' END || '^' || CAST(idx + 1 AS VARCHAR) END, CASE WHEN idx = 0 THEN tail + 1 ELSE 0 END
      FROM r JOIN e ON e.child = r.oid)
SELECT oid, ref || path || CASE WHEN tail > 0 THEN '~' || CAST(tail AS VARCHAR) ELSE '' END AS name, distance FROM r QUALIFY row_number() OVER (PARTITION BY oid ORDER BY other, distance, tagger, ref, path, tail) = 1"""


def bisect(spark, sf):
    c, e = _graph(spark, sf)
    tip = c.where("parent1 is not null").orderBy(F.desc("ts")).limit(1).select("oid")
    good = c.where("parent0 is null").select("oid")
    return G.bisect_weights(e, good, tip)


BISECT = f"""WITH RECURSIVE {LENS}, tip AS (SELECT oid FROM c WHERE parent1 IS NOT NULL ORDER BY ts DESC LIMIT 1), {_reach("b", "SELECT 0 AS seed, oid FROM tip")}, {_reach("g", "SELECT 0 AS seed, oid FROM c WHERE parent0 IS NULL")},
s AS (SELECT oid FROM b WHERE oid NOT IN (SELECT oid FROM g)), i AS (SELECT * FROM e WHERE child IN (SELECT oid FROM s) AND parent IN (SELECT oid FROM s)), {_reach("w", "SELECT oid AS seed, oid FROM s", "i")}
SELECT seed AS oid, count(*) AS weight, (SELECT count(*) FROM s) AS n FROM w GROUP BY seed"""


def _objects(spark, sf):
    """Objects are orders, customers and nations; lines point to orders, some of which are gone."""
    o = L.table(spark, sf, "orders")
    n = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    objects = o.where("o_orderkey % 9 != 0").select(n("o", F.col("o_orderkey")).alias("oid"))
    objects = objects.unionByName(L.table(spark, sf, "customer").select(n("c", F.col("c_custkey")).alias("oid"))).unionByName(L.table(spark, sf, "nation").select(n("n", F.col("n_nationkey")).alias("oid")))
    objects = objects.unionByName(L.table(spark, sf, "supplier").select(n("s", F.col("s_suppkey")).alias("oid")))
    edges = L.table(spark, sf, "customer").select(n("n", F.col("c_nationkey")).alias("child"), n("c", F.col("c_custkey")).alias("parent"))
    edges = edges.unionByName(o.select(n("c", F.col("o_custkey")).alias("child"), n("o", F.col("o_orderkey")).alias("parent")))
    roots = L.table(spark, sf, "nation").where("n_nationkey % 3 != 0").select(n("n", F.col("n_nationkey")).alias("oid"))
    return objects, edges, roots


def fsck(spark, sf):
    return G.fsck(*_objects(spark, sf))


FSCK = """WITH RECURSIVE objects AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS oid FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier),
e AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS child, 'c' || CAST(c_custkey AS VARCHAR) AS parent FROM customer UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR) FROM orders),
r AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS oid FROM nation WHERE n_nationkey % 3 <> 0 UNION SELECT e.parent FROM r JOIN e ON e.child = r.oid),
u AS (SELECT oid FROM objects WHERE oid NOT IN (SELECT oid FROM r))
SELECT 'missing' AS kind, oid FROM r WHERE oid NOT IN (SELECT oid FROM objects) UNION ALL SELECT 'unreachable', oid FROM u UNION ALL SELECT 'dangling', oid FROM u WHERE oid NOT IN (SELECT parent FROM e)
UNION ALL SELECT DISTINCT 'broken-link', child FROM e WHERE child IN (SELECT oid FROM objects) AND parent NOT IN (SELECT oid FROM objects)"""

QUERIES = {"commits": commits, "walk_commits": walk, "walk_until": walk_until, "walk_first_parent": walk_first_parent, "walk_shallow": walk_shallow, "log": log, "rev_list": rev_list, "bundle_boundary": bundle_boundary, "merge_base_all": merge_base_all, "merge_base": merge_base, "independent": independent, "octopus_merge_bases": octopus, "describe": describe, "name_rev": name_rev, "bisect": bisect, "fsck": fsck}
ORACLES = {"commits": f"WITH {LENS} SELECT oid, parent0, parent1, author, ts, subject FROM c", "walk_commits": WALK, "walk_until": UNTIL, "walk_first_parent": FIRST, "walk_shallow": SHALLOW, "log": LOG, "rev_list": REV_LIST, "bundle_boundary": BOUNDARY, "merge_base_all": f"{_BASES} SELECT pair, oid FROM best", "merge_base": f"{_BASES} SELECT pair, min(oid) AS oid FROM best GROUP BY pair", "independent": INDEPENDENT, "octopus_merge_bases": OCTOPUS, "describe": DESCRIBE, "name_rev": NAME_REV, "bisect": BISECT, "fsck": FSCK}
