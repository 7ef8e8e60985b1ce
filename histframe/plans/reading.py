"""Queries that read by revision and path, replay commits, and edit configuration, over parts, orders, customers and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from histframe.operators import drivers as D
from histframe.operators import places as P
from histframe.operators import reading as R
from histframe.operators import sequencer as Q
from histframe.operators.ordered import numbered
from histframe.sources import archive as A
from histframe.sources import lenses as L

from .content import OID
from .graph import LENS, _reach
from .snapshots import LENS as PARTS
from .snapshots import MERGE

BLOBS = f"b AS (SELECT doc_id, lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, {OID} AS oid, coalesce(text, '') AS content FROM documents)"


def commit_headers(spark, sf):
    h = R.commit_headers(L.commits(spark, sf))
    return h.select("oid", "ts", F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"))


HEADERS = f"WITH {LENS} SELECT oid, ts, concat_ws(',', parent0, parent1) AS parents FROM c"


def load_blobs(spark, sf):
    """Every second document's id and one that no object has."""
    b = L.blobs(spark, sf)
    rows = b.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("oid")).otherwise(F.lit("f" * 40)).alias("oid"))
    return R.load_blobs(rows, b.select("oid", "content")).select("doc_id", F.octet_length("content").cast("long").alias("size"))


def blob_chunks(spark, sf):
    c = R.blob_chunks(L.blobs(spark, sf).select(F.col("doc_id").alias("oid"), "content"), 1000)
    return c.select(F.col("oid").alias("doc_id"), "n", F.sha1("chunk").alias("chunk_sha1"))


CHUNKS = f"""WITH {BLOBS}, h AS (SELECT doc_id, hex(encode(content)) AS h FROM b), n AS (SELECT doc_id, h, unnest(range((len(h) + 1999) // 2000)) AS n FROM h)
SELECT doc_id, CAST(n AS INTEGER) AS n, sha1(unhex(substr(h, n * 2000 + 1, 2000))) AS chunk_sha1 FROM n"""


def workdir_entries(spark, sf):
    p = L.table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = p.select(F.concat_ws("/", "p_brand", k.cast("string")).alias("path"), F.when(k % 4 == 0, "120000").when(k % 5 == 0, "100755").otherwise("100644").alias("mode"), F.col("p_name").alias("content"))
    return R.workdir_entries(rows)


_PART_OID = "sha1(encode('blob ' || CAST(strlen(p_name) AS VARCHAR)) || '\\x00'::BLOB || encode(p_name))"
ENTRIES = f"""SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 4 = 0 THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN '120000' WHEN p_partkey % 5 = 0 THEN '100755' ELSE '100644' END AS mode,
{_PART_OID} AS oid, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS target FROM part"""


def read_file_at(spark, sf):
    """A revision a language, whose tree holds its documents; asked are all paths, of every fifth one in another revision, and one that none has."""
    b = L.blobs(spark, sf).withColumn("lang", F.split("path", "/")[0])
    rev = b.select(F.col("lang").alias("rev"), F.sha1("lang").alias("tree")).distinct()
    trees = b.select(F.sha1("lang").alias("tree"), "path", "oid")
    asked = b.select(F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("rev"), F.when(F.col("doc_id") % 7 == 0, F.concat("path", F.lit("?"))).otherwise(F.col("path")).alias("path"))
    return R.files_at(asked, rev, trees, b.select("oid", "content")).select("rev", "path", "oid", F.sha1("content").alias("content_sha1"))


FILE_AT = f"""WITH {BLOBS} SELECT CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE split_part(path, '/', 1) END AS rev, path || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE '' END AS path,
CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN oid END AS oid, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN sha1(content) END AS content_sha1 FROM b"""


def patch_files(spark, sf):
    """Each document against the next one, the first and last with one side; shown with capital vowels."""
    b = L.blobs(spark, sf)
    next_ = b.select((F.col("doc_id") - 1).alias("doc_id"), F.col("oid").alias("new_oid"))
    changes = b.select("doc_id", F.col("oid").alias("old_oid")).join(next_, "doc_id", "full")
    return R.patch_files(changes, b.select("oid", "content"), F.translate("content", "aeiou", "AEIOU")).select("doc_id", F.sha1("old_content").alias("old"), F.sha1("new_content").alias("new"))


PATCH_FILES = f"WITH {BLOBS} SELECT coalesce(b.doc_id, n.doc_id - 1) AS doc_id, sha1(translate(b.content, 'aeiou', 'AEIOU')) AS old, sha1(translate(n.content, 'aeiou', 'AEIOU')) AS new FROM b FULL JOIN b n ON n.doc_id = b.doc_id + 1"


def archive(spark, sf):
    a = R.archive_entries(L.head(spark, sf).select("path", "mode", "oid"), prefix="pre/")
    return a.select("path", "mode", "oid", "key")


ARCHIVE = f"""WITH {PARTS}, f AS (SELECT 'pre/' || path AS path, mode, oid FROM head), d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') || '/' AS path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM f)),
a AS (SELECT * FROM f UNION ALL SELECT path, '40000', NULL FROM d) SELECT path, mode, oid, hex(encode(path)) AS key FROM a"""


def show(spark, sf):
    """Orders as commits with their lines as changes, every tenth tagged, tags tagged again; asked are tags of tags, tags and commits."""
    c = L.commits(spark, sf)
    s = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    o = F.col("oid")
    tagged = c.where("oid % 10 = 0")
    tags = tagged.select(s("t", o).alias("oid"), s("v", o).alias("name"), s("c", o).alias("target")).unionByName(tagged.where("oid % 20 = 0").select(s("u", o).alias("oid"), s("w", o).alias("name"), s("t", o).alias("target")))
    lines = L.table(spark, sf, "lineitem").select(s("c", F.col("l_orderkey")).alias("oid"), F.concat("l_partkey", F.lit("."), "l_linenumber").alias("path"), F.lit("add").alias("kind"))
    asked = c.select(F.when(o % 20 == 0, s("u", o)).when(o % 10 == 0, s("t", o)).otherwise(s("c", o)).alias("oid"))
    none = lines.limit(0)
    out = R.shown(asked, c.select(s("c", o).alias("oid"), "subject"), lines, tags, none.select(F.col("oid").alias("tree_oid"), F.lit(0).alias("pos"), F.lit("").alias("name"), F.lit("").alias("mode")), none.select("oid", F.lit("").alias("content")))
    return out.select("oid", "type", F.col("ord").cast("long").alias("ord"), "text")


SHOW = f"""WITH {LENS}, a AS (SELECT oid AS k, CASE WHEN oid % 20 = 0 THEN 'u' WHEN oid % 10 = 0 THEN 't' ELSE 'c' END || CAST(oid AS VARCHAR) AS oid, CASE WHEN oid % 20 = 0 THEN 2 WHEN oid % 10 = 0 THEN 1 ELSE 0 END AS hops, subject FROM c)
SELECT oid, 'tag' AS type, CAST(0 AS BIGINT) AS ord, CASE WHEN hops = 2 THEN 'tag w' ELSE 'tag v' END || CAST(k AS VARCHAR) AS text FROM a WHERE hops > 0 UNION ALL SELECT oid, 'tag', 1, 'tag v' || CAST(k AS VARCHAR) FROM a WHERE hops = 2
UNION ALL SELECT oid, 'commit', hops * 1000000000, 'commit c' || CAST(k AS VARCHAR) || ' ' || subject FROM a
UNION ALL SELECT oid, 'commit', hops * 1000000000 + 1, 'add ' || CAST(l_partkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) FROM a JOIN lineitem ON l_orderkey = k"""


def stash_snapshots(spark, sf):
    """Customers' last orders as stash entries, whose parents are the two or three orders before."""
    c = L.commits(spark, sf).select("oid", "author", "ts")
    w = Window.partitionBy("author").orderBy("ts")
    before = [F.lag("oid", i).over(w).alias(f"p{i}") for i in (1, 2, 3)]
    rows = c.select("oid", "author", "ts", *before).select("oid", F.array_compact(F.array("p1", "p2", "p3")).alias("parents"), F.sha1(F.col("oid").cast("string")).alias("tree"))
    return R.stash_snapshots(L.branches(L.commits(spark, sf)).select("oid"), rows)


STASHES = f"""WITH {LENS}, w AS (SELECT oid, lag(oid, 1) OVER a AS p1, lag(oid, 2) OVER a AS p2, lag(oid, 3) OVER a AS p3 FROM c WINDOW a AS (PARTITION BY author ORDER BY ts))
SELECT w.oid, sha1(CAST(p2 AS VARCHAR)) AS index_tree, sha1(CAST(w.oid AS VARCHAR)) AS workdir_tree, sha1(CAST(p3 AS VARCHAR)) AS untracked_tree FROM w JOIN tips ON tips.oid = w.oid"""


def worktree_list(spark, sf):
    """Parts as worktrees, one of them the main one; with their places in the list."""
    p = L.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") == 17).alias("is_main"))
    ranked = R.worktrees(p).select("path", "is_main")
    return numbered(ranked.withColumn("_first", (~F.col("is_main")).cast("int")), "_first", "path").drop("_first")


WORKTREES = "SELECT path, is_main, CAST(row_number() OVER (ORDER BY is_main DESC, path) - 1 AS BIGINT) AS pos FROM (SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, p_partkey = 17 AS is_main FROM part)"


def stat_clean(spark, sf):
    """Order lines as index entries and files, some of them touched, racy or taken as valid."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    n = lambda x: x.cast("long")
    entry = F.struct(n(k % 100).alias("mtime_s"), n(k % 7).alias("mtime_ns"), n(k % 50).alias("ctime_s"), F.lit(0).cast("long").alias("ctime_ns"), n(k % 3).alias("uid"), n(k % 2).alias("gid"), n(k).alias("ino"), n(F.col("l_quantity")).alias("size"), F.lit(1).alias("dev"), F.lit("100644").alias("mode"), (k % 23 == 0).alias("assume_valid"))
    file = F.struct(n(k % 100 + F.when(k % 11 == 0, 1).otherwise(0)).alias("mtime_s"), n(k % 7).alias("mtime_ns"), n(k % 50).alias("ctime_s"), F.lit(0).cast("long").alias("ctime_ns"), n(k % 3).alias("uid"), n(k % 2).alias("gid"), n(k + (1 << 32)).alias("ino"), n(F.col("l_quantity") + F.when(k % 13 == 0, 1).otherwise(0)).alias("size"), F.lit(2).alias("dev"), F.lit("100644").alias("mode"))
    rows = L.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", entry.alias("i"), file.alias("s"), F.lit(80).cast("long").alias("index_mtime_s"), F.lit(3).cast("long").alias("index_mtime_ns"))
    return rows.select("l_orderkey", "l_linenumber", R.stat_clean().alias("clean"), R.entry_same().alias("same"))


STAT = """SELECT l_orderkey, l_linenumber, k % 23 = 0 OR (k % 11 <> 0 AND k % 13 <> 0 AND NOT (k % 100 > 80 OR (k % 100 = 80 AND k % 7 >= 3))) AS clean, FALSE AS same FROM (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem)"""


def op_to_array(spark, sf):
    rows = R.to_array(R.required(L.table(spark, sf, "nation"), "no nations").select("n_nationkey", "n_name"), 1000)
    return spark.createDataFrame(rows, "n_nationkey long, n_name string")


def refs_order(spark, sf):
    return R.ref_order(L.branches(L.commits(spark, sf)).select("name"))


def packed_refs(spark, sf):
    c = L.commits(spark, sf)
    t = L.tags(c).select("name", F.sha1(F.col("oid").cast("string")).alias("oid"), F.when(F.col("annotated"), F.sha1(F.concat(F.lit("t"), F.col("oid").cast("string")))).alias("peeled"))
    return A.packed_refs(t).select("line")


PACKED = f"""WITH {LENS}, t AS (SELECT oid FROM c WHERE oid % 10 = 0) SELECT '# pack-refs with: peeled fully-peeled sorted ' AS line UNION ALL SELECT sha1(CAST(oid AS VARCHAR)) || ' refs/tags/v' || CAST(oid AS VARCHAR) FROM t
UNION ALL SELECT '^' || sha1('t' || CAST(oid AS VARCHAR)) FROM t WHERE oid % 20 = 0"""


def sparse_text(spark, sf):
    p = L.table(spark, sf, "part").select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/")).alias("pattern"))
    return A.sparse_text(p, cone=True)


SPARSE = """WITH d AS (SELECT DISTINCT p_brand || '/' || p_type AS d FROM part), a AS (SELECT DISTINCT p_brand AS d FROM part)
SELECT '!0' AS ord, '/*' AS line UNION ALL SELECT '!1', '!/*/' UNION ALL SELECT d || '/0', '/' || d || '/' FROM d UNION ALL SELECT d || '/0', '/' || d || '/' FROM a UNION ALL SELECT d || '/1', '!/' || d || '/*/' FROM a"""


def reflog_lines(spark, sf):
    r = L.reflog(spark, sf)
    oid = lambda c: F.when(F.col(c).isNotNull(), F.sha1(F.col(c).cast("string")))
    log = r.select("ref", "seq", oid("old_oid").alias("old_oid"), oid("new_oid").alias("new_oid"), F.concat(F.lit("u"), F.col("ref").cast("string")).alias("name"), F.lit("u@x").alias("email"), "ts", F.lit("+0100").alias("tz"), F.when(F.col("seq") % 4 != 0, F.concat("message", F.lit("\n again "))).alias("message"))
    return A.log_lines(log)


def _log_lines() -> str:
    from .logs import LOG

    return f"""WITH {LOG} SELECT ref, seq, coalesce(sha1(CAST(old_oid AS VARCHAR)), repeat('0', 40)) || ' ' || sha1(CAST(new_oid AS VARCHAR)) || ' u' || CAST(ref AS VARCHAR) || ' <u@x> ' || CAST(ts AS VARCHAR) || ' +0100' || CASE WHEN seq % 4 <> 0 THEN chr(9) || message || ' again' ELSE '' END AS line FROM log"""


# --- replaying ------------------------------------------------------------------------------------------------


def cherry_pick(spark, sf):
    base, ours, theirs = L.merge_sides(spark, sf)
    return Q.pick(ours, base, theirs)


def revert(spark, sf):
    """Taking back what leads from ours to base, in theirs."""
    base, ours, theirs = L.merge_sides(spark, sf)
    return Q.revert(theirs, base, ours)


def rebase_todo(spark, sf):
    """The tips of even authors onto those of odd ones; a patch is an order's status, priority and price in thousands."""
    c = L.commits(spark, sf)
    t = L.branches(c).join(c.select("oid", "author"), "oid")
    ids = L.table(spark, sf, "orders").select(F.col("o_orderkey").alias("oid"), F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("patch_id"))
    return Q.rebase_todo(L.edges(c), c, ids, t.where("author % 2 = 0").select("oid"), t.where("author % 2 = 1").select("oid"))


REBASE = f"""WITH RECURSIVE {LENS}, {_reach("w", "SELECT 0 AS seed, oid FROM tips WHERE author % 2 = 0")}, {_reach("x", "SELECT 0 AS seed, oid FROM tips WHERE author % 2 = 1")},
i AS (SELECT o_orderkey AS oid, o_orderstatus || '|' || o_orderpriority || '|' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS p FROM orders),
own AS (SELECT oid FROM w WHERE oid NOT IN (SELECT oid FROM x)), theirs AS (SELECT p FROM i WHERE oid IN (SELECT oid FROM x) AND oid NOT IN (SELECT oid FROM w))
SELECT oid, ts FROM own JOIN i USING (oid) JOIN c USING (oid) WHERE p NOT IN (SELECT p FROM theirs) AND NOT (parent0 IS NOT NULL AND parent1 IS NOT NULL)"""


# --- configuration --------------------------------------------------------------------------------------------


def _config(spark, sf):
    """Customers as remotes, with a branch for every second one."""
    c, k = L.table(spark, sf, "customer"), F.col("c_custkey")
    s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    row = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    rows = F.array(row(s("remote.r", k, ".url"), s("https://h/", k)), row(s("remote.r", k, ".fetch"), s("+refs/heads/*:refs/remotes/r", k, "/*")), F.when(k % 2 == 0, row(s("branch.b", k, ".remote"), s("r", k))))
    return c.select(k, F.explode(F.array_compact(rows)).alias("x")).select(F.lit(P.LOCAL).alias("scope_rank"), F.col("c_custkey").cast("long").alias("ord"), "x.*")


def remote_list(spark, sf):
    return P.remotes(_config(spark, sf)).select("name", F.array_join("urls", ",").alias("urls"), F.array_join("refspecs", ",").alias("refspecs"))


REMOTES = "SELECT 'r' || CAST(c_custkey AS VARCHAR) AS name, 'https://h/' || CAST(c_custkey AS VARCHAR) AS urls, '+refs/heads/*:refs/remotes/r' || CAST(c_custkey AS VARCHAR) || '/*' AS refspecs FROM customer"


def remote_rename(spark, sf):
    refs = L.table(spark, sf, "customer").select(F.concat(F.lit("refs/remotes/r"), F.col("c_custkey").cast("string"), F.lit("/main")).alias("name"), F.col("c_custkey").cast("string").alias("oid"))
    config, refs = P.remote_rename(_config(spark, sf), refs, "r2", "new")
    return config.select("key", "value").unionByName(refs.select(F.col("name").alias("key"), F.col("oid").alias("value")))


_RENAMED = "CASE WHEN c_custkey = 2 THEN 'new' ELSE 'r' || CAST(c_custkey AS VARCHAR) END"
RENAME = f"""WITH c AS (SELECT c_custkey, {_RENAMED} AS r FROM customer) SELECT 'remote.' || r || '.url' AS key, 'https://h/' || CAST(c_custkey AS VARCHAR) AS value FROM c UNION ALL SELECT 'remote.' || r || '.fetch', '+refs/heads/*:refs/remotes/' || r || '/*' FROM c
UNION ALL SELECT 'branch.b' || CAST(c_custkey AS VARCHAR) || '.remote', r FROM c WHERE c_custkey % 2 = 0 UNION ALL SELECT 'refs/remotes/' || r || '/main', CAST(c_custkey AS VARCHAR) FROM c"""


def submodule_init(spark, sf):
    """Parts as modules; every third one is known already."""
    p, k = L.table(spark, sf, "part"), F.col("p_partkey")
    modules = p.select(F.concat(F.lit("m"), k.cast("string")).alias("name"), F.concat(F.lit("m"), k.cast("string")).alias("path"), F.concat(F.when(k % 2 == 0, "../").otherwise("https://x/"), "p_type").alias("url"))
    config = p.where("p_partkey % 3 = 0").select(F.lit(P.LOCAL).alias("scope_rank"), k.cast("long").alias("ord"), F.concat(F.lit("submodule.m"), k.cast("string"), F.lit(".url")).alias("key"), F.lit("kept").alias("value"))
    return P.submodule_init(config, modules, "https://h/a/b").select("key", "value")


SUBMODULES = """SELECT 'submodule.m' || CAST(p_partkey AS VARCHAR) || '.url' AS key, CASE WHEN p_partkey % 3 = 0 THEN 'kept' WHEN p_partkey % 2 = 0 THEN 'https://h/a/' || p_type ELSE 'https://x/' || p_type END AS value FROM part
UNION ALL SELECT 'submodule.m' || CAST(p_partkey AS VARCHAR) || '.active', 'true' FROM part WHERE p_partkey % 3 <> 0"""


def merge_specs(spark, sf):
    p, k = L.table(spark, sf, "part"), F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    paths = p.select(F.concat_ws("/", "p_brand", k.cast("string")).alias("path"), pick("true", "false", "unspecified", "union", "own", "other").alias("merge"), pick("9", "0", "x", "12").alias("marker"), pick("lfs", "true", "none").alias("filter"))
    config = spark.createDataFrame([("own", "tool %A")], "name string, command string")
    filters = spark.createDataFrame([("lfs", True)], "name string, required boolean")
    return D.merge_spec(paths, config).join(D.filter_spec(paths, filters).withColumnRenamed("driver", "filter"), "path")


SPECS = """SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, ['text', 'binary', 'text', 'union', 'own', 'text'][p_partkey % 6 + 1] AS driver, CASE WHEN p_partkey % 6 = 4 THEN 'tool %A' END AS command,
CAST([9, 7, 7, 12][p_partkey % 4 + 1] AS INTEGER) AS marker_size, CASE WHEN p_partkey % 3 = 0 THEN 'lfs' END AS filter, p_partkey % 3 = 0 AS required FROM part"""


def _registry() -> D.Registry:
    return D.Registry(textconv={"up": str.upper}, clean={"rev": lambda s: s[::-1]}, smudge={"rev": lambda s: s[::-1]}, merges={"own": lambda b, o, t, n, p: (f"{o}+{t}+{n}", 0)}, required=frozenset({"rev"}))


def driven_texts(spark, sf):
    """Part names by a text conversion, cleaned, and cleaned and smudged."""
    p = L.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "up").alias("up"), F.when(F.col("p_partkey") % 3 == 0, "rev").alias("rev"), F.col("p_name").alias("content"))
    r = _registry()
    shown = D.apply_textconv(p, r, "up").select("p_partkey", F.col("content").alias("shown"))
    clean = D.apply_filter(p, r, "clean", "rev")
    back = D.apply_filter(clean, r, "smudge", "rev").select("p_partkey", F.col("content").alias("back"))
    return clean.select("p_partkey", F.col("content").alias("cleaned")).join(shown, "p_partkey").join(back, "p_partkey")


DRIVEN = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN reverse(p_name) ELSE p_name END AS cleaned, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS shown, p_name AS back FROM part"


def driven_merges(spark, sf):
    p, k = L.table(spark, sf, "part"), F.col("p_partkey")
    driver = F.element_at(F.array(*map(F.lit, ["text", "union", "binary", "own"])), (k % 4 + 1).cast("int"))
    rows = p.select(k.cast("string").alias("path"), driver.alias("driver"), F.lit(9).alias("marker_size"), F.concat("p_name", F.lit("\n")).alias("base"), F.concat(F.lit("o"), "p_brand", F.lit("\n")).alias("ours"), F.concat(F.lit("t"), "p_type", F.lit("\n")).alias("theirs"))
    return D.merge_contents(rows, _registry())


MERGED = """WITH p AS (SELECT p_partkey AS k, 'o' || p_brand || chr(10) AS o, 't' || p_type || chr(10) AS t FROM part)
SELECT CAST(k AS VARCHAR) AS path, CASE k % 4 WHEN 0 THEN '<<<<<<<<< ours' || chr(10) || o || '=========' || chr(10) || t || '>>>>>>>>> theirs' || chr(10) WHEN 1 THEN o || t WHEN 2 THEN o ELSE o || '+' || t || '+9' END AS merged, CAST(CASE WHEN k % 4 IN (0, 2) THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM p"""


def submodule_update(spark, sf):
    """Parts as module links, of which some are checked out elsewhere or not at all."""
    p, k = L.table(spark, sf, "part"), F.col("p_partkey")
    index = p.select(F.concat(F.lit("m"), k.cast("string")).alias("path"), F.lit(0).alias("stage"), F.sha1("p_name").alias("oid"), F.when(k % 2 == 0, "160000").otherwise("100644").alias("mode"))
    heads = p.where("p_partkey % 3 != 0").select(F.concat(F.lit("m"), k.cast("string")).alias("path"), F.when(k % 5 == 0, F.sha1("p_type")).otherwise(F.sha1("p_name")).alias("oid"))
    return P.submodule_update(index, heads)


UPDATE = """SELECT 'm' || CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 <> 0 THEN sha1(p_type) END AS have, sha1(p_name) AS want FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR (p_partkey % 5 = 0 AND sha1(p_type) <> sha1(p_name)))"""

QUERIES = {
    "commit_headers": commit_headers, "load_blobs": load_blobs, "blob_chunks": blob_chunks, "workdir_entries": workdir_entries, "read_file_at": read_file_at, "patch_files": patch_files, "archive_entries": archive, "show": show,
    "stash_snapshots": stash_snapshots, "worktree_list": worktree_list, "stat_clean": stat_clean, "op_to_array": op_to_array, "refs_order": refs_order, "packed_refs": packed_refs, "sparse_text": sparse_text, "reflog_lines": reflog_lines,
    "cherry_pick": cherry_pick, "revert": revert, "rebase_todo": rebase_todo, "remote_list": remote_list, "remote_rename": remote_rename, "submodule_init": submodule_init, "submodule_update": submodule_update, "merge_specs": merge_specs, "driven_texts": driven_texts, "driven_merges": driven_merges,
}
#: The merge with ours as its base, theirs as the head and base as what is merged in.
_REVERT = MERGE.replace("\nb AS (", "\nx AS (").replace("\no AS (", "\nb AS (").replace("\nt AS (", "\no AS (").replace("\nx AS (", "\nt AS (")
ORACLES = {
    "commit_headers": HEADERS, "load_blobs": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(strlen(coalesce(text, '')) AS BIGINT) END AS size FROM documents", "blob_chunks": CHUNKS, "workdir_entries": ENTRIES, "read_file_at": FILE_AT, "patch_files": PATCH_FILES, "archive_entries": ARCHIVE, "show": SHOW,
    "stash_snapshots": STASHES, "worktree_list": WORKTREES, "stat_clean": STAT, "op_to_array": "SELECT n_nationkey, n_name FROM nation", "refs_order": f"WITH {LENS}, n AS (SELECT 'refs/heads/c' || CAST(author AS VARCHAR) AS name FROM tips) SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS pos FROM n",
    "packed_refs": PACKED, "sparse_text": SPARSE, "reflog_lines": _log_lines(), "cherry_pick": MERGE, "revert": _REVERT, "rebase_todo": REBASE, "remote_list": REMOTES, "remote_rename": RENAME, "submodule_init": SUBMODULES, "submodule_update": UPDATE, "merge_specs": SPECS, "driven_texts": DRIVEN, "driven_merges": MERGED,
}
