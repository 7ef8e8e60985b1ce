"""Rule queries over URL paths and parts, and scalar functions over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from histframe.functions import scalar as C
from histframe.operators import rules as R
from histframe.sources import lenses as L

PATHS = "u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
SPEC = ["m.*/**", "!**/es/*", "*.html", "blog.?????*.example.com/fr", "!**/1*"]
IGNORE = [("global", "", "# comment\n*.html\n!blog*\n/m.*/en\n"), ("exclude", "", "**/fr/*\n!**/fr/1*\n"), ("nested", "spam-farm.example.org", "en/*\n!en/7*\nde\n")]
ATTRS = [("spam-farm.example.org", "en/* -diff size=9\n"), ("", "[attr]page text diff=html\n*.html page\n**/en/* text=auto\n**/de/* binary\nblog* !text size=12\n")]
CONE = ["m.example", "Brand#1/ECONOMY", "Brand#2"]
SPARSE = "*\n!Brand#1/\nBrand#1/ECONOMY/\n!**/1*\n"


def pathspec(spark, sf):
    p = L.url_paths(spark, sf)
    return p.select("page_id", R.in_pathspec(F.col("path"), SPEC).alias("selected"))


PATHSPEC = f"""WITH {PATHS} SELECT page_id, CASE WHEN regexp_matches(path, '^(.*/)?1[^/]*$') THEN FALSE WHEN regexp_matches(path, '^blog\\.[^/]{{5}}[^/]*\\.example\\.com/fr$') THEN TRUE WHEN regexp_matches(path, '^(.*/)?[^/]*\\.html$') THEN TRUE
WHEN regexp_matches(path, '^(.*/)?es/[^/]*$') THEN FALSE WHEN regexp_matches(path, '^m\\.[^/]*/.*$') THEN TRUE ELSE FALSE END AS selected FROM u"""


def ignore(spark, sf):
    p = L.url_paths(spark, sf)
    v = R.ignore_verdict(F.col("path"), IGNORE)
    return p.select("page_id", v.alias("v")).select("page_id", "v.verdict", "v.kind", "v.line", "v.pattern", F.coalesce(F.col("v.verdict") == "ignored", F.lit(False)).alias("ignored"))


_N = "path LIKE 'spam-farm.example.org/%' AND regexp_matches(substr(path, 23), '{0}')"
IGNORE_SQL = f"""WITH {PATHS}, r AS (SELECT page_id, CASE WHEN {_N.format("^(.*/)?de$")} THEN 9 WHEN {_N.format("^en/7[^/]*$")} THEN 8 WHEN {_N.format("^en/[^/]*$")} THEN 7
WHEN regexp_matches(path, '^(.*/)?fr/1[^/]*$') THEN 6 WHEN regexp_matches(path, '^(.*/)?fr/[^/]*$') THEN 5 WHEN regexp_matches(path, '^m\\.[^/]*/en$') THEN 4 WHEN regexp_matches(path, '^(.*/)?blog[^/]*$') THEN 3
WHEN regexp_matches(path, '^(.*/)?[^/]*\\.html$') THEN 2 END AS k FROM u),
t AS (SELECT * FROM (VALUES (9, 'ignored', 'nested', 3, 'de'), (8, 'unignored', 'nested', 2, '!en/7*'), (7, 'ignored', 'nested', 1, 'en/*'), (6, 'unignored', 'exclude', 2, '!**/fr/1*'), (5, 'ignored', 'exclude', 1, '**/fr/*'),
 (4, 'ignored', 'global', 4, '/m.*/en'), (3, 'unignored', 'global', 3, '!blog*'), (2, 'ignored', 'global', 2, '*.html')) v(k, verdict, kind, line, pattern))
SELECT page_id, verdict, kind, CAST(line AS BIGINT) AS line, pattern, coalesce(verdict = 'ignored', FALSE) AS ignored FROM r LEFT JOIN t USING (k)"""


def attributes(spark, sf):
    p = L.url_paths(spark, sf)
    get = lambda n: R.attribute(F.col("path"), n, ATTRS)
    return p.select("page_id", get("text").alias("text"), get("diff").alias("diff"), get("merge").alias("merge"), get("size").alias("size"), R.marker_size(get("size")).alias("marker"))


_HTML, _EN, _DE, _BLOG, _SPAM = "regexp_matches(path, '^(.*/)?[^/]*\\.html$')", "regexp_matches(path, '^(.*/)?en/[^/]*$')", "regexp_matches(path, '^(.*/)?de/[^/]*$')", "regexp_matches(path, '^(.*/)?blog[^/]*$')", "regexp_matches(path, '^spam-farm\\.example\\.org/en/[^/]*$')"
ATTR_SQL = f"""WITH {PATHS}, a AS (SELECT page_id, CASE WHEN {_BLOG} THEN 'unspecified' WHEN {_DE} THEN 'unset' WHEN {_EN} THEN 'auto' WHEN {_HTML} THEN 'set' ELSE 'unspecified' END AS text,
CASE WHEN {_SPAM} THEN 'unset' WHEN {_DE} THEN 'unset' WHEN {_HTML} THEN 'html' ELSE 'unspecified' END AS diff, CASE WHEN {_DE} THEN 'unset' ELSE 'unspecified' END AS merge,
CASE WHEN {_SPAM} THEN '9' WHEN {_BLOG} THEN '12' ELSE 'unspecified' END AS size FROM u)
SELECT *, CASE size WHEN '9' THEN 9 WHEN '12' THEN 12 ELSE 7 END AS marker FROM a"""


def sparse_cone(spark, sf):
    return L.workdir(spark, sf).select("path", R.in_cone(F.col("path"), CONE).alias("inside"))


PART = "w AS (SELECT p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part WHERE p_partkey % 19 <> 0 UNION ALL SELECT 'tmp/' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 23 = 0)"
CONE_SQL = f"""WITH {PART} SELECT path, path NOT LIKE '%/%' OR regexp_replace(path, '/[^/]*$', '') = 'Brand#1' OR path LIKE 'Brand#1/ECONOMY/%' OR path LIKE 'Brand#2/%' OR path LIKE 'm.example/%' AS inside FROM w"""


def sparse_patterns(spark, sf):
    return L.workdir(spark, sf).select("path", R.in_sparse(F.col("path"), SPARSE).alias("inside"))


SPARSE_SQL = f"""WITH {PART} SELECT path, NOT regexp_matches(path, '^(.*/)?1[^/]*(/.*)?$') AND (path LIKE 'Brand#1/ECONOMY/%' OR NOT regexp_matches(path, '^(.*/)?Brand#1/')) AS inside FROM w"""


def ref_names(spark, sf):
    t = L.tags(L.commits(spark, sf)).select("name").unionByName(L.branches(L.commits(spark, sf)).select("name"))
    n = F.col("name")
    return t.select("name", C.short_ref(n).alias("short"), R.name_filter(C.short_ref(n), ["v1*", "c?"], ["*9"]).alias("tag_filter"), R.ref_filter(n, ["refs/*5*"], ["*/c*1"]).alias("ref_filter"), C.valid_ref(n).alias("valid"))


NAMES = """WITH n AS (SELECT 'refs/tags/v' || CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT DISTINCT 'refs/heads/c' || CAST(o_custkey AS VARCHAR) FROM orders),
s AS (SELECT name, regexp_replace(name, '^refs/(heads|tags)/', '') AS short FROM n)
SELECT name, short, regexp_matches(short, '^(v1[^/]*|c[^/])$') AND NOT short LIKE '%9' AS tag_filter, name LIKE 'refs/%5%' AND NOT name LIKE '%/c%1' AS ref_filter, TRUE AS valid FROM s"""

# --- scalar functions -----------------------------------------------------------------------------------------


def messages(spark, sf):
    d = L.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("[PATCH 1/2] "), "text", F.lit("  \n\n\n\nend \n")).alias("m"))
    m = F.col("m")
    return d.select("doc_id", F.sha1(C.subject_line(m)).alias("subject"), F.sha1(C.fold_subject(m)).alias("folded"), F.sha1(C.stripspace(m)).alias("stripped"), F.sha1(C.shortlog_subject(m)).alias("short"), F.sha1(C.reflog_message(m)).alias("reflog"))


_FOLD = "array_to_string(list_transform(string_split(string_split(regexp_replace(m, '[ \\t\\r\\f\\v]+(\\n|$)', '\\1', 'g'), chr(10) || chr(10))[1], chr(10)), lambda x: x), ' ')"
MESSAGES = f"""WITH d AS (SELECT doc_id, '[PATCH 1/2] ' || text || '  ' || repeat(chr(10), 4) || 'end ' || chr(10) AS m FROM documents), f AS (SELECT *, {_FOLD} AS fold FROM d),
t AS (SELECT *, regexp_replace(regexp_replace(m, '[ \\t\\r\\f\\v]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS s FROM f)
SELECT doc_id, sha1(string_split(m, chr(10))[1]) AS subject, sha1(fold) AS folded, sha1(regexp_replace(regexp_replace(s, '^\\n+', ''), '\\n+$', '') || chr(10)) AS stripped,
       sha1(ltrim(regexp_replace(trim(fold), '^\\[PATCH[^\\]]*\\]', ''))) AS short, sha1(trim(regexp_replace(m, '[\\r\\n]', ' ', 'g'))) AS reflog FROM t"""


def identities(spark, sf):
    c = L.table(spark, sf, "customer").select("c_custkey", C.identity_line(F.col("c_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.dev")), F.col("c_custkey") * 1000, F.lit("+0130")).alias("line"))
    return c.select("c_custkey", "line", C.identity(F.col("line")).alias("i")).select("c_custkey", "line", "i.name", "i.email", "i.ts", "i.tz")


IDENTITIES = "SELECT c_custkey, c_name || ' <c' || CAST(c_custkey AS VARCHAR) || '@x.dev> ' || CAST(c_custkey * 1000 AS VARCHAR) || ' +0130' AS line, c_name AS name, 'c' || CAST(c_custkey AS VARCHAR) || '@x.dev' AS email, CAST(c_custkey * 1000 AS BIGINT) AS ts, '+0130' AS tz FROM customer"


def object_ids(spark, sf):
    b = L.blobs(spark, sf)
    o = F.col("oid")
    return b.select("doc_id", "oid", C.abbreviated(o).alias("short"), C.loose_path(o).alias("loose"), C.fanout_path(o, 2).alias("fanout"), C.is_oid(o).alias("valid"), "size", F.crc32(F.col("content").cast("binary")).alias("crc"))


# crc32 has no counterpart, so the comparison leaves it out
def blob_ids(spark, sf):
    return object_ids(spark, sf).drop("crc")


OIDS = """WITH b AS (SELECT doc_id, coalesce(text, '') AS c, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents), o AS (SELECT *, sha1(encode('blob ' || CAST(size AS VARCHAR)) || '\\x00'::BLOB || encode(c)) AS oid FROM b)
SELECT doc_id, oid, substr(oid, 1, 7) AS short, substr(oid, 1, 2) || '/' || substr(oid, 3) AS loose, substr(oid, 1, 2) || '/' || substr(oid, 3, 2) || '/' || substr(oid, 5) AS fanout, TRUE AS valid, size FROM o"""


def paths(spark, sf):
    p = L.url_paths(spark, sf)
    messy = F.concat(F.lit("/a//./"), "path", F.lit("/../b/"))
    return p.select("page_id", C.parent_dir(F.col("path")).alias("parent"), C.collapsed(messy).alias("collapsed"), C.unsafe_path(F.col("path")).alias("unsafe"))


PATHS_SQL = f"""WITH {PATHS} SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS parent, '/a/' || regexp_replace(rtrim(path, '/'), '/[^/]*$', '') || '/b' AS collapsed, CASE WHEN path LIKE '%/' OR path LIKE '%//%' THEN 'empty-segment' END AS unsafe FROM u"""


def settings(spark, sf):
    n = L.table(spark, sf, "nation")
    v = F.element_at(F.array(*(F.lit(x) for x in ["yes", "Off", "12", "3k", "-2M", "x1", "", "0", "1g"])), (F.col("n_nationkey") % 9 + 1).cast("int"))
    raw = F.concat(F.lit("Branch.Feature."), "n_name", F.lit(".Merge"))
    return n.select("n_nationkey", C.git_int(v).alias("number"), C.git_boolean(v).alias("flag"), C.config_key(raw)["section"].alias("section"), C.config_key(raw)["subsection"].alias("subsection"), C.config_key(raw)["name"].alias("name"))


SETTINGS = """SELECT n_nationkey, CASE n_nationkey % 9 WHEN 2 THEN 12 WHEN 3 THEN 3072 WHEN 4 THEN -2097152 WHEN 7 THEN 0 WHEN 8 THEN 1073741824 END AS number,
CASE n_nationkey % 9 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 5 THEN NULL WHEN 6 THEN FALSE WHEN 7 THEN FALSE ELSE TRUE END AS flag, 'branch' AS section, 'Feature.' || n_name AS subsection, 'merge' AS name FROM nation"""


def modes(spark, sf):
    n = L.table(spark, sf, "nation")
    m = F.element_at(F.array(*(F.lit(x) for x in ["100644", "100755", "100664", "100700", "120000", "040000", "160000"])), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return n.select("n_nationkey", C.normalized_mode(m).alias("mode"), C.mode_kind(C.normalized_mode(m)).alias("kind"), C.bisect_steps(F.col("n_nationkey")).alias("steps"), C.similarity_percent(F.col("n_nationkey") * 2400).alias("percent"))


MODES = """SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN '100644' WHEN 1 THEN '100755' WHEN 2 THEN '100644' WHEN 3 THEN '100755' WHEN 4 THEN '120000' WHEN 5 THEN '40000' ELSE '160000' END AS mode,
CASE n_nationkey % 7 WHEN 4 THEN 'symlink' WHEN 5 THEN 'directory' WHEN 6 THEN 'gitlink' ELSE 'file' END AS kind,
CAST(CASE WHEN n_nationkey < 3 THEN 0 WHEN 2 ** floor(log2(n_nationkey)) < 3 * (n_nationkey - 2 ** floor(log2(n_nationkey))) THEN floor(log2(n_nationkey)) ELSE floor(log2(n_nationkey)) - 1 END AS BIGINT) AS steps,
CAST(n_nationkey * 2400 * 100 // 60000 AS BIGINT) AS percent FROM nation"""

QUERIES = {"pathspec": pathspec, "ignore": ignore, "attributes": attributes, "sparse_cone": sparse_cone, "sparse_patterns": sparse_patterns, "ref_names": ref_names, "fn_messages": messages, "fn_identities": identities, "fn_object_ids": blob_ids, "fn_paths": paths, "fn_settings": settings, "fn_modes": modes}
ORACLES = {"pathspec": PATHSPEC, "ignore": IGNORE_SQL, "attributes": ATTR_SQL, "sparse_cone": CONE_SQL, "sparse_patterns": SPARSE_SQL, "ref_names": NAMES, "fn_messages": MESSAGES, "fn_identities": IDENTITIES, "fn_object_ids": OIDS, "fn_paths": PATHS_SQL, "fn_settings": SETTINGS, "fn_modes": MODES}
