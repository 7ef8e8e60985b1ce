"""Content queries over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from histframe.functions.scalar import is_binary
from histframe.operators import content as C
from histframe.scratch import written
from histframe.sources import lenses as L

LINES = "l AS (SELECT path, i AS n, line FROM (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS k FROM documents WHERE text <> '') WHERE NOT (i = k AND line = ''))"


def grep(spark, sf):
    b = L.blobs(spark, sf).select("path", "content")
    g = C.grep(b, ["token = ", r"@mail\d"], word=False)
    return g.select("path", "n", F.sha1("line").alias("line_sha1"), "spans")


GREP = f"WITH {LINES} SELECT path, CAST(n AS BIGINT) AS n, sha1(line) AS line_sha1, CAST(len(regexp_extract_all(line, 'token = ')) + len(regexp_extract_all(line, '@mail\\d')) AS BIGINT) AS spans FROM l WHERE regexp_matches(line, 'token = |@mail\\d')"


def grep_inverted(spark, sf):
    return C.grep(L.blobs(spark, sf).select("path", "content"), ["THE", "de", "und"], fixed=True, ignore_case=True, invert=True).groupBy("path").agg(F.count("*").alias("n"))


INVERTED = f"WITH {LINES} SELECT path, count(*) AS n FROM l WHERE NOT regexp_matches(line, '(?i)the|de|und') GROUP BY path"


def split(spark, sf):
    return C.lines(L.blobs(spark, sf)).groupBy("path").agg(F.count("*").alias("n"), F.max(F.length("line")).cast("long").alias("longest"))


def binary_flags(spark, sf):
    d = L.blobs(spark, sf)
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.decode(F.lit(bytearray(b"\0")), "UTF-8"))).otherwise(F.col("content"))
    return d.select("doc_id", is_binary(marked).alias("is_binary"))


def _whitespace(b):
    d = b.select("doc_id", F.col("content").alias("old"), F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("content", " ", "  ")).otherwise(F.concat("content", F.lit("x"))).alias("new"))
    out = C.whitespace_only(d, "change")
    return out.select("doc_id", "ws_only")


def whitespace(spark, sf):
    return _whitespace(L.blobs(spark, sf))


def numstat(spark, sf):
    s = C.steps(L.versions(spark, sf))
    return C.numstat(s).select("file", "version", "added", "deleted")


def numstat_blanks(spark, sf):
    """Each document against itself with its blanks doubled, counted with and without blanks."""
    b = L.blobs(spark, sf).select("doc_id", F.col("content").alias("old"), F.regexp_replace("content", " ", "  ").alias("new"))
    exact = C.numstat(b).select("doc_id", F.col("added").alias("exact"))
    return C.numstat(b, "change").select("doc_id", F.col("added").alias("change")).join(exact, "doc_id")


NUMSTAT_BLANKS = f"WITH {LINES}, d AS (SELECT doc_id, lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents) SELECT doc_id, CAST(0 AS BIGINT) AS change, CAST(coalesce(n, 0) AS BIGINT) AS exact FROM d LEFT JOIN (SELECT path, count(*) AS n FROM l WHERE contains(line, ' ') GROUP BY path) USING (path)"

NUMSTAT = "SELECT conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS version, CAST(1 AS BIGINT) AS added, CAST(0 AS BIGINT) AS deleted FROM conversations"


def blame(spark, sf):
    return C.blame(L.versions(spark, sf))


BLAME = "SELECT conv_id AS file, CAST(i + 1 AS BIGINT) AS line, CAST(i AS BIGINT) AS origin FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"


def patches(spark, sf):
    p = C.steps(L.versions(spark, sf)).withColumn("path", F.concat(F.lit("c"), F.col("file").cast("string")))
    return C.patches(p).select("file", "version", F.length("patch").cast("long").alias("size"), "patch_id")


#: Each version adds a line, after up to three lines of context.
PATCHES = r"""WITH l AS (SELECT conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS version, role || ': ' || replace(coalesce(text, ''), chr(10), ' ') AS line FROM conversations),
c AS (SELECT *, least(version, 3) AS n, coalesce(string_agg(' ' || line || chr(10), '') OVER (PARTITION BY file ORDER BY version ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before FROM l),
p AS (SELECT *, 'c' || CAST(file AS VARCHAR) AS path, before || '+' || line || chr(10) AS body FROM c),
h AS (SELECT *, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- ' || CASE WHEN version = 0 THEN '/dev/null' ELSE 'a/' || path END || chr(10) || '+++ b/' || path || chr(10) AS head,
             '@@ -' || CASE WHEN version = 0 THEN '0,0' ELSE CAST(version - n + 1 AS VARCHAR) || CASE WHEN n = 1 THEN '' ELSE ',' || CAST(n AS VARCHAR) END END || ' +' || CAST(version - n + 1 AS VARCHAR) || CASE WHEN n = 0 THEN '' ELSE ',' || CAST(n + 1 AS VARCHAR) END || ' @@' || chr(10) AS hunk FROM p)
SELECT file, version, CAST(length(head || hunk || body) AS BIGINT) AS size, sha1(regexp_replace(head || body, '\s', '', 'g')) AS patch_id FROM h"""


KINDS = ["add", "delete", "modify", "rename", "copy", "type-change", "modify", "modify", "rename"]


def patch_headers(spark, sf):
    """Parts as changes of every kind: the seventh is a change of mode, the eighth a rewrite, the ninth a rename of an equal file."""
    p, k = L.table(spark, sf, "part"), F.col("p_partkey") % len(KINDS)
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k + 1).cast("int"))
    old, new = F.concat("p_name", F.lit("\n")), F.concat("p_type", F.lit("\n"))
    path = F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))
    changes = p.select(
        path.alias("path"), pick(*KINDS).alias("kind"), F.when(k.isin(3, 4, 8), F.concat(F.lit("old/"), path)).alias("old_path"), F.when(k != 0, F.sha1(old)).alias("old_oid"), F.when(k == 1, None).when(k.isin(6, 8), F.sha1(old)).otherwise(F.sha1(new)).alias("new_oid"),
        F.when(k != 0, "100644").alias("old_mode"), F.when(k == 1, None).when(k == 5, "120000").when(k.isin(4, 6), "100755").otherwise("100644").alias("new_mode"),
        F.when(k != 0, old).alias("old"), F.when(k == 1, None).when(k.isin(6, 8), old).when(k == 5, F.col("p_type")).otherwise(new).alias("new"), F.when(k.isin(3, 4), 45_000).when(k == 7, 50_000).when(k == 8, 60_000).alias("score"),
    )
    return C.rendered(changes).select("path", F.sha1("patch").alias("patch_sha1"), F.length("patch").cast("long").alias("size"))


HEADERS = """WITH p AS (SELECT p_partkey % 9 AS k, p_brand || '/' || CAST(p_partkey AS VARCHAR) AS p, chr(10) AS n, p_name AS o, p_type AS t, substr(sha1(p_name || chr(10)), 1, 7) AS a, substr(sha1(p_type || chr(10)), 1, 7) AS b FROM part),
h AS (SELECT p, CASE k
 WHEN 0 THEN 'diff --git a/' || p || ' b/' || p || n || 'new file mode 100644' || n || 'index 0000000..' || b || n || '--- /dev/null' || n || '+++ b/' || p || n || '@@ -0,0 +1 @@' || n || '+' || t || n
 WHEN 1 THEN 'diff --git a/' || p || ' b/' || p || n || 'deleted file mode 100644' || n || 'index ' || a || '..0000000' || n || '--- a/' || p || n || '+++ /dev/null' || n || '@@ -1 +0,0 @@' || n || '-' || o || n
 WHEN 2 THEN 'diff --git a/' || p || ' b/' || p || n || 'index ' || a || '..' || b || ' 100644' || n || '--- a/' || p || n || '+++ b/' || p || n || '@@ -1 +1 @@' || n || '-' || o || n || '+' || t || n
 WHEN 3 THEN 'diff --git a/old/' || p || ' b/' || p || n || 'similarity index 75%' || n || 'rename from old/' || p || n || 'rename to ' || p || n || 'index ' || a || '..' || b || ' 100644' || n || '--- a/old/' || p || n || '+++ b/' || p || n || '@@ -1 +1 @@' || n || '-' || o || n || '+' || t || n
 WHEN 4 THEN 'diff --git a/old/' || p || ' b/' || p || n || 'old mode 100644' || n || 'new mode 100755' || n || 'similarity index 75%' || n || 'copy from old/' || p || n || 'copy to ' || p || n || 'index ' || a || '..' || b || n || '--- a/old/' || p || n || '+++ b/' || p || n || '@@ -1 +1 @@' || n || '-' || o || n || '+' || t || n
 WHEN 5 THEN 'diff --git a/' || p || ' b/' || p || n || 'deleted file mode 100644' || n || 'index ' || a || '..0000000' || n || '--- a/' || p || n || '+++ /dev/null' || n || '@@ -1 +0,0 @@' || n || '-' || o || n
        || 'diff --git a/' || p || ' b/' || p || n || 'new file mode 120000' || n || 'index 0000000..' || b || n || '--- /dev/null' || n || '+++ b/' || p || n || '@@ -0,0 +1 @@' || n || '+' || t || n || chr(92) || ' No newline at end of file' || n
 WHEN 6 THEN 'diff --git a/' || p || ' b/' || p || n || 'old mode 100644' || n || 'new mode 100755' || n || 'index ' || a || '..' || a || n
 WHEN 7 THEN 'diff --git a/' || p || ' b/' || p || n || 'dissimilarity index 83%' || n || 'index ' || a || '..' || b || ' 100644' || n || '--- a/' || p || n || '+++ b/' || p || n || '@@ -1 +1 @@' || n || '-' || o || n || '+' || t || n
 ELSE 'diff --git a/old/' || p || ' b/' || p || n || 'similarity index 100%' || n || 'rename from old/' || p || n || 'rename to ' || p || n END AS x FROM p)
SELECT p AS path, sha1(x) AS patch_sha1, CAST(length(x) AS BIGINT) AS size FROM h"""


def merged(spark, sf):
    v = L.versions(spark, sf).groupBy("file").agg(F.max_by("content", "version").alias("base"), F.max("version").alias("last"))
    t = v.select("file", "base", F.concat(F.lit("top\n"), "base").alias("ours"), F.concat("base", F.when(F.col("file") % 2 == 0, "end\n").otherwise("")).alias("theirs"))
    return C.merge(t).select("file", F.sha1("merged").alias("merged"), "conflicts")


MERGED = """WITH v AS (SELECT conv_id AS file, string_agg(role || ': ' || replace(text, chr(10), ' ') || chr(10), '' ORDER BY turn) AS base FROM conversations GROUP BY conv_id)
SELECT file, sha1('top' || chr(10) || base || CASE WHEN file % 2 = 0 THEN 'end' || chr(10) ELSE '' END) AS merged, CAST(0 AS BIGINT) AS conflicts FROM v"""


def _similarity(b):
    """Each text with its edited copy."""
    edited = b.select(F.concat("path", F.lit("~")).alias("path"), F.concat("oid", F.lit("~")).alias("oid"), (F.col("size") + 5).alias("size"), F.concat(F.lit("line\n"), "content").alias("content"))
    pairs = b.select(F.col("oid").alias("src"), F.concat("oid", F.lit("~")).alias("dst")).distinct()
    return C.similarity(b.select("path", "oid", "size", "content").unionByName(edited), pairs)


def similarity(spark, sf):
    return _similarity(L.blobs(spark, sf))


OID = "sha1(encode('blob ' || CAST(strlen(coalesce(text, '')) AS VARCHAR)) || '\\x00'::BLOB || encode(coalesce(text, '')))"
SIMILARITY = f"""WITH b AS (SELECT DISTINCT {OID} AS oid, strlen(coalesce(text, '')) AS size FROM documents)
SELECT oid AS src, oid || '~' AS dst, CAST(size * 60000 // (size + 5) AS BIGINT) AS score FROM b"""


def renames(spark, sf):
    b = L.blobs(spark, sf).dropDuplicates(["oid"])
    gone = b.select("path", "oid", "size", "content")
    new = b.select(F.concat(F.lit("new/"), "path").alias("path"), F.concat("oid", F.lit("n")).alias("oid"), (F.col("size") + 8).alias("size"), F.concat("content", F.lit("\nadded!\n")).alias("content"))
    return C.inexact_renames(gone, new, limit=0)


def renames_full(spark, sf):
    """Documents by fifths moved and edited, edited, copied and edited, rewritten, and left; with copies and rewrites looked for."""
    b = L.blobs(spark, sf).withColumn("k", F.col("doc_id") % 5)
    edited = F.concat("content", F.lit("\nadded!\n"))
    turned = F.concat(F.reverse("content"), F.lit("!"))
    version = lambda rows, path, text: rows.select(path.alias("path"), F.sha1(text).alias("oid"), F.octet_length(text).cast("long").alias("size"), text.alias("content"))
    path, same = F.col("path"), F.col("content")
    old = version(b, path, same)
    new = version(b.where("k = 0"), F.concat(F.lit("moved/"), path), edited).unionByName(version(b.where("k in (1, 2)"), path, edited)).unionByName(version(b.where("k = 2"), F.concat(F.lit("copy/"), path), F.concat("content", F.lit("\nother\n"))))
    new = written(new.unionByName(version(b.where("k = 3"), path, turned)).unionByName(version(b.where("k = 4"), path, same)), "new")
    side = lambda t, n: t.select("path", F.col("oid").alias(n))
    j = side(old, "old_oid").join(side(new, "new_oid"), "path", "full")
    kind = F.when(F.col("old_oid").isNull(), "add").when(F.col("new_oid").isNull(), "delete").when(F.col("old_oid") != F.col("new_oid"), "modify")
    diff = written(j.select("path", kind.alias("kind"), "old_oid", "new_oid").where("kind is not null"), "diff")
    return C.renames(diff, old.unionByName(new).select("oid", "size", "content"), copies="on", breaks=(0, 0), limit=0)


def range_diff(spark, sf):
    """A conversation is a series."""
    p = C.patches(C.steps(L.versions(spark, sf)).withColumn("path", F.lit("f")))
    p = p.select(F.col("file").alias("series"), (F.col("file") * 100 + F.col("version")).alias("n"), "patch")
    side = lambda name, patch: F.struct(F.lit(name).alias("side"), patch.alias("patch"))
    new = side("new", F.when(F.col("n") % 5 == 0, F.concat("patch", F.lit("+more\n"))).otherwise(F.col("patch")))
    sides = F.explode(F.when(F.col("n") % 3 != 0, F.array(side("old", F.col("patch")), new)).otherwise(F.array(side("old", F.col("patch")))))
    return C.range_diff(p.select("series", "n", sides.alias("s")).select("series", "n", "s.*"))


def notes(spark, sf):
    n = L.table(spark, sf, "labels")
    return L.blobs(spark, sf).select("doc_id", "oid").join(n, "doc_id").select("oid", "doc_id", "quality", "toxic")


def _cat_file(spark, sf, asked):
    """Asked-for ids in their order, each with its object or as missing."""
    b = L.blobs(spark, sf)
    asked = asked.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("f" * 40)).otherwise(F.sha1("text")).alias("x"))
    ids = asked.join(b.select("doc_id", "oid"), "doc_id").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("x")).otherwise(F.col("oid")).alias("oid"))
    objects = b.groupBy("oid").agg(F.first("size").alias("size"))
    return ids.join(objects, "oid", "left").select(F.col("doc_id").alias("ord"), "oid", F.col("size").isNotNull().alias("ok"), "size")


def cat_file(spark, sf):
    return _cat_file(spark, sf, L.table(spark, sf, "documents"))


CAT = f"SELECT doc_id AS ord, CASE WHEN doc_id % 7 = 0 THEN repeat('f', 40) ELSE {OID} END AS oid, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 7 <> 0 THEN CAST(strlen(coalesce(text, '')) AS BIGINT) END AS size FROM documents"


def enumerate_objects(spark, sf):
    return L.blobs(spark, sf).select("oid").distinct()


QUERIES = {"grep": grep, "grep_inverted": grep_inverted, "split_lines": split, "binary_flags": binary_flags, "whitespace_only": whitespace, "numstat": numstat, "numstat_blanks": numstat_blanks, "blame": blame, "patch_text": patches, "patch_headers": patch_headers, "merge_content": merged, "similarity": similarity, "inexact_renames": renames, "renames_full": renames_full, "range_diff": range_diff, "notes_list": notes, "cat_file_batch": cat_file, "enumerate_objects": enumerate_objects}
ORACLES = {
    "grep": GREP, "grep_inverted": INVERTED, "split_lines": f"WITH {LINES} SELECT path, count(*) AS n, CAST(max(length(line)) AS BIGINT) AS longest FROM l GROUP BY path", "binary_flags": "SELECT doc_id, doc_id % 5 = 0 AND strlen(coalesce(text, '')) < 8000 AS is_binary FROM documents",
    "whitespace_only": "SELECT doc_id, doc_id % 4 = 0 AS ws_only FROM documents", "numstat": NUMSTAT, "numstat_blanks": NUMSTAT_BLANKS, "blame": BLAME, "merge_content": MERGED, "patch_text": PATCHES, "patch_headers": HEADERS, "similarity": SIMILARITY,
    "notes_list": f"SELECT {OID} AS oid, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)", "cat_file_batch": CAT, "enumerate_objects": f"SELECT DISTINCT {OID} AS oid FROM documents",
}
