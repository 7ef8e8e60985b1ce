"""Queries of the value functions over parts, customers and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from histframe.functions import values as V
from histframe.operators import content as C
from histframe.operators import places as P
from histframe.operators import reading as R
from histframe.sources import lenses as L

from .content import LINES

CRC = """t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _parts(spark, sf):
    return L.table(spark, sf, "part").withColumn("k", F.col("p_partkey"))


def fn_bytes(spark, sf):
    name, brand = F.encode("p_name", "UTF-8"), F.encode("p_brand", "UTF-8")
    return _parts(spark, sf).select("k", V.hexed(name).alias("hexed"), F.decode(V.unhexed(V.hexed(brand)), "UTF-8").alias("back"), V.unhexed(F.col("p_name")).isNull().alias("refused"), V.bytes_order(name, brand).alias("ordered"), V.crc(F.col("p_name")).alias("crc"))


FN_BYTES = f"""WITH {CRC}, p AS (SELECT *, hex(encode(p_name)) AS h FROM part)
SELECT p_partkey AS k, lower(h) AS hexed, p_brand AS back, NOT regexp_full_match(p_name, '([0-9a-fA-F]{{2}})*') AS refused, CASE WHEN h < hex(encode(p_brand)) THEN -1 WHEN h > hex(encode(p_brand)) THEN 1 ELSE 0 END AS ordered,
       xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(p_name)), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))), lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 + 1 AS BIGINT)])), 4294967295) AS crc
FROM p, t"""


def line_digests(spark, sf):
    """Lines that a mode takes for equal, by their digests; every other line gets more blanks first."""
    lines = C.lines(L.blobs(spark, sf)).withColumn("line", F.when(F.col("n") % 2 == 0, F.regexp_replace("line", " ", "  ")).otherwise(F.col("line")))
    return lines.groupBy("path").agg(F.countDistinct(V.line_digest(F.col("line"), "change")).alias("change"), F.countDistinct(V.line_digest(F.col("line"), "all")).alias("all"))


_NORMAL = r"regexp_replace(line, '[ \t\r\f\x0B]+', '{0}', 'g')"
DIGESTS = rf"WITH {LINES} SELECT path, count(DISTINCT regexp_replace(regexp_replace(line, '[ \t\r\f\x0B]+$', ''), '[ \t\r\f\x0B]+', ' ', 'g')) AS change, count(DISTINCT {_NORMAL.format('')}) AS all FROM l GROUP BY path".replace("AS all", 'AS "all"')


def hunk_headings(spark, sf):
    """Parts of a brand as the lines of a file, every fourth one a heading."""
    line = F.when(F.col("k") % 4 == 0, F.concat(F.upper("p_name"), F.lit(" \t "))).otherwise(F.concat(F.lit("  "), "p_name"))
    rows = _parts(spark, sf).select(F.col("p_brand").alias("path"), F.col("k").alias("n"), line.alias("line"))
    return R.funcname_rows(rows).select("path", "n", "heading")


HEADINGS = "SELECT p_brand AS path, p_partkey AS n, last_value(CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS heading FROM part"

BASES = ["https://host/{}/repo/", "git@host:team/{}", "/srv/{}/x", "dir/{}"]
URLS = ["../m", "../../m/", "./m", "https://other/m", "m"]
#: What each base (down) and URL (across) comes to, by the rule that a step up takes the last part after a slash, else after a colon.
EXPECTED = [
    ["https://host/{}/m", "https://host/m", "https://host/{}/repo/m", "https://other/m", "m"],
    ["git@host:team/m", "git@host:m", "git@host:team/{}/m", "https://other/m", "m"],
    ["/srv/{}/m", "/srv/m", "/srv/{}/x/m", "https://other/m", "m"],
    ["dir/m", "m", "dir/{}/m", "https://other/m", "m"],
]


def relative_urls(spark, sf):
    p = _parts(spark, sf)
    one = lambda texts: F.element_at(F.array(*(F.concat(*(x for i, t in enumerate(text.split("{}")) for x in ([F.col("p_brand")] if i else []) + [F.lit(t)])) for text in texts)), (F.col("at") + 1).cast("int"))
    base = p.withColumn("at", F.col("k") % len(BASES)).withColumn("base", one(BASES)).withColumn("at", F.col("k") % len(URLS)).withColumn("url", one(URLS))
    return base.select("k", "base", V.submodule_url(F.col("base"), F.col("url")).alias("resolved"))


def _case(texts: list[str], number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN " + " || p_brand || ".join(f"'{t}'" for t in text.split("{}")) for i, text in enumerate(texts)) + " END"


RELATIVE = f"SELECT p_partkey AS k, {_case(BASES, f'p_partkey % {len(BASES)}')} AS base, {_case([x for row in EXPECTED for x in row], f'(p_partkey % {len(BASES)}) * {len(URLS)} + p_partkey % {len(URLS)}')} AS resolved FROM part"


def worktree_ids(spark, sf):
    """Brands as names; taken are each brand with the sizes that its parts have, 0 standing for the name alone."""
    p = _parts(spark, sf)
    taken = p.select(F.concat("p_brand", F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 7).cast("string")).otherwise("")).alias("id")).where("length(id) > 0").distinct()
    return P.admin_ids(p.select(F.col("p_brand").alias("name")).distinct(), taken.where("id not like '%3'"))


WORKTREE_IDS = """WITH t AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 7 <> 0 THEN CAST(p_size % 7 AS VARCHAR) ELSE '' END AS id FROM part), taken AS (SELECT id FROM t WHERE id NOT LIKE '%3'),
c AS (SELECT p_brand AS name, k, CASE WHEN k = 0 THEN p_brand ELSE p_brand || CAST(k AS VARCHAR) END AS id FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(100)) AS k))
SELECT name, min_by(id, k) AS id FROM c WHERE id NOT IN (SELECT id FROM taken) GROUP BY name"""


def fn_refs(spark, sf):
    """Which refs get a log, what could name a time, tag ids, filled commands and binary overrides."""
    p, k = _parts(spark, sf), F.col("k")
    pick = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % n + 1).cast("int"))
    ref = pick(5, "HEAD", "refs/heads/a", "refs/tags/a", "refs/notes/a", "refs/x")
    setting, bare = pick(4, "always", "true", "false", None), k % 2 == 0
    cutoff = V.name_cutoff(F.when(k % 10 == 0, 0).otherwise(k * 1000))
    payload = V.tag_payload(F.sha1("p_name"), F.lit("commit"), F.col("p_brand"), F.when(k % 3 != 0, F.lit("A <a@b> 1 +0000")), F.col("p_type"))
    command = V.filled(F.concat(F.lit("run %A %% %P%Q % "), "p_type", F.lit("%")), {"A": F.lit("%P"), "P": F.col("p_brand")})
    value = pick(4, "true", "false", "unspecified", "pdf")
    over = V.binary_override(value, k % 3 != 0, k % 2 == 0)
    return p.select("k", V.gets_log(ref, setting, bare).alias("logged"), cutoff.alias("cutoff"), V.before_cutoff(k * 1000, F.lit(500_000)).alias("early"), F.sha1(F.encode(payload, "UTF-8")).alias("tag_sha1"), command.alias("command"), over["patch"].alias("patch"), over["numstat"].alias("numstat"))


FN_REFS = """WITH p AS (SELECT p_partkey AS k, *, [ 'HEAD', 'refs/heads/a', 'refs/tags/a', 'refs/notes/a', 'refs/x'][p_partkey % 5 + 1] AS ref, ['always', 'true', 'false', NULL][p_partkey % 4 + 1] AS setting, ['true', 'false', 'unspecified', 'pdf'][p_partkey % 4 + 1] AS value FROM part)
SELECT k, CASE WHEN setting = 'always' THEN TRUE WHEN setting = 'false' THEN FALSE WHEN setting IS NULL AND k % 2 = 0 THEN FALSE ELSE k % 5 IN (0, 1, 3) END AS logged,
       CAST(CASE WHEN k % 10 = 0 THEN 0 ELSE k * 1000 - 86400 END AS BIGINT) AS cutoff, k * 1000 < 500000 AS early,
       sha1('object ' || sha1(p_name) || chr(10) || 'type commit' || chr(10) || 'tag ' || p_brand || CASE WHEN k % 3 <> 0 THEN chr(10) || 'tagger A <a@b> 1 +0000' ELSE '' END || chr(10) || chr(10) || p_type) AS tag_sha1,
       'run %P % ' || p_brand || '%Q % ' || p_type || '%' AS command,
       CASE WHEN value = 'false' THEN 'binary' WHEN value = 'true' THEN 'text' WHEN value = 'pdf' AND k % 3 <> 0 THEN 'text' END AS patch,
       CASE WHEN value = 'false' THEN 'binary' WHEN value = 'true' THEN 'text' WHEN value = 'pdf' AND k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'binary' ELSE 'text' END END AS numstat
FROM p"""

QUERIES = {"fn_bytes": fn_bytes, "line_digests": line_digests, "hunk_headings": hunk_headings, "relative_urls": relative_urls, "worktree_ids": worktree_ids, "fn_refs": fn_refs}
ORACLES = {"fn_bytes": FN_BYTES, "line_digests": DIGESTS, "hunk_headings": HEADINGS, "relative_urls": RELATIVE, "worktree_ids": WORKTREE_IDS, "fn_refs": FN_REFS}
