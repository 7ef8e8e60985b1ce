"""Ref log, ref, config and generic pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from histframe.operators import logs as G
from histframe.operators import ordered
from histframe.operators import rules as R
from histframe.sources import lenses as L

SEC = "CAST(epoch_us({0}) // 1000000 AS BIGINT)"
LOG = f"""log AS (SELECT user_id AS ref, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, lag(event_id) OVER w AS old_oid, event_id AS new_oid, {SEC.format("ts")} AS ts, event_type AS message
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY ref ORDER BY seq DESC) - 1 AS BIGINT) AS n FROM log)"""
START = 1704067200


def reflog_show(spark, sf):
    return G.shown(L.reflog(spark, sf)).select("ref", "n", "selector", "new_oid", "message")


def reflog_at_index(spark, sf):
    return G.at_index(L.reflog(spark, sf), 3)


def _asked(spark, sf):
    return L.table(spark, sf, "events").groupBy(F.col("user_id").alias("ref")).agg(F.count("*").alias("c")).select("ref", (F.lit(START) + F.col("ref") * 17_000 - 40_000).cast("long").alias("ts"))


def reflog_at_date(spark, sf):
    return G.at_date(L.reflog(spark, sf), _asked(spark, sf))


AT_DATE = f"""WITH {LOG}, asked AS (SELECT DISTINCT ref, CAST({START} + ref * 17000 - 40000 AS BIGINT) AS t FROM log)
SELECT ref, t AS ts, CASE WHEN (SELECT count(*) FROM log l WHERE l.ref = a.ref AND l.ts <= t) > 0 THEN (SELECT max_by(new_oid, seq) FROM log l WHERE l.ref = a.ref AND l.ts <= t)
       ELSE (SELECT old_oid FROM log l WHERE l.ref = a.ref AND l.seq = 0) END AS oid FROM asked a"""


def reflog_expire(spark, sf):
    log = L.reflog(spark, sf)
    reach = log.where("new_oid % 3 = 0").select(F.col("new_oid").alias("oid"))
    return G.expired(log, reach, START + 10 * 86400, START + 20 * 86400).select("ref", "seq", "new_oid", "ts")


def reflog_delete(spark, sf):
    return G.without(L.reflog(spark, sf), 2).select("ref", "seq", "old_oid", "new_oid")


DELETE = f"""WITH {LOG} SELECT ref, seq, CASE WHEN lag(n) OVER w = 2 THEN lag(old_oid) OVER w ELSE old_oid END AS old_oid, new_oid FROM shown WINDOW w AS (PARTITION BY ref ORDER BY seq) QUALIFY n <> 2"""


def stash_list(spark, sf):
    return G.stash_stack(L.reflog(spark, sf).withColumn("ref", F.when(F.col("ref") == 7, "refs/stash").otherwise(F.col("ref").cast("string"))))


def refs_enumerate(spark, sf):
    c = L.table(spark, sf, "customer")
    loose = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("refs/heads/c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_nationkey").alias("oid"))
    packed = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("refs/heads/c"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_nationkey") + 100).alias("oid"))
    return G.deduplicated_refs(loose, packed)


REFS = "SELECT 'refs/heads/c' || CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE c_nationkey + 100 END AS oid FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0"


def _config(spark, sf):
    n = L.table(spark, sf, "nation")
    return n.select((F.col("n_regionkey") % 4).alias("scope_rank"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("core.k"), (F.col("n_nationkey") % 13).cast("string")).alias("key"), F.col("n_name").alias("value"))


CONFIG = "config AS (SELECT n_regionkey % 4 AS scope_rank, n_nationkey AS ord, 'core.k' || CAST(n_nationkey % 13 AS VARCHAR) AS key, n_name AS value FROM nation)"


def config_get(spark, sf):
    return R.config_get(_config(spark, sf))


def config_get_all(spark, sf):
    return R.config_all(_config(spark, sf)).select("key", "n", F.array_join("values", ",").alias("values"))


def shortlog(spark, sf):
    return G.shortlog(L.commits(spark, sf)).select("author", "n", F.sha1(F.array_join("subjects", "\n")).alias("subjects_sha1"))


SHORTLOG = f"""SELECT o_custkey AS author, count(*) AS n, sha1(string_agg(o_orderpriority || ' ' || o_orderstatus, chr(10) ORDER BY {SEC.format("o_orderdate")} * 1000000 + o_orderkey, o_orderkey DESC)) AS subjects_sha1 FROM orders GROUP BY o_custkey"""

# --- the generic operators ------------------------------------------------------------------------------------


def op_map(spark, sf):
    return L.table(spark, sf, "orders").select("o_orderkey", F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("mapped"))


def op_filter(spark, sf):
    return L.table(spark, sf, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


def op_flat_map(spark, sf):
    return L.table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


def op_pipe(spark, sf):
    late = lambda d: d.where("l_shipdate >= timestamp_ntz'1998-01-01'")
    lean = lambda d: d.select("l_orderkey", (F.col("l_linenumber") * 10).alias("ten"))
    return L.table(spark, sf, "lineitem").transform(late).transform(lean)


def op_find(spark, sf):
    return L.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").orderBy("o_orderkey").limit(1).select("o_orderkey", "o_custkey")


def op_take(spark, sf):
    return L.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_custkey")


def op_group_by(spark, sf):
    return L.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


def op_count(spark, sf):
    return L.table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


def op_numbered(spark, sf):
    return ordered.numbered(L.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def event_windows(spark, sf):
    e = L.table(spark, sf, "events").withColumn("hour", F.floor(L.seconds(F.col("ts")) / 3600).cast("long"))
    return e.groupBy("hour", "event_type").agg(F.count("*").alias("n"))


QUERIES = {"reflog_show": reflog_show, "reflog_at_index": reflog_at_index, "reflog_at_date": reflog_at_date, "reflog_expire": reflog_expire, "reflog_delete": reflog_delete, "stash_list": stash_list, "refs_enumerate": refs_enumerate, "config_get": config_get, "config_get_all": config_get_all, "shortlog": shortlog, "op_map": op_map, "op_filter": op_filter, "op_flat_map": op_flat_map, "op_pipe": op_pipe, "op_find": op_find, "op_take": op_take, "op_group_by": op_group_by, "op_count": op_count, "op_numbered": op_numbered, "event_windows": event_windows}
ORACLES = {
    "reflog_show": f"WITH {LOG} SELECT ref, n, CAST(ref AS VARCHAR) || '@{{' || CAST(n AS VARCHAR) || '}}' AS selector, new_oid, message FROM shown",
    "reflog_at_index": f"WITH {LOG} SELECT ref, new_oid AS oid FROM shown WHERE n = 3",
    "reflog_at_date": AT_DATE,
    "reflog_expire": f"WITH {LOG} SELECT ref, seq, new_oid, ts FROM log WHERE ts >= CASE WHEN new_oid % 3 = 0 THEN {START + 10 * 86400} ELSE {START + 20 * 86400} END",
    "reflog_delete": DELETE,
    "stash_list": f"WITH {LOG} SELECT n, new_oid AS oid, message FROM shown WHERE ref = 7",
    "refs_enumerate": REFS,
    "config_get": f"WITH {CONFIG} SELECT key, CASE WHEN count(*) = 1 THEN min(value) END AS value, count(*) > 1 AS error FROM config GROUP BY key",
    "config_get_all": f"WITH {CONFIG} SELECT key, count(*) AS n, string_agg(value, ',' ORDER BY scope_rank, ord) AS values FROM config GROUP BY key",
    "shortlog": SHORTLOG,
    "op_map": "SELECT o_orderkey, o_orderstatus || ':' || o_orderpriority AS mapped FROM orders",
    "op_filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "op_flat_map": "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)",
    "op_pipe": "SELECT l_orderkey, l_linenumber * 10 AS ten FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
    "op_find": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1",
    "op_take": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "op_group_by": "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey",
    "op_count": "SELECT count(*) AS n FROM lineitem",
    "op_numbered": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS pos FROM orders",
    "event_windows": f"SELECT {SEC.format('ts')} // 3600 AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
