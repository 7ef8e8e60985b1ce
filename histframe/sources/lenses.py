"""State tables read out of the synthetic star schema.

A lens is a deterministic projection: rows of business tables stand for tree entries,
commits, ref log lines or blobs, so that history operators run on any amount of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 by the wall clock that the table holds, whatever the session's zone."""
    return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


# --- L1: three snapshots of parts -----------------------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.concat_ws("/", "p_brand", "p_type", k.cast("string")).alias("path"),
        F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("body"),
        F.when(k % 29 == 0, "120000").otherwise("100644").alias("mode"),
        F.col("p_size").cast("long").alias("size"),
    )


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, oid, mode) of the committed tree."""
    return _parts(spark, sf_dir).where("k % 13 != 0").select("path", F.sha1("body").alias("oid"), "mode")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, stage, oid, mode): stage 0, or the stages 1 to 3 of a conflicted path."""
    p = _parts(spark, sf_dir).where("k % 11 != 0")
    mode = F.when((F.col("k") % 31 == 0) & (F.col("mode") == "100644"), "100755").otherwise(F.col("mode"))
    plain = p.where("k % 17 != 0").select("path", F.lit(0).alias("stage"), F.sha1(F.when(F.col("k") % 7 == 0, F.concat("body", F.lit("#i"))).otherwise(F.col("body"))).alias("oid"), mode.alias("mode"))
    # the seven sets of stages in turn
    bits = (F.col("k") / 17).cast("long") % 7 + 1
    stages = F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda s: bits.bitwiseAND(F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), s).cast("long")) != 0))
    unmerged = p.where("k % 17 = 0").select("path", "body", "mode", stages.alias("stage"))
    return plain.unionByName(unmerged.select("path", "stage", F.sha1(F.concat_ws("#", "body", F.col("stage").cast("string"))).alias("oid"), "mode"))


def workdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, oid, mode) of the working copy."""
    p = _parts(spark, sf_dir)
    kept = p.where("k % 19 != 0").select("path", F.sha1(F.when(F.col("k") % 5 == 0, F.concat("body", F.lit("#w"))).otherwise(F.col("body"))).alias("oid"), "mode")
    extra = p.where("k % 23 = 0").select(F.concat(F.lit("tmp/"), F.col("k").cast("string")).alias("path"), F.sha1("body").alias("oid"), F.lit("100644").alias("mode"))
    return kept.unionByName(extra)


def merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, oid, mode) of base, ours and theirs."""
    p = _parts(spark, sf_dir)

    def side(drop: str, salt: str, tag: str, kind: str) -> DataFrame:
        body = F.when(F.expr(salt), F.concat("body", F.lit(tag))).otherwise(F.col("body"))
        mode = F.when(F.expr(kind), "120000").otherwise(F.lit("100644"))
        return p.where(f"not ({drop})").select("path", F.sha1(body).alias("oid"), mode.alias("mode"))

    return side("k % 6 = 0", "false", "", "k % 37 = 0"), side("k % 10 = 1", "k % 4 = 1", "#o", "k % 37 = 0 or k % 41 = 0"), side("k % 15 = 2", "k % 9 = 2 or k % 12 = 1", "#o", "k % 37 = 0 or k % 43 = 0")


# --- L2: commits out of orders --------------------------------------------------------------------------------


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, parent0, parent1, author, ts, subject): a customer's orders in a row; an urgent one also merges the newest earlier order of the customer before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("author"), (seconds(F.col("o_orderdate")) * 1_000_000 + F.col("o_orderkey")).alias("ts"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    own = Window.partitionBy("author").orderBy("ts")
    chained = o.withColumn("parent0", F.lag("oid").over(own))
    # as-of: probes and candidates in one ordered window, so no row meets more than its neighbours
    candidates = o.select((F.col("author") + 1).alias("c"), "ts", F.col("oid").alias("cand"), F.lit(None).cast("long").alias("probe"))
    probes = o.where("priority = '1-URGENT'").select(F.col("author").alias("c"), "ts", F.lit(None).cast("long").alias("cand"), F.col("oid").alias("probe"))
    upto = Window.partitionBy("c").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    merged = candidates.unionByName(probes).withColumn("parent1", F.last("cand", ignorenulls=True).over(upto)).where("probe is not null").select(F.col("probe").alias("oid"), "parent1")
    return chained.join(merged, "oid", "left").select("oid", "parent0", "parent1", "author", "ts", F.concat_ws(" ", "priority", "status").alias("subject"))


def edges(commits: DataFrame) -> DataFrame:
    """(child, parent, idx) of every parent link."""
    first = commits.where("parent0 is not null").select(F.col("oid").alias("child"), F.col("parent0").alias("parent"), F.lit(0).alias("idx"))
    second = commits.where("parent1 is not null").select(F.col("oid").alias("child"), F.col("parent1").alias("parent"), F.expr("if(parent0 is null, 0, 1)").alias("idx"))
    return first.unionByName(second)


def branches(commits: DataFrame) -> DataFrame:
    """(name, oid): a branch at the last order of each customer."""
    tip = commits.groupBy("author").agg(F.max_by("oid", "ts").alias("oid"))
    return tip.select(F.concat(F.lit("refs/heads/c"), F.col("author").cast("string")).alias("name"), "oid")


def tags(commits: DataFrame) -> DataFrame:
    """(name, oid, annotated, tagger_ts): every tenth commit is tagged, every other tag annotated."""
    t = commits.where("oid % 10 = 0")
    return t.select(F.concat(F.lit("refs/tags/v"), F.col("oid").cast("string")).alias("name"), "oid", (F.col("oid") % 20 == 0).alias("annotated"), F.expr("if(oid % 20 = 0, ts + 1, cast(null as bigint))").alias("tagger_ts"))


# --- L3: a ref log out of events ------------------------------------------------------------------------------


def reflog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, seq, old_oid, new_oid, ts, message): seq counts from 0, oldest first."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("ref"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.lag("event_id").over(w).alias("old_oid"), F.col("event_id").alias("new_oid"), seconds(F.col("ts")).alias("ts"), F.col("event_type").alias("message"))


# --- L4 and L5: blobs and versions ----------------------------------------------------------------------------


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, oid, size, content) of documents."""
    from histframe.functions.scalar import blob_oid

    d = table(spark, sf_dir, "documents").withColumn("content", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), blob_oid(F.col("content")).alias("oid"), F.octet_length("content").cast("long").alias("size"), "content")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, version, content): version n of a conversation holds its turns up to n, a line each."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), F.lit("\n")))
    w = Window.partitionBy("conv_id").orderBy("turn", "line")
    return c.select(F.col("conv_id").alias("file"), (F.row_number().over(w) - 1).cast("long").alias("version"), F.array_join(F.collect_list("line").over(w.rowsBetween(Window.unboundedPreceding, 0)), "").alias("content"))


# --- L6: paths ------------------------------------------------------------------------------------------------


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): host and path of each URL, without scheme, query and fragment."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
