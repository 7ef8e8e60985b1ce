"""Ref logs: selectors, as-of lookup, expiry, repair, and the stash as one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import carried, numbered


def shown(log: DataFrame) -> DataFrame:
    """The log with n, counted from the newest entry, and its selector; a ref's log may fill many range partitions."""
    placed = numbered(log, "ref", "seq", name="_place")
    last = placed.groupBy("ref").agg(F.max("_place").alias("_last"))
    n = F.col("_last") - F.col("_place")
    return placed.join(last, "ref").withColumn("n", n).withColumn("selector", F.concat(F.col("ref").cast("string"), F.lit("@{"), F.col("n").cast("string"), F.lit("}"))).select(*log.columns, "n", "selector")


def at_index(log: DataFrame, n: int) -> DataFrame:
    """(ref, oid) of ref@{n}; refs with fewer entries give none."""
    return shown(log).where(F.col("n") == n).select("ref", F.col("new_oid").alias("oid"))


def at_date(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(ref, ts, oid) for each asked (ref, ts): the newest entry not after ts, else what the oldest entry replaced.

    Probes and entries stand in one order by time, in range partitions, so a ref's rows
    pass once whatever the number of probes, and a ref of many entries is no one task's.
    """
    entries = log.select("ref", "ts", F.lit(0).alias("kind"), "seq", F.struct("new_oid").alias("entry"))
    probes = asked.select("ref", "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"))
    oldest = log.groupBy("ref").agg(F.min_by("old_oid", "seq").alias("before"))
    found = carried(entries.unionByName(probes), "entry", "ref", "ts", "kind", "seq", name="e").where("kind = 1")
    return found.join(oldest, "ref").select("ref", "ts", F.when(F.col("e").isNull(), F.col("before")).otherwise(F.col("e.new_oid")).alias("oid"))


def expired(log: DataFrame, reachable: DataFrame, cutoff: int, unreachable_cutoff: int) -> DataFrame:
    """The entries that stay: not older than the cutoff for what refs reach, or than the other one."""
    r = reachable.select(F.col("oid").alias("_r")).distinct()
    j = log.join(r, F.col("new_oid") == F.col("_r"), "left")
    return j.where(F.col("ts") >= F.when(F.col("_r").isNotNull(), cutoff).otherwise(unreachable_cutoff)).drop("_r")


def without(log: DataFrame, n: int, rewrite: bool = True) -> DataFrame:
    """Each ref's log without ref@{n}; with rewrite the entry after it takes over the old id."""
    s = shown(log)
    gone = s.where(F.col("n") == n).select(F.col("ref").alias("_ref"), F.col("old_oid").alias("_old"))  # one a ref
    j = s.join(gone, F.col("ref") == F.col("_ref"), "left")
    old = F.when(F.lit(rewrite) & (F.col("n") == n - 1) & F.col("_ref").isNotNull(), F.col("_old")).otherwise(F.col("old_oid"))
    return j.withColumn("old_oid", old).where(F.col("n") != n).select(*log.columns)


def deduplicated_refs(*layers: DataFrame) -> DataFrame:
    """(name, oid): refs of several stores, an earlier store's word before a later one's."""
    ranked = [df.select("name", "oid", F.lit(i).alias("rank")) for i, df in enumerate(layers)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df)
    return out.groupBy("name").agg(F.min_by("oid", "rank").alias("oid"))


def stash_stack(log: DataFrame, ref: str = "refs/stash") -> DataFrame:
    """(n, oid, message): the stash, newest first, as the log of its ref."""
    return shown(log.where(F.col("ref") == ref)).select("n", F.col("new_oid").alias("oid"), "message")


def shortlog(commits: DataFrame, key: str = "author") -> DataFrame:
    """(key, n, subjects): a group per name, oldest first, equal times by descending id."""
    rows = F.collect_list(F.struct((-F.col("ts")).alias("t"), F.col("oid").alias("o"), F.col("subject").alias("s")))
    g = commits.groupBy(key).agg(F.count("*").alias("n"), F.reverse(F.array_sort(rows)).alias("rows"))
    return g.select(key, "n", F.transform("rows", lambda r: r["s"]).alias("subjects"))
