"""Point and set lookups over objects, refs and module rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = 5


def present(ids: DataFrame, objects: DataFrame) -> DataFrame:
    """ids with `exists`: whether an object of that id is known."""
    known = objects.select(F.col("oid").alias("_k")).distinct()
    return ids.join(known, F.col("oid") == F.col("_k"), "left").withColumn("exists", F.col("_k").isNotNull()).drop("_k")


def by_prefix(prefixes: DataFrame, objects: DataFrame, least: int = 4) -> DataFrame:
    """(prefix, oid, ambiguous): the object that a prefix of at least `least` letters names; an ambiguous one names none.

    The join is on the first `least` letters, so no prefix meets every object.
    """
    known = objects.select("oid").distinct().withColumn("_h", F.substring("oid", 1, least))
    p = prefixes.where(F.length("prefix") >= least).withColumn("_h", F.substring("prefix", 1, least))
    hit = p.join(known, (p["_h"] == known["_h"]) & known["oid"].startswith(p["prefix"])).groupBy("prefix").agg(F.count("*").alias("n"), F.first("oid").alias("o"))
    return p.select("prefix").join(hit, "prefix", "left").select("prefix", F.when(F.col("n") == 1, F.col("o")).alias("oid"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def resolved(refs: DataFrame) -> DataFrame:
    """(name, oid) of refs (name, oid, symbolic): symbolic ones followed up to five times; broken ones have a null oid."""
    out = refs.select("name", "oid", "symbolic")
    target = refs.select(F.col("name").alias("_n"), F.col("oid").alias("_o"), F.col("symbolic").alias("_s"))
    for _ in range(LINKS):
        j = out.join(target, out["symbolic"] == target["_n"], "left")
        out = j.select("name", F.when(F.col("symbolic").isNull(), F.col("oid")).otherwise(F.col("_o")).alias("oid"), F.when(F.col("symbolic").isNotNull(), F.col("_s")).alias("symbolic"))
    return out.select("name", F.when(F.col("symbolic").isNull(), F.col("oid")).alias("oid"))


def submodules(tree: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, oid, name, url) of the tree's module entries; without a row of its own a module is called like its path."""
    m = modules.select(F.col("path").alias("_p"), F.col("name").alias("_name"), "url")
    return tree.where("mode = '160000'").join(m, F.col("path") == F.col("_p"), "left").select("path", "oid", F.coalesce("_name", "path").alias("name"), "url")


def object_filter(objects: DataFrame, spec: str) -> DataFrame:
    """objects (type, size, depth) that a filter keeps: blob:none, blob:limit=<n>[kmg], tree:<depth>."""
    kind, _, value = spec.partition(":")
    if spec == "blob:none":
        return objects.where("type != 'blob'")
    if kind == "blob" and value.startswith("limit="):
        number = value.removeprefix("limit=").lower()
        factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(number[-1:], 1)
        n = int(number.rstrip("kmg")) * factor
        return objects.where((F.col("type") != "blob") | (F.col("size") < n))
    if kind == "tree":
        return objects.where(~F.col("type").isin("tree", "blob") | (F.col("depth") < int(value)))
    raise ValueError(f"unknown filter {spec!r}")


def changed_by_commit(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """(oid, path, kind): each non-merge commit against its first parent, a root against nothing; entries are (oid, path, blob)."""
    single = commits.where("parent1 is null or parent0 is null").select("oid", F.coalesce("parent0", "parent1").alias("parent"))
    new = single.join(entries.select("oid", "path", F.col("blob").alias("new")), "oid").select("oid", "path", "new")
    old = single.join(entries.select(F.col("oid").alias("parent"), "path", F.col("blob").alias("old")), "parent").select("oid", "path", "old")
    j = new.join(old, ["oid", "path"], "full_outer")
    kind = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "modify")
    return j.select("oid", "path", kind.alias("kind")).where("kind is not null")
