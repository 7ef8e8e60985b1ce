"""Remotes, worktrees, submodules and a new repository as edits of configuration rows (scope_rank, ord, key, value) and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histframe.functions.values import submodule_url

from .transitions import Refused, State, config_rename_section, config_set

LOCAL = 2
CONFIG = "scope_rank int, ord long, key string, value string"


def init(spark: SparkSession, branch: str = "main", bare: bool = False) -> tuple[State, DataFrame, DataFrame]:
    """An empty state, refs with HEAD on an unborn branch, and the first configuration."""
    empty = lambda schema: spark.createDataFrame([], schema)
    state = State(empty("path string, stage int, oid string, mode string"), empty("path string, oid string, mode string"), empty("name string, oid string"), empty("ref string, seq long, old_oid string, new_oid string, ts long, message string"))
    head = spark.createDataFrame([("HEAD", None, f"refs/heads/{branch}")], "name string, oid string, symbolic string")
    config = spark.createDataFrame([(LOCAL, 0, "core.repositoryformatversion", "0"), (LOCAL, 1, "core.bare", str(bare).lower())], CONFIG)
    return state, head, config


# --- remotes --------------------------------------------------------------------------------------------------


def remotes(config: DataFrame) -> DataFrame:
    """(name, urls, refspecs), in order of name."""
    p = r"^remote\.(.+)\.(url|fetch)$"
    rows = config.where(F.col("key").rlike(p)).select(F.regexp_extract("key", p, 1).alias("name"), F.regexp_extract("key", p, 2).alias("kind"), "ord", "value")
    values = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "value")))), lambda x: x["value"])
    return rows.groupBy("name").agg(values("url").alias("urls"), values("fetch").alias("refspecs")).orderBy("name")


def _has(config: DataFrame, name: str) -> bool:
    return not config.where(F.col("key").startswith(f"remote.{name}.")).isEmpty()


def remote_add(config: DataFrame, name: str, url: str) -> DataFrame:
    if _has(config, name):
        raise Refused(f"remote {name} exists")
    return config_set(config_set(config, LOCAL, f"remote.{name}.url", url), LOCAL, f"remote.{name}.fetch", f"+refs/heads/*:refs/remotes/{name}/*")


def remote_set_url(config: DataFrame, name: str, url: str) -> DataFrame:
    if not _has(config, name):
        raise Refused(f"no remote {name}")
    return config_set(config, LOCAL, f"remote.{name}.url", url)


def remote_remove(config: DataFrame, refs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Without the remote, what branches say of it, and its tracking refs."""
    if not _has(config, name):
        raise Refused(f"no remote {name}")
    branches = config.where((F.col("key").rlike(r"^branch\..+\.remote$")) & (F.col("value") == name)).select(F.regexp_replace("key", r"\.remote$", "").alias("branch"))
    section = F.regexp_extract("key", r"^(branch\..+)\.(remote|merge)$", 1)
    left = config.where(~F.col("key").startswith(f"remote.{name}.")).withColumn("_s", section).join(F.broadcast(branches), F.col("_s") == F.col("branch"), "left_anti").drop("_s")
    return left, refs.where(~F.col("name").startswith(f"refs/remotes/{name}/"))


def remote_rename(config: DataFrame, refs: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The remote, its tracking refs, its refspecs and what branches say of it under another name."""
    if not _has(config, old) or _has(config, new):
        raise Refused(f"can't rename {old} to {new}")
    out = config_rename_section(config, LOCAL, f"remote.{old}", f"remote.{new}")
    tracked = F.regexp_replace("value", f":refs/remotes/{old}/", f":refs/remotes/{new}/")
    value = F.when(F.col("key") == f"remote.{new}.fetch", tracked).when(F.col("key").rlike(r"^branch\..+\.(remote|pushremote)$") & (F.col("value") == old), F.lit(new)).otherwise(F.col("value"))
    moved = F.when(F.col("name").startswith(f"refs/remotes/{old}/"), F.concat(F.lit(f"refs/remotes/{new}/"), F.substring("name", len(f"refs/remotes/{old}/") + 1, 1 << 20))).otherwise(F.col("name"))
    return out.withColumn("value", value), refs.withColumn("name", moved)


# --- worktrees (id, path, ref, locked) ------------------------------------------------------------------------


def admin_ids(asked: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, id) of asked (name): the name if no worktree (id) has it, else with the least number behind it that is free.

    Among a name and n taken ids at most n candidates are taken, so the least free one
    is the first gap in their numbers.
    """
    t = taken.select("id").distinct()
    used = asked.select("name").distinct().join(t, F.col("id").startswith(F.col("name"))).select("name", F.expr("substring(id, length(name) + 1)").alias("tail"))
    used = used.where("tail = '' or tail rlike '^[1-9][0-9]{0,17}$'").select("name", F.when(F.col("tail") == "", 0).otherwise(F.col("tail").cast("long")).alias("k"))
    # numbers 0, 1, ... without a gap stand at their own place in the order
    place = F.row_number().over(Window.partitionBy("name").orderBy("k")) - 1
    run = used.withColumn("_at", place).where("k = _at").groupBy("name").agg(F.count("*").alias("n"))
    return asked.select("name").join(run, "name", "left").select("name", F.when(F.col("n").isNull(), F.col("name")).otherwise(F.concat("name", F.col("n").cast("string"))).alias("id"))


def worktree_add(worktrees: DataFrame, path: str, ref: str) -> DataFrame:
    """One more, unless its path or its branch is taken."""
    if not worktrees.where((F.col("path") == path) | (F.col("ref") == ref)).isEmpty():
        raise Refused(f"{path} or {ref} is in use")
    spark = worktrees.sparkSession
    name = path.rstrip("/").rsplit("/", 1)[-1]
    own = admin_ids(spark.createDataFrame([(name,)], "name string"), worktrees).first().id
    return worktrees.unionByName(spark.createDataFrame([(own, path, ref, False)], worktrees.select("id", "path", "ref", "locked").schema))


def _one(worktrees: DataFrame, path: str) -> None:
    row = worktrees.where(F.col("path") == path).limit(1).collect()
    if not row or row[0].locked:
        raise Refused(f"no unlocked worktree at {path}")


def worktree_move(worktrees: DataFrame, path: str, to: str) -> DataFrame:
    _one(worktrees, path)
    if not worktrees.where(F.col("path") == to).isEmpty():
        raise Refused(f"{to} is in use")
    return worktrees.withColumn("path", F.when(F.col("path") == path, to).otherwise(F.col("path")))


def worktree_remove(worktrees: DataFrame, path: str) -> DataFrame:
    _one(worktrees, path)
    return worktrees.where(F.col("path") != path)


# --- submodules: modules are rows (name, path, url) -----------------------------------------------------------


def _rows(config: DataFrame, found: DataFrame) -> DataFrame:
    order = config.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
    rows = found.select(F.lit(LOCAL).alias("scope_rank"), F.lit(order).cast("long").alias("ord"), "key", "value")
    gone = rows.select("scope_rank", "key")
    return config.join(gone, ["scope_rank", "key"], "left_anti").select("scope_rank", "ord", "key", "value").unionByName(rows)


def submodule_init(config: DataFrame, modules: DataFrame, base: str) -> DataFrame:
    """The URLs of modules that have none yet, resolved from the base, and that they are active."""
    key = F.concat(F.lit("submodule."), "name", F.lit(".url"))
    fresh = modules.select("name", key.alias("key"), submodule_url(F.lit(base), F.col("url")).alias("value")).join(config.select("key"), "key", "left_anti")
    active = fresh.select(F.concat(F.lit("submodule."), "name", F.lit(".active")).alias("key"), F.lit("true").alias("value"))
    return _rows(config, fresh.select("key", "value").unionByName(active))


def submodule_sync(config: DataFrame, modules: DataFrame, base: str) -> DataFrame:
    """The URLs of modules that have one, as they are now."""
    key = F.concat(F.lit("submodule."), "name", F.lit(".url"))
    known = modules.select(key.alias("key"), submodule_url(F.lit(base), F.col("url")).alias("value")).join(config.select("key"), "key", "left_semi")
    return _rows(config, known)


def submodule_deinit(config: DataFrame, name: str) -> DataFrame:
    return config.where(~F.col("key").startswith(f"submodule.{name}."))


def submodule_add(index: DataFrame, modules: DataFrame, path: str, url: str, oid: str) -> tuple[DataFrame, DataFrame]:
    """A module link in the index and its row; refuses a path that is taken."""
    if not index.where(F.col("path") == path).isEmpty():
        raise Refused(f"{path} is in the index")
    spark = index.sparkSession
    entry = spark.createDataFrame([(path, 0, oid, "160000")], index.select("path", "stage", "oid", "mode").schema)
    row = spark.createDataFrame([(path, path, url)], modules.select("name", "path", "url").schema)
    return index.unionByName(entry), modules.unionByName(row)


def submodule_update(index: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, have, want) of module links whose checked-out commit (path, oid) isn't the index's; have is null where none is checked out."""
    want = index.where("mode = '160000' and stage = 0").select("path", F.col("oid").alias("want"))
    return want.join(heads.select("path", F.col("oid").alias("have")), "path", "left").where(~F.col("have").eqNullSafe(F.col("want"))).select("path", "have", "want")
