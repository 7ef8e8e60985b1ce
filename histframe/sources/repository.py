"""A repository folder as its tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histframe.functions.scalar import blob_oid

from . import packs, store


@dataclass(frozen=True)
class Repository:
    """Tables of a repository, read when they are asked for."""

    spark: SparkSession
    git_dir: str

    @cached_property
    def objects(self) -> DataFrame:
        return store.objects(self.spark, self.git_dir)

    @cached_property
    def commits(self) -> DataFrame:
        return store.commits(self.objects)

    @cached_property
    def trees(self) -> DataFrame:
        return store.tree_entries(self.objects)

    @cached_property
    def refs(self) -> DataFrame:
        return store.refs(self.spark, self.git_dir)

    @cached_property
    def reflogs(self) -> DataFrame:
        return store.reflogs(self.spark, self.git_dir)

    @cached_property
    def index(self) -> DataFrame:
        return store.index(self.spark, self.git_dir)

    @cached_property
    def pack_entries(self) -> DataFrame:
        return packs.pack_entries(self.spark, self.git_dir)

    def tags(self) -> DataFrame:
        """(oid, object, type, name) of annotated tags."""
        text = self.objects.where("type = 'tag'").select("oid", F.decode("content", "UTF-8").alias("t"))
        field = lambda n: F.regexp_extract("t", rf"(?m)^{n} (.*)$", 1)
        return text.select("oid", field("object").alias("object"), field("type").alias("type"), field("tag").alias("name"))

    def read(self, oid: str) -> tuple[str, bytes]:
        """An object's type and content; LookupError without one."""
        found = self.objects.where(F.col("oid") == oid).limit(1).collect()
        if not found:
            raise LookupError(f"no object {oid}")
        return found[0].type, bytes(found[0].content)

    def snapshot(self, kind: str, rev: str | None = None, root: str | None = None) -> DataFrame:
        """(path, oid, mode) of a state: "tree" of a commit or of HEAD, "index" (with stage), "workdir" under a folder, or the "stash" entry of a commit, whose tree it is."""
        if kind == "index":
            return self.index.select("path", "stage", "oid", "mode")
        if kind == "workdir":
            return workdir(self.spark, root or self.git_dir.removesuffix("/.git")).select("path", "oid", "mode")
        if kind not in ("tree", "stash"):
            raise ValueError(f"no snapshot of {kind!r}")
        if rev is None:
            return self.head_tree().select("path", "oid", "mode")
        commit = self.commits.where(F.col("oid") == rev).limit(1).collect()
        if not commit:
            raise LookupError(f"no commit {rev}")
        return store.flat_tree(self.trees, commit[0].tree).select("path", "oid", "mode")

    def status(self, root: str | None = None) -> DataFrame:
        """The working copy's status by contents."""
        from histframe.operators.snapshot import status

        return status(self.snapshot("tree"), self.snapshot("index"), self.snapshot("workdir", root=root))

    def head_tree(self) -> DataFrame:
        """(path, mode, oid) of the tree that HEAD's commit has."""
        refs = self.refs
        head = refs.where("name = 'HEAD'").limit(1).collect()
        if not head:
            raise LookupError("no HEAD")
        oid = head[0].oid
        if oid is None:
            found = refs.where(F.col("name") == head[0].symbolic).limit(1).collect()
            if not found:
                return self.trees.limit(0).select(F.col("name").alias("path"), "mode", "oid")
            oid = found[0].oid
        return store.flat_tree(self.trees, self.commits.where(F.col("oid") == oid).first().tree)


def open_repository(spark: SparkSession, path: str) -> Repository:
    """The repository in a folder, or in its .git folder; LookupError if neither has a HEAD."""
    for git_dir in (f"{path.rstrip('/')}/.git", path.rstrip("/")):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{git_dir}/HEAD")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return Repository(spark, git_dir)
    raise LookupError(f"no repository at {path}")


def workdir(spark: SparkSession, root: str) -> DataFrame:
    """(path, mode, oid, size, mtime_ms, content) of the files under a folder, without .git; Spark's reader knows no execute bit, so the mode is that of a plain file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "")
    base = root.rstrip("/") + "/"
    rows = files.select(path.alias("p"), "content", "length", "modificationTime")
    rows = rows.select(F.substring("p", len(base) + 1, 1 << 20).alias("path"), F.lit("100644").alias("mode"), blob_oid(F.col("content")).alias("oid"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    return rows.where(~F.col("path").rlike(r"^\.git/"))


def linked_worktrees(spark: SparkSession, git_dir: str) -> DataFrame:
    """(path, ref, is_main) of the worktrees that a repository's admin folders name, the main one among them, in order."""
    from histframe.operators.reading import worktrees

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(git_dir)
    text = files.where(~F.col("path").rlike("/logs/")).select(F.regexp_extract("path", r"/(HEAD|worktrees/[^/]+/(?:HEAD|gitdir))$", 1).alias("f"), F.trim(F.regexp_replace(F.decode("content", "UTF-8"), r"\n$", "")).alias("t")).where(F.col("f") != "")
    ref = F.regexp_replace("t", "^ref: ", "")
    main = text.where("f = 'HEAD'").select(F.lit(git_dir.rstrip("/").removesuffix("/.git")).alias("path"), ref.alias("ref"), F.lit(True).alias("is_main"))
    own = F.regexp_extract("f", r"^worktrees/([^/]+)/", 1)
    heads = text.where("f like 'worktrees/%/HEAD'").select(own.alias("id"), ref.alias("ref"))
    places = text.where("f like 'worktrees/%/gitdir'").select(own.alias("id"), F.regexp_replace("t", r"/\.git$", "").alias("path"))
    return worktrees(main.unionByName(places.join(heads, "id").select("path", "ref", F.lit(False).alias("is_main"))))
