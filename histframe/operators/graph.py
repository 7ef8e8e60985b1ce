"""Commit graph: closures, walks, merge bases, nearest tags, names, bisection, integrity.

``closure`` is the one loop: a frontier joined to edges, a few levels at a time. Seeds
travel along as a column, so many starts are followed at once. After these levels the
rows are written to the shared folder, which keeps plans short and survives lost
executors. ``ancestor_counts`` follows runs of single parents by pointer doubling, so
that only merges need a closure of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histframe.scratch import written

DAY = 86_400
#: Levels that one job of a closure goes down.
STEPS = 8


def closure(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None, first_parent: bool = False, levels: int | None = None) -> DataFrame:
    """(seed, oid, depth) reachable from (seed, oid) along (child, parent, idx); depth is the least number of steps.

    stop: ids that are neither given nor passed; what is also reached around them is
    given. The loop ends with the frontier; only its emptiness comes to the driver.
    """
    e = edges.where("idx = 0") if first_parent else edges
    e = e.select("child", "parent")
    if stop is not None:
        cut = stop.select(F.col("oid").alias("_stop")).distinct()
        seeds = seeds.join(cut, seeds["oid"] == cut["_stop"], "left_anti")
        e = e.join(cut, e["parent"] == cut["_stop"], "left_anti")
    e = written(e, "edges")
    frontier = seen = written(seeds.select("seed", "oid", F.lit(0).alias("depth")).distinct(), "frontier")
    depth = 0
    while levels is None or depth < levels:
        steps = STEPS if levels is None else min(STEPS, levels - depth)
        at, found = frontier.select("seed", "oid"), []
        for k in range(1, steps + 1):
            at = at.join(e, at["oid"] == e["child"]).select("seed", F.col("parent").alias("oid")).distinct()
            found.append(at.withColumn("depth", F.lit(depth + k)))
        new = reduce(DataFrame.unionByName, found).groupBy("seed", "oid").agg(F.min("depth").alias("depth"))
        new = written(new.join(seen.select("seed", "oid"), ["seed", "oid"], "left_anti"), "frontier")
        depth += steps
        seen = seen.unionByName(new)
        frontier = new.where(F.col("depth") == depth)
        if frontier.isEmpty():
            break
        if depth % (8 * STEPS) == 0:
            seen = written(seen, "seen")
    return seen


def seeded(df: DataFrame, oid: str = "oid", seed: Column | None = None) -> DataFrame:
    return df.select((F.col(oid) if seed is None else seed).alias("seed"), F.col(oid).alias("oid"))


def reachable(edges: DataFrame, tips: DataFrame, **options) -> DataFrame:
    """(oid, depth) reachable from any of the tips."""
    return closure(edges, seeded(tips, seed=F.lit(0)), **options).select("oid", "depth")


def log(commits: DataFrame, edges: DataFrame, tips: DataFrame, excluding: DataFrame | None = None, before: int | None = None, parents: tuple[int, int] | None = None, limit: int | None = None, **options) -> DataFrame:
    """(oid, author, ts, subject): newest first, ties by id; `limit` counts what the filters leave."""
    rows = commits.join(reachable(edges, tips, stop=excluding, **options), "oid")
    if before is not None:
        rows = rows.where(F.col("ts") < before)
    if parents is not None:
        n = F.col("parent0").isNotNull().cast("int") + F.col("parent1").isNotNull().cast("int")
        rows = rows.where(n.between(*parents))
    rows = rows.select("oid", "author", "ts", "subject")
    return rows.orderBy(F.desc("ts"), "oid").limit(limit) if limit is not None else rows


def rev_list(edges: DataFrame, wants: DataFrame, nots: DataFrame) -> DataFrame:
    """(oid) reachable from the wants and not from the others, whose whole ancestry goes. Both sides share one closure."""
    sides = seeded(wants, seed=F.lit(0)).unionByName(seeded(nots, seed=F.lit(1)))
    return closure(edges, sides).groupBy("oid").agg(F.max("seed").alias("side")).where("side = 0").select("oid")


def boundary(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(oid): parents of the set's members that aren't members: what a bundle of the set requires."""
    p = edges.join(inside.select(F.col("oid").alias("child")), "child").select(F.col("parent").alias("oid")).distinct()
    return p.join(inside.select("oid"), "oid", "left_anti")


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, oid): all best common ancestors of each (pair, a, b).

    The common ancestors of two commits are closed downward, so the best ones are those
    that aren't a parent of another.
    """
    side = lambda s: pairs.select(F.struct("pair", F.lit(s).alias("side")).alias("seed"), F.col(s).alias("oid"))
    both = closure(edges, side("a").unionByName(side("b"))).groupBy(F.col("seed.pair").alias("pair"), "oid").agg(F.count("*").alias("sides"))
    common = written(both.where("sides = 2").select("pair", "oid"), "common")
    below = common.join(edges, common["oid"] == edges["child"]).select("pair", F.col("parent").alias("oid")).distinct()
    return common.join(below, ["pair", "oid"], "left_anti")


def merge_base(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, oid): the least id among the best common ancestors."""
    return merge_bases(edges, pairs).groupBy("pair").agg(F.min("oid").alias("oid"))


def octopus_merge_bases(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, oid): all best common ancestors of all commits of each group (grp, oid)."""
    sizes = groups.distinct().groupBy("grp").agg(F.count("*").alias("all"))
    seeds = groups.select(F.struct("grp", F.col("oid").alias("tip")).alias("seed"), "oid")
    reached = closure(edges, seeds).groupBy(F.col("seed.grp").alias("grp"), "oid").agg(F.count("*").alias("n"))
    common = written(reached.join(sizes, "grp").where("n = all").select("grp", "oid"), "common")
    below = common.join(edges, common["oid"] == edges["child"]).select("grp", F.col("parent").alias("oid")).distinct()
    return common.join(below, ["grp", "oid"], "left_anti")


def independent(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(oid): the commits that no other of them reaches, which are those that no parent of one of them reaches."""
    above = edges.join(commits.select(F.col("oid").alias("child")), "child").select(F.col("parent").alias("oid")).distinct()
    return commits.select("oid").distinct().join(reachable(edges, above).select("oid"), "oid", "left_anti")


def ancestor_counts(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(oid, n): how many commits each of them reaches, itself among them.

    A commit with one parent reaches one more than its parent, so each is led up its run
    of single parents, by leaps that double each round, to a root or a merge; only these
    are followed by a closure.
    """
    single = edges.groupBy("child").agg(F.min("parent").alias("parent"), F.countDistinct("parent").alias("k")).where("k = 1").select(F.col("child").alias("oid"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps"))
    leap = written(single, "runs")
    while True:
        on = leap.select(F.col("oid").alias("to"), F.col("to").alias("on"), F.col("steps").alias("more"))
        if leap.join(on, "to", "left_semi").isEmpty():
            break
        leap = written(leap.join(on, "to", "left").select("oid", F.coalesce("on", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "runs")
    ends = written(commits.select("oid").distinct().join(leap, "oid", "left").select("oid", F.coalesce("to", "oid").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps")), "ends")
    heads = ends.select(F.col("to").alias("oid")).distinct()
    own = closure(edges, seeded(heads)).groupBy(F.col("seed").alias("to")).agg(F.count("*").alias("own"))
    return ends.join(own, "to").select("oid", (F.col("own") + F.col("steps")).alias("n"))


def described(edges: DataFrame, commits: DataFrame, tags: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, tag, distance, exact) by the nearest tag: the least number of commits that the target has and the tag hasn't.

    Annotated tags only, as by default. Ties go to the newer commit, then to the name.
    """
    t = tags.where("annotated").groupBy("oid").agg(F.min_by("name", F.struct(-F.col("tagger_ts"), F.col("name"))).alias("tag"))
    # of the target's ancestors only the tagged ones matter
    found = written(closure(edges, targets.select(F.col("oid").alias("seed"), "oid")).join(t, "oid").select("seed", "oid", "tag"), "tagged")
    own = written(ancestor_counts(edges, found.select("oid").unionByName(targets.select("oid"))), "counts")
    size = own.select(F.col("oid").alias("seed"), F.col("n").alias("all"))
    own = own.select("oid", F.col("n").alias("own"))
    # all that a tag reaches is reached by the target too, so the difference counts the rest
    d = found.join(own, "oid").join(size, "seed").join(commits.select("oid", "ts"), "oid").withColumn("distance", F.col("all") - F.col("own"))
    best = d.groupBy("seed").agg(F.min_by(F.struct("tag", "distance"), F.struct("distance", -F.col("ts"), "tag")).alias("b"))
    return targets.select(F.col("oid").alias("target")).join(best, F.col("target") == F.col("seed"), "left").select("target", "b.tag", "b.distance", F.coalesce(F.col("b.distance") == 0, F.lit(False)).alias("exact"))


MERGE_HOP = 65_535


def _leaps(edges: DataFrame) -> DataFrame:
    """The edges with steps, and along first parents also leaps of 2, 4, 8 ... steps."""
    leap = written(edges.where("idx = 0").select("child", "parent", F.lit(1).cast("long").alias("steps")), "leaps")
    out = edges.select("child", "parent", "idx", F.lit(1).cast("long").alias("steps"))
    while not leap.isEmpty():
        on = leap.select(F.col("child").alias("parent"), F.col("parent").alias("on"))
        leap = written(leap.join(on, "parent").select("child", F.col("on").alias("parent"), (F.col("steps") * 2).alias("steps")), "leaps")
        out = out.unionByName(leap.withColumn("idx", F.lit(0)))
    return written(out, "leaps")


def named(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(oid, name): the best path from a ref: a tag before others, then the nearest, where a second parent costs 65,535 steps.

    A relaxation over all commits at once: each round offers every commit the names of
    its children and keeps the least by (not a tag, distance, tagger's time, ref, path),
    until none changes. Names also leap along first parents, so a chain of n commits
    takes about log n rounds.
    """
    rank = lambda: F.struct("other", "distance", "tagger", "ref", "path")
    start = refs.select("oid", (~F.col("name").startswith("refs/tags/")).cast("int").alias("other"), F.lit(0).cast("long").alias("distance"), F.coalesce("tagger_ts", F.lit(1 << 62)).alias("tagger"), F.regexp_replace("name", "^refs/(heads/)?", "").alias("ref"), F.lit("").alias("path"), F.lit(0).cast("long").alias("tail"))
    best = written(start.groupBy("oid").agg(F.min(F.struct("other", "distance", "tagger", "ref", "path", "tail")).alias("n")).select("oid", "n.*"), "names")
    changed = best
    shown = lambda path, tail: F.when(tail > 0, F.concat(path, F.lit("~"), tail.cast("string"))).otherwise(path)
    edges = _leaps(edges)
    while not changed.isEmpty():
        step = changed.join(edges, changed["oid"] == edges["child"])
        first = F.col("idx") == 0
        offered = step.select(
            F.col("parent").alias("oid"), "other", (F.col("distance") + F.when(first, F.col("steps")).otherwise(MERGE_HOP)).alias("distance"), "tagger", "ref",
            F.when(first, F.col("path")).otherwise(F.concat(shown(F.col("path"), F.col("tail")), F.lit("^"), (F.col("idx") + 1).cast("string"))).alias("path"),
            F.when(first, F.col("tail") + F.col("steps")).otherwise(0).alias("tail"),
        )
        both = best.withColumn("old", F.lit(1)).unionByName(offered.withColumn("old", F.lit(0)))
        kept = both.groupBy("oid").agg(F.min_by(F.struct("other", "distance", "tagger", "ref", "path", "tail", "old"), F.struct("other", "distance", "tagger", "ref", "path", "tail", -F.col("old"))).alias("n")).select("oid", "n.*")
        kept = written(kept, "names")
        changed, best = kept.where("old = 0").drop("old"), kept.drop("old")
    return best.select("oid", F.concat("ref", shown(F.col("path"), F.col("tail"))).alias("name"), "distance")


def bisect_weights(edges: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """(oid, weight, n): the candidates that bad reaches and good doesn't, how many candidates each reaches, and how many there are."""
    c = written(rev_list(edges, bad, good), "candidates")
    inner = edges.join(c.select(F.col("oid").alias("child")), "child").join(c.select(F.col("oid").alias("parent")), "parent")
    w = ancestor_counts(inner, c).withColumnRenamed("n", "weight")
    return w.crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))  # one row


def bisect(edges: DataFrame, commits: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """(oid, weight, n) of the next commit to test: the one that splits the candidates best, ties to the newest."""
    w = bisect_weights(edges, good, bad).join(commits.select("oid", "ts"), "oid")
    return w.orderBy(F.desc(F.least(F.col("weight"), F.col("n") - F.col("weight"))), F.desc("ts"), "oid").limit(1).select("oid", "weight", "n")


def fsck(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, oid): missing, unreachable and dangling objects, and broken links, over (oid), (child, parent), (oid)."""
    reached = written(closure(edges.withColumn("idx", F.lit(0)), seeded(roots, seed=F.lit(0))).select("oid"), "reached")
    known = objects.select("oid")
    missing = reached.join(known, "oid", "left_anti").select(F.lit("missing").alias("kind"), "oid")
    unreachable = written(known.join(reached, "oid", "left_anti"), "unreachable")
    pointed = edges.select(F.col("parent").alias("oid")).distinct()
    dangling = unreachable.join(pointed, "oid", "left_anti").select(F.lit("dangling").alias("kind"), "oid")
    broken = edges.join(known.select(F.col("oid").alias("child")), "child").join(known.select(F.col("oid").alias("parent")), "parent", "left_anti").select(F.lit("broken-link").alias("kind"), F.col("child").alias("oid")).distinct()
    return missing.unionByName(unreachable.select(F.lit("unreachable").alias("kind"), "oid")).unionByName(dangling).unionByName(broken)


def grafted(edges: DataFrame, shallow: DataFrame) -> DataFrame:
    """The edges without those of shallow commits, which count as roots."""
    return edges.join(shallow.select(F.col("oid").alias("child")), "child", "left_anti")


def first_parents(edges: DataFrame, tips: DataFrame, **options) -> DataFrame:
    return reachable(edges, tips, first_parent=True, **options)
