"""Checks of objects and refs: faults of trees, commits and tags, roots of reachability, severities.

Trees are checked as entry rows by windows over each tree, commits and tags as texts by
column expressions; a fault is a row (oid, msg_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histframe.functions.scalar import is_oid

# The severities of fault ids where they aren't "error".
INFO = "badFilemode gitattributesSymlink gitignoreSymlink mailmapSymlink badTagName missingTaggerEntry gitmodulesParse".split()
WARNING = "emptyName fullPathname hasDot hasDotdot hasDotgit largePathname nullSha1 zeroPaddedFilemode nulInCommit".split()
SPECIAL = (".gitmodules", ".gitattributes")
ZERO = "0" * 40
#: The longest name, in bytes, and the largest time.
LONGEST, LATEST = 4096, str(2**63 - 1)


def severity(msg_id: Column, strict: bool = False) -> Column:
    """error, warning or info; strict makes errors of warnings."""
    return F.when(msg_id.isin(*INFO), "info").when(msg_id.isin(*WARNING), "error" if strict else "warning").otherwise("error")


def _faults(rows: DataFrame, tests: dict[str, Column], *keep: str) -> DataFrame:
    """(keep, msg_id): a row for each test that holds."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items())))
    return rows.select(*keep, F.explode(found).alias("msg_id"))


def tree_faults(entries: DataFrame) -> DataFrame:
    """(tree_oid, pos, msg_id) of entries (tree_oid, pos, name, mode, oid).

    Order is that of bytes, a directory's name ending in a slash. A name counts as
    repeated from its second entry on.
    """
    of, name, mode = Window.partitionBy("tree_oid").orderBy("pos"), F.col("name"), F.col("mode")
    key = F.hex(F.encode(F.when(mode.isin("40000", "040000"), F.concat(name, F.lit("/"))).otherwise(name), "UTF-8"))
    rows = entries.withColumn("_key", key).withColumns({"_before": F.lag("_key").over(of), "_nth": F.row_number().over(Window.partitionBy("tree_oid", "name").orderBy("pos"))})
    link, regular = mode == "120000", mode.isin("100644", "100755")
    tests = {
        "zeroPaddedFilemode": mode.startswith("0"), "badFilemode": ~F.regexp_replace(mode, "^0", "").isin("100644", "100755", "120000", "40000", "160000"), "nullSha1": F.col("oid") == ZERO,
        "emptyName": name == "", "hasDot": name == ".", "hasDotdot": name == "..", "hasDotgit": name == ".git", "fullPathname": name.contains("/"), "largePathname": F.octet_length(name) > LONGEST,
        "duplicateEntries": F.col("_nth") > 1, "treeNotSorted": F.col("_before") > F.col("_key"),
        "gitmodulesSymlink": (name == ".gitmodules") & link, "gitmodulesBlob": (name == ".gitmodules") & ~link & ~regular,
        "gitattributesSymlink": (name == ".gitattributes") & link, "gitattributesBlob": (name == ".gitattributes") & ~link & ~regular,
        "gitignoreSymlink": (name == ".gitignore") & link, "mailmapSymlink": (name == ".mailmap") & link,
    }
    return _faults(rows, tests, "tree_oid", "pos")


def _later(time: Column) -> Column:
    """Whether a number in digits is above the largest time."""
    n = F.length(time)
    return (n > len(LATEST)) | (n == len(LATEST)) & (time > LATEST)


def _identity_faults(line: Column) -> Column:
    """The faults of an identity, as an array: what stands behind a first serious one isn't looked at."""
    left = F.instr(line, "<")
    name = F.substring(line, F.lit(1), left - 1)
    closed = F.locate(">", F.substring(line, left, F.length(line))) > 0
    after = F.regexp_replace(line, "^[^<]*<[^>]*>", "")
    words = F.split(F.trim(after), r"\s+")
    time, zone = words[0], F.try_element_at(words, F.lit(2))
    good_zone = zone.rlike(r"^[+-]([01]\d|2[0-3])[0-5]\d$")
    one = lambda x: F.array(F.lit(x))
    none = F.array().cast("array<string>")
    date = (
        F.when(~after.startswith(" "), one("missingSpaceBeforeDate")).when(time.startswith("0") & (F.length(time) > 1), one("zeroPaddedDate"))
        .when(~time.rlike(r"^\d+$"), one("badDate")).when(_later(time), one("badDateOverflow")).when(zone.isNotNull() & ~good_zone, one("badTimezone")).otherwise(none)
    )
    names = F.concat(F.when(~name.endswith(" "), one("missingSpaceBeforeEmail")).otherwise(none), F.when(F.rtrim(name) == "", one("missingNameBeforeEmail")).otherwise(none))
    return F.when(left == 0, one("missingEmail")).otherwise(F.concat(names, F.when(closed, date).otherwise(one("missingEmail"))))


def commit_faults(commits: DataFrame) -> DataFrame:
    """(oid, msg_id) of commits (oid, text), text being what follows the object's header.

    A zero byte in the headers, or no tree, hides whatever else is wrong; without an
    author nothing is said of the committer.
    """
    text = F.col("text")
    head = F.substring_index(text, "\n\n", 1)
    body = F.when(F.instr(text, "\n\n") > 0, F.expr("substring(text, instr(text, '\n\n') + 2)")).otherwise("")
    lines = F.split(head, "\n")
    rows = commits.withColumn("_head", head)
    # the run of parent lines behind the tree, and what follows it
    rest = F.regexp_replace("_head", r"^[^\n]*\n?", "")
    run = F.regexp_extract(F.concat(rest, F.lit("\n")), r"^((?:parent [^\n]*\n)*)", 1)
    after = F.substring(rest, F.length(run) + 1, F.length(rest))
    oids = F.filter(F.split(run, "\n"), lambda x: x != "")
    first = F.substring_index(after, "\n", 1)
    tail = F.regexp_replace(after, r"^[^\n]*\n?", "")
    again = F.regexp_extract(F.concat(tail, F.lit("\n")), r"^((?:author [^\n]*\n)*)", 1)
    committers = F.filter(F.split(F.substring(tail, F.length(again) + 1, F.length(tail)), "\n"), lambda x: x.startswith("committer "))
    one, none = lambda x: F.array(F.lit(x)), F.array().cast("array<string>")
    bad_parents = F.transform(F.filter(oids, lambda x: ~is_oid(F.substring(x, 8, 1000))), lambda x: F.lit("badParentSha1"))
    committer = F.when(F.size(committers) == 0, one("missingCommitter")).otherwise(_identity_faults(F.substring(F.try_element_at(committers, F.lit(1)), 11, 1 << 20)))
    people = F.when(~first.startswith("author "), one("missingAuthor")).otherwise(F.concat(_identity_faults(F.substring(first, 8, 1 << 20)), F.array_repeat(F.lit("multipleAuthors"), F.size(F.filter(F.split(again, "\n"), lambda x: x != ""))), committer))
    zero = F.lit("\0")
    found = (
        F.when(F.contains("_head", zero), one("nulInHeader")).when(~F.col("_head").startswith("tree "), one("missingTree"))
        .otherwise(F.concat(F.when(is_oid(F.substring(lines[0], 6, 1000)), none).otherwise(one("badTreeSha1")), bad_parents, people, F.when(F.contains(body, zero), one("nulInCommit")).otherwise(none)))
    )
    return rows.select("oid", F.explode(found).alias("msg_id"))


def tag_faults(tags: DataFrame) -> DataFrame:
    """(oid, msg_id) of tags (oid, text): the object, type, tag and tagger lines in that order; a missing one hides what follows."""
    lines = F.split("text", "\n")
    line = lambda i: F.coalesce(F.try_element_at(lines, F.lit(i)), F.lit(""))
    one, none = lambda x: F.array(F.lit(x)), F.array().cast("array<string>")
    who = F.substring(line(4), 8, 1 << 20)
    name = F.substring_index(who, "<", 1)
    after = F.regexp_replace(who, "^[^<]*<[^>]*>", "")
    time = F.split(F.trim(after), r"\s+")[0]
    tagger = (
        F.when(~line(4).startswith("tagger "), one("missingTaggerEntry")).when(F.instr(who, "<") == 0, none).when(~name.endswith(" "), one("missingSpaceBeforeEmail"))
        .when(~who.rlike("<[^>]*> ") | ~time.rlike(r"^\d+$"), none).when(_later(time), one("badDateOverflow")).otherwise(none)
    )
    named = F.when(~line(3).startswith("tag "), one("missingTag")).when(line(3) == "tag ", one("missingTagEntry")).otherwise(F.concat(F.when(F.contains(line(3), F.lit("\0")), one("badTagName")).otherwise(none), tagger))
    typed = F.when(~line(2).startswith("type "), one("missingType")).when(~F.substring(line(2), 6, 100).isin("blob", "tree", "commit", "tag"), one("missingTypeEntry")).otherwise(named)
    found = F.when(~line(1).startswith("object "), one("missingObject")).otherwise(F.concat(F.when(is_oid(F.substring(line(1), 8, 1000)), none).otherwise(one("badObjectSha1")), typed))
    return tags.select("oid", F.explode(found).alias("msg_id"))


def special_blobs(entries: DataFrame) -> DataFrame:
    """(oid, name) of blobs that some tree holds under a special name; of several names the greatest."""
    return entries.where(F.col("name").isin(*SPECIAL)).groupBy("oid").agg(F.max("name").alias("name"))


def roots(refs: DataFrame, reflog: DataFrame, index: DataFrame) -> DataFrame:
    """(oid) that reachability starts from: where refs stand, both sides of every log entry, and what is staged; nulls and zeros aside."""
    log = reflog.select(F.explode(F.array("old_oid", "new_oid")).alias("oid"))
    return refs.select("oid").unionByName(log).unionByName(index.select("oid")).where(F.col("oid").isNotNull() & (F.col("oid") != ZERO)).distinct()


def ref_faults(refs: DataFrame, objects: DataFrame, content: bool = True) -> DataFrame:
    """(ref, msg_id, target) of refs (name, content): what is neither an id nor "ref: ...", and ids that no object has.

    Malformed content is a fault of its own where `content` is asked for, and in any
    case counts as a missing object, under the id of zeros.
    """
    text = F.regexp_replace("content", r"\s+$", "")
    rows = refs.select(F.col("name").alias("ref"), text.alias("t")).where(~F.col("t").startswith("ref: "))
    bad = rows.where(~is_oid(F.col("t"))).select("ref", F.explode(F.array(*(F.lit(x) for x in (["badRefContent"] if content else []) + ["badRefOid"]))).alias("msg_id"))
    bad = bad.select("ref", "msg_id", F.when(F.col("msg_id") == "badRefOid", ZERO).alias("target"))
    gone = rows.where(is_oid(F.col("t"))).join(objects.select(F.col("oid").alias("t")), "t", "left_anti").select("ref", F.lit("badRefOid").alias("msg_id"), F.col("t").alias("target"))
    return bad.unionByName(gone)
