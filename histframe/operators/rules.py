"""Rows against ordered rules: path patterns, ignore files, attributes, sparse sets, configuration.

Rule lists are short and known on the driver, so a list becomes one nested CASE in
rule order that code generation runs per row; no join, no Python per row. Configuration
is a table and is read with grouped aggregates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histframe.functions.globs import Rule, glob_regex, ignore_rules, pathspec, ref_glob_regex


def _last(rules: list[Rule], path: Column, is_dir: Column, value) -> Column:
    """The value of the last rule that matches, or null."""
    out = F.lit(None)
    for r in rules:
        hit = path.rlike(r.regex) & (is_dir if r.dir_only else F.lit(True))
        out = F.when(hit, value(r)).otherwise(out)
    return out


def in_pathspec(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches takes the path; false without one."""
    return F.coalesce(_last(pathspec(patterns), path, F.lit(False), lambda r: F.lit(not r.negated)), F.lit(False))


def ignore_verdict(path: Column, levels: list[tuple[str, str, str]], is_dir: Column | None = None) -> Column:
    """struct(verdict, kind, basedir, line, pattern) by (kind, basedir, text) levels, the deepest last.

    Only the path itself is judged; an ignored parent doesn't count (see ``pruned``).
    Null where no rule matches.
    """
    is_dir = F.lit(False) if is_dir is None else is_dir
    out = F.lit(None)
    for kind, basedir, text in levels:
        inside = path.startswith(basedir + "/") if basedir else F.lit(True)
        own = F.substring(path, len(basedir) + 2, 1 << 20) if basedir else path
        found = _last(ignore_rules(text), own, is_dir, lambda r: F.struct(F.lit("unignored" if r.negated else "ignored").alias("verdict"), F.lit(kind).alias("kind"), F.lit(basedir).alias("basedir"), F.lit(r.line).cast("long").alias("line"), F.lit(r.pattern).alias("pattern")))  # noqa: B023
        out = F.coalesce(F.when(inside, found), out) if ignore_rules(text) else out
    return out


def is_ignored(path: Column, levels: list[tuple[str, str, str]], is_dir: Column | None = None) -> Column:
    return F.coalesce(ignore_verdict(path, levels, is_dir)["verdict"] == "ignored", F.lit(False))


def pruned(path: Column, levels: list[tuple[str, str, str]]) -> Column:
    """Whether a walk would never come to the path: it or a directory above it is ignored."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("p"), (i < F.size(parts)).alias("d")))
    return F.exists(above, lambda a: is_ignored(a["p"], levels, a["d"]))


# --- attributes -----------------------------------------------------------------------------------------------

Assigned = list[tuple[str, str | bool | None]]


def parse_attributes(text: str) -> tuple[list[tuple[Rule, Assigned]], dict[str, Assigned]]:
    """The rules of an attributes file and its macros. Values: true, false, text, or None for `!name`."""
    rules, macros = [], {}
    for number, raw in enumerate(text.split("\n"), 1):
        words = raw.split()
        if not words or words[0].startswith("#"):
            continue
        macro = re.fullmatch(r"\[attr\](\S+)", words[0])
        given: Assigned = []
        for w in words[1:]:
            if w[0] in "-!":
                given.append((w[1:], False if w[0] == "-" else None))
            else:
                name, eq, value = w.partition("=")
                given.append((name, value if eq else True))
        if macro:
            macros[macro[1]] = given
        else:
            body = words[0].removeprefix("/")
            rules.append((Rule(glob_regex(body, "/" in words[0]), line=number, pattern=words[0]), given))
    return rules, macros


def attribute(path: Column, name: str, sources: list[tuple[str, str]]) -> Column:
    """The value of an attribute by (basedir, text) sources, the most telling first: `set`, `unset`, a text, or `unspecified`.

    Within a source the last assignment counts, among sources the first that assigns.
    Macros stand for their parts where they are set; `binary` is built in.
    """
    macros: dict[str, Assigned] = {"binary": [("diff", False), ("merge", False), ("text", False)]}
    for _, text in reversed(sources):
        macros |= parse_attributes(text)[1]

    def flat(given: Assigned, inside: frozenset[str] = frozenset()) -> Assigned:
        out: Assigned = []
        for n, v in given:
            out.append((n, v))
            if v is True and n in macros and n not in inside:  # a macro that holds itself adds nothing
                out += flat(macros[n], inside | {n})
        return out

    found = []
    for basedir, text in sources:
        own = F.substring(path, len(basedir) + 2, 1 << 20) if basedir else path
        column = F.lit(None).cast("string")
        for rule, given in parse_attributes(text)[0]:
            values = [v for n, v in flat(given) if n == name]
            if values:
                v = {True: "set", False: "unset", None: "unspecified"}.get(values[-1], values[-1])
                column = F.when(own.rlike(rule.regex), v).otherwise(column)
        found.append(F.when(path.startswith(basedir + "/"), column) if basedir else column)
    return F.coalesce(*found, F.lit("unspecified"))


def marker_size(value: Column) -> Column:
    """The conflict marker's size: a whole number above 0, else 7."""
    n = F.when(value.rlike(r"^[0-9]{1,9}$"), value.cast("int"))
    return F.when(n > 0, n).otherwise(7)


# --- sparse sets ----------------------------------------------------------------------------------------------


def in_cone(path: Column, recursive: list[str]) -> Column:
    """In the cone: files right under the root or under a directory above a chosen one, and all below a chosen one."""
    parents = {"/".join(d.split("/")[:i]) for d in recursive for i in range(1, d.count("/") + 1)} - set(recursive)
    directory = F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    under = F.lit(False)
    for d in recursive:
        under |= path.startswith(d + "/")
    return (directory == "") | directory.isin(sorted(parents)) | under


def in_sparse(path: Column, text: str) -> Column:
    """By patterns in ignore syntax: a path is in if the last match takes it; directory rules take what is below."""
    out = F.lit(False)
    for r in ignore_rules(text):
        below = r.regex[:-1] + "(?:/[^\n]*)$" if r.dir_only else r.regex[:-1] + "(?:/[^\n]*)?$"
        out = F.when(path.rlike(below), not r.negated).otherwise(out)
    return out


# --- names ----------------------------------------------------------------------------------------------------


def _any(name: Column, patterns: list[str], compiled) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= name.rlike(compiled(p))
    return out


def name_filter(name: Column, include: list[str], exclude: list[str]) -> Column:
    """Short tag names: any include (all without one) and no exclude."""
    return (_any(name, include, glob_regex) if include else F.lit(True)) & ~_any(name, exclude, glob_regex)


def ref_filter(name: Column, refs: list[str], exclude: list[str], tags: bool = False) -> Column:
    """Full ref names that may name a commit: not HEAD, tags only if asked, any include and no exclude."""
    gate = (name != "HEAD") & (name.startswith("refs/tags/") if tags else F.lit(True))
    return gate & (_any(name, refs, ref_glob_regex) if refs else F.lit(True)) & ~_any(name, exclude, ref_glob_regex)


# --- configuration --------------------------------------------------------------------------------------------


def config_all(config: DataFrame) -> DataFrame:
    """(key, n, values): all values of each key, system before global before local before worktree."""
    rows = F.array_sort(F.collect_list(F.struct("scope_rank", "ord", "value")))
    return config.groupBy("key").agg(F.count("*").alias("n"), rows.alias("rows")).select("key", "n", F.transform("rows", lambda r: r["value"]).alias("values"))


def config_get(config: DataFrame) -> DataFrame:
    """(key, value) of the keys with one value; several anywhere make `error` true and value null."""
    return config.groupBy("key").agg(F.count("*").alias("n"), F.first("value").alias("v")).select("key", F.when(F.col("n") == 1, F.col("v")).alias("value"), (F.col("n") > 1).alias("error"))
