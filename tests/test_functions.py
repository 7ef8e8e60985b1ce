"""Patterns, line differences, merges and decoders against brute force and known values."""

from __future__ import annotations

import itertools
import os
import random
import re
import shutil
import subprocess
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from histframe.functions import globs, linediff, scalar
from histframe.operators import revisions, rules
from histframe.sources import store


def slow_glob(pattern: str, path: str, anchored: bool, below: bool) -> bool:
    tokens = [t for t in re.split(r"(\*\*/|\*\*|\*|\?)", pattern) if t]

    @lru_cache(None)
    def go(i: int, j: int) -> bool:
        if i == len(tokens):
            return j == len(path) or below and path[j] == "/"
        t = tokens[i]
        if t == "**/":
            return go(i + 1, j) or any(path[k - 1] == "/" and go(i + 1, k) for k in range(j + 1, len(path) + 1))
        if t == "**":
            return any(go(i + 1, k) for k in range(j, len(path) + 1))
        if t == "*":
            return any(go(i + 1, k) for k in range(j, len(path) + 1) if "/" not in path[j:k])
        if t == "?":
            return j < len(path) and path[j] != "/" and go(i + 1, j + 1)
        return path.startswith(t, j) and go(i + 1, j + len(t))

    starts = [0] if anchored else [0, *(k + 1 for k, c in enumerate(path) if c == "/")]
    return any(go(0, s) for s in starts)


def test_globs():
    rng = random.Random(1)
    for _ in range(4000):
        pattern = "".join(rng.choice(["a", "b", "/", "*", "**", "**/", "?", ".", "[a]"]) for _ in range(rng.randint(1, 6)))
        path = "".join(rng.choice("ab/.[]") for _ in range(rng.randint(0, 8)))
        anchored, below = rng.random() < 0.5, rng.random() < 0.5
        pattern = re.sub(r"\*{3,}", "**", pattern)
        assert bool(re.match(globs.glob_regex(pattern, anchored, below), path)) == slow_glob(pattern, path, anchored, below), (pattern, path, anchored, below)


def test_adversarial_glob_ends(spark):
    df = spark.createDataFrame([("a" * 5000,)], "path string")
    assert not df.select(rules.in_pathspec(F.col("path"), ["a*" * 40 + "b"])).first()[0]


def test_ignore_lines():
    got = globs.ignore_rules("# c\n\n  \n!x\nd/\n/r\\#\na/b  \n\\!lit\n")
    assert [(r.negated, r.dir_only, r.line) for r in got] == [(True, False, 4), (False, True, 5), (False, False, 6), (False, False, 7), (False, False, 8)]
    assert re.match(got[2].regex, "r#") and re.match(got[3].regex, "a/b") and not re.match(got[3].regex, "x/a/b") and re.match(got[4].regex, "q/!lit")


def test_pruned_by_a_parent(spark):
    df = spark.createDataFrame([("build/a.o",), ("src/a",), ("build",)], "path string")
    levels = [("root", "", "build/\n")]
    got = df.select("path", rules.is_ignored(F.col("path"), levels).alias("own"), rules.pruned(F.col("path"), levels).alias("walk")).collect()
    assert [(r.own, r.walk) for r in got] == [(False, True), (False, False), (False, False)]


def test_line_differences_are_shortest_and_rebuild():
    rng = random.Random(2)
    for _ in range(800):
        a, b = ([rng.choice("abc") + "\n" for _ in range(rng.randint(0, 9))] for _ in range(2))
        runs, _ = linediff.diff(a, b)
        i = j = 0
        for r in runs:
            assert (r.a, r.b) == (i, j)
            if r.kind == "common":
                assert a[i : i + r.a_len] == b[j : j + r.b_len]
            i, j = i + r.a_len, j + r.b_len
        assert (i, j) == (len(a), len(b))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for p, q in itertools.product(range(len(a)), range(len(b))):
            table[p + 1][q + 1] = table[p][q] + 1 if a[p] == b[q] else max(table[p][q + 1], table[p + 1][q])
        assert sum(r.a_len for r in runs if r.kind == "common") == table[-1][-1]


def test_giving_up_replaces_everything(monkeypatch):
    monkeypatch.setattr(linediff, "MOST_EDITS", 3)
    runs, degraded = linediff.diff(["a\n", "b\n", "c\n"], ["x\n", "y\n"])
    assert degraded and [r.kind for r in runs] == ["ours-only", "theirs-only"]
    assert linediff.diff([], []) == ([linediff.Run("common", 0, 0, 0, 0)], False)


def test_merge_laws():
    rng = random.Random(3)
    for _ in range(400):
        o, a, b = ("".join(rng.choice("abcd") + "\n" for _ in range(rng.randint(0, 8))) for _ in range(3))
        assert linediff.merge(o, o, b) == (b, 0) == linediff.merge(o, b, o) == linediff.merge(o, b, b)
        assert linediff.merge(o, a, b)[1] == linediff.merge(o, b, a)[1]
    base = "".join(f"{i}\n" for i in range(30))
    both = linediff.merge(base, base.replace("3\n", "A\n", 1), base.replace("\n20\n", "\nB\n"))
    assert both == (base.replace("3\n", "A\n", 1).replace("\n20\n", "\nB\n"), 0)
    text, n = linediff.merge(base, base.replace("\n9\n", "\nA\n"), base.replace("\n9\n", "\nB\n"))
    assert n == 1 and "<<<<<<< ours\nA\n=======\nB\n>>>>>>> theirs\n" in text
    assert linediff.merge("x\n", "x\na\n", "x\nb\n", favour="union") == ("x\na\nb\n", 0)


def test_assignment_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randint(1, 5)
        c = [[rng.randint(0, 9) for _ in range(n)] for _ in range(n)]
        got = linediff.assignment(c)
        assert sum(c[i][got[i]] for i in range(n)) == min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_series_and_blame():
    assert linediff.correspond(["a\nb\n", "c\nd\ne\n"], ["c\nd\nf\n", "a\nb\n"]) == [(1, 0, "!"), (0, 1, "=")]
    assert linediff.correspond(["a\n"], []) == [(0, None, "<")] and linediff.correspond([], ["a\n"]) == [(None, 0, ">")]
    assert linediff.blame(["a\nb\n", "a\nx\nb\n", "a\nx\nb\nc\n"]) == [0, 1, 0, 2]


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.blob_oid(F.lit("hello a\n"))) == "74614c9224e259adae80b04d6a0e3f483407324d"
    assert one(scalar.stripspace(F.lit("\n a  \n\n\n\nb\t\n\n"))) == " a\n\nb\n"
    assert one(scalar.fold_subject(F.lit("one \ntwo\n\nbody"))) == "one two"
    assert one(scalar.collapsed(F.lit("/a/./b//../c"))) == "/a/c"
    assert [one(scalar.unsafe_path(F.lit(p))) for p in ("a/b", "../x", ".git/x", "a/.GIT. /y", "/a")] == [None, "dot-segment", "dot-git", "dot-git", "absolute"]
    assert [one(scalar.valid_ref(F.lit(n))) for n in ("refs/heads/a", "a..b", "a.lock", "x/.y", "a b", "@", "")] == [True, False, False, False, False, False, False]
    assert one(scalar.ref_candidates(F.lit("x")))[2] == "refs/tags/x"


def test_revision_grammar():
    s = revisions.parse("main~3^2@{1}:a/b")
    assert [(x.kind, x.number) for x in s] == [("name", 0), ("back", 3), ("parent", 2), ("log", 1), ("path", 0)]
    assert revisions.parse("@{0}")[0].text == "HEAD" and revisions.parse("v1^{tree}")[1].text == "tree"
    for bad in ("", "a b", "x^{odd}", "x@{"):
        with pytest.raises(ValueError):
            revisions.parse(bad)
    assert revisions.approximate_date("2 days ago", 1_000_000) == 1_000_000 - 172_800
    assert revisions.approximate_date("1970-01-02 00:00:01", 0) == 86_401 and revisions.approximate_date("1970-13-02", 0) is None


def test_config_text():
    text = '[core]\n\tBare = false ; c\n\tflag\n[remote "o\\"x"]\n\turl = "a#b" c\n'
    assert store.parse_config(text) == [("core", "bare", "false"), ("core", "flag", None), ('remote.o"x', "url", "a#b c")]


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    if not shutil.which("git"):
        pytest.skip("needs git to make a repository")
    at = tmp_path_factory.mktemp("repo")
    env = os.environ | {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Tester"), ("EMAIL", "t@x.dev"), ("DATE", "1700000000 +0000"))}
    git = lambda *a: subprocess.run(["git", *a], cwd=at, env=env, check=True, capture_output=True, text=True).stdout
    git("init", "-q", "-b", "main")
    (at / "dir").mkdir()
    for i in range(5):
        (at / "a.txt").write_text("".join(f"line {k}\n" for k in range(60 + i)))
        (at / "dir" / "b.txt").write_text(f"b {i}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"commit {i}\n\nbody")
    git("tag", "-a", "v1", "-m", "tag")
    git("-c", "gc.reflogExpire=never", "gc", "-q", "--aggressive")
    (at / "c.txt").write_text("late\n")
    git("add", "-A")
    git("commit", "-q", "-m", "late")
    return at, git


def test_repository_is_read(spark, repository):
    at, git = repository
    objects = store.objects(spark, f"{at}/.git").cache()
    want = {tuple(x.split()) for x in git("cat-file", "--batch-check", "--batch-all-objects").splitlines()}
    assert {(r.oid, r.type, str(r.size)) for r in objects.collect()} == want
    commits = store.commits(objects).collect()
    assert {(r.oid, r.author.name, r.author.ts) for r in commits} == {(x, "Tester", 1700000000) for x in git("rev-list", "--all").split()}
    head = git("rev-parse", "HEAD").strip()
    tree = git("rev-parse", "HEAD^{tree}").strip()
    entries = store.tree_entries(objects)
    flat = {(r.path, r.oid) for r in store.flat_tree(entries, tree).collect()}
    assert flat == {(x.split("\t")[1], x.split()[2]) for x in git("ls-tree", "-r", "HEAD").splitlines()}
    refs = {r.name: r for r in store.refs(spark, f"{at}/.git").collect()}
    assert refs["HEAD"].symbolic == "refs/heads/main" and refs["refs/heads/main"].oid == head and refs["refs/tags/v1"].peeled == git("rev-parse", "v1^{}").strip()
    log = store.reflogs(spark, f"{at}/.git").where("ref = 'HEAD'").orderBy("seq").collect()
    assert log[-1].new_oid == head and log[-1].message == "commit: late"
    assert {(r.path, r.oid) for r in store.index(spark, f"{at}/.git").collect()} == flat
    tags = objects.where("type = 'tag'").select("oid", F.regexp_extract(F.decode("content", "UTF-8"), "^object ([0-9a-f]+)", 1).alias("object"))
    logs = store.reflogs(spark, f"{at}/.git").select("ref", "seq", "old_oid", "new_oid", "ts")
    t = revisions.Tables(store.refs(spark, f"{at}/.git"), store.commits(objects), tags, entries, logs)
    for e in ("HEAD", "main~2", "v1^{commit}", "HEAD^{tree}", "main:dir/b.txt", "main@{1}", head[:8]):
        assert t.resolve(e) == git("rev-parse", e).strip(), e
    with pytest.raises(LookupError):
        t.resolve("nothing")
