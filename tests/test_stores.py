"""Side files of real repositories, archives, text files, folders, and write events."""

from __future__ import annotations

import random
import struct
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from histframe.operators import reading
from histframe.sources import archive, packs, repository, store, writing
from histframe.streaming import bus


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """A repository with merges, tags, a pack, a graph, a bundle and a linked worktree."""
    at = tmp_path_factory.mktemp("repo")

    def git(*words, **more):
        env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@b", "GIT_AUTHOR_DATE": "1700000000 +0000", "GIT_COMMITTER_DATE": "1700000000 +0000", "HOME": str(at), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        return subprocess.run(["git", "-C", str(at), *words], check=True, capture_output=True, text=True, env=env, **more).stdout

    try:
        git("init", "-q", "-b", "main")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git here")
    (at / "d").mkdir()
    for i in range(6):
        (at / "d" / f"f{i % 2}.txt").write_text("line\n" * i + f"{i}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"c{i}")
        if i == 2:
            git("branch", "side")
    git("checkout", "-q", "side")
    (at / "side.txt").write_text("s\n")
    git("add", "-A")
    git("commit", "-q", "-m", "side")
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "merged", "side")
    git("tag", "-a", "v1", "-m", "first")
    git("repack", "-adq")
    git("commit-graph", "write", "--reachable")
    git("multi-pack-index", "write")
    git("bundle", "create", "-q", str(at / "x.bundle"), "main", "^side")
    git("worktree", "add", "-q", "-b", "wt", str(at.parent / "linked"))
    return at, git


def test_pack_indexes(spark, repo):
    at, git = repo
    listed = {line.split()[0] for line in git("cat-file", "--batch-all-objects", "--batch-check").split("\n") if line}
    shown = {(x.split()[1], int(x.split()[0])) for x in git("show-index", stdin=open(next(at.glob(".git/objects/pack/*.idx")))).strip().split("\n")}
    got = packs.pack_entries(spark, f"{at}/.git").collect()
    assert {(r.oid, r.offset) for r in got} == shown and {r.oid for r in got} == listed
    multi = packs.located(spark, f"{at}/.git").collect()
    assert {(r.oid, r.offset) for r in multi} == shown and {r.pack for r in multi} == {r.pack for r in got}


def test_commit_graph(spark, repo):
    at, git = repo
    want = {}
    for line in git("log", "--all", "--format=%H %T %ct %P").strip().split("\n"):
        oid, tree, ts, *parents = line.split()
        want[oid] = (tree, parents, int(ts))
    got = packs.graph(spark, f"{at}/.git").collect()
    assert {r.oid: (r.tree, r.parents, r.ts) for r in got} == want
    by = {r.oid: r for r in got}
    assert all(r.generation > max([by[p].generation for p in r.parents], default=0) for r in got)


def test_octopus_parents():
    oids = [bytes([i]) * 20 for i in range(1, 6)]
    fan = b"".join(struct.pack(">I", sum(o[0] <= i for o in oids)) for i in range(256))
    rows = b"".join(o + struct.pack(">IIII", a, b, 3 << 2 | 1, 7) for o, a, b in zip(oids, [packs.NO_PARENT] * 4 + [0], [packs.NO_PARENT] * 4 + [packs.MORE], strict=True))
    edge = struct.pack(">III", 1, 2, 3 | packs.MORE)
    parts, at = [(b"OIDF", fan), (b"OIDL", b"".join(oids)), (b"CDAT", rows), (b"EDGE", edge)], 8 + 12 * 5
    table = b""
    for name, body in parts:
        table += struct.pack(">4sQ", name, at)
        at += len(body)
    raw = b"CGPH\x01\x01\x04\x00" + table + struct.pack(">4sQ", b"\0\0\0\0", at) + b"".join(b for _, b in parts)
    assert packs.commit_graph(raw)[4] == (oids[4].hex(), oids[4].hex(), [o.hex() for o in oids[:4]], 3, 1 << 32 | 7)
    with pytest.raises(ValueError):
        packs.commit_graph(b"CGPH\x02" + raw[5:])


def test_long_offsets():
    oid = b"\1" * 20
    raw = b"\xfftOc\0\0\0\2" + struct.pack(">I", 0) + struct.pack(">I", 1) * 255 + oid + struct.pack(">I", 9) + struct.pack(">I", 0x80000000) + struct.pack(">Q", 5 << 32)
    assert packs.pack_index(raw) == [(oid.hex(), 9, 5 << 32)]
    with pytest.raises(ValueError):
        packs.pack_index(b"x" * 2000)


def test_bundle(spark, repo):
    at, git = repo
    raw = (at / "x.bundle").read_bytes()
    version, required, refs, start = packs.bundle_header(raw)
    assert version == 2 and refs == [("refs/heads/main", git("rev-parse", "main").strip())] and raw[start : start + 4] == b"PACK"
    assert set(required) == {x[1:] for x in git("rev-list", "--boundary", "main", "^side").split() if x.startswith("-")}
    got = packs.bundle_heads(spark, f"{at}/x.bundle").collect()
    assert {(r.kind, r.oid) for r in got} == {("ref", refs[0][1]), *(("requires", o) for o in required)}


def _ewah(bits, words):
    """A compressed bitmap: literal words but for runs of full or empty ones."""
    values = [bits >> 64 * i & (1 << 64) - 1 for i in range(words)]
    out, i = [], 0
    while i < words:
        run = 0
        full = values[i] == (1 << 64) - 1
        while i < words and values[i] == (values[i] and (1 << 64) - 1) and (values[i] != 0) == full:
            run, i = run + 1, i + 1
        literal = []
        while i < words and values[i] not in (0, (1 << 64) - 1):
            literal.append(values[i])
            i += 1
        out += [int(full) | run << 1 | len(literal) << 33, *literal]
    return struct.pack(">II", 64 * words, len(out)) + struct.pack(f">{len(out)}Q", *out) + struct.pack(">I", 0)


def test_bitmaps():
    rng = random.Random(1)
    for _ in range(50):
        words = rng.randint(1, 12)
        bits = sum(rng.choice([0, (1 << 64) - 1, rng.getrandbits(64)]) << 64 * i for i in range(words))
        raw = b"zz" + _ewah(bits, words) + b"tail"
        assert packs.ewah(raw, 2) == (bits, len(raw) - 4)
        other = rng.getrandbits(64 * words)
        assert packs.folded(bits, [("or", other), ("xor", 5), ("andnot", other)]) == ((bits | other) ^ 5) & ~other
        assert packs.members(bits) == [i for i in range(64 * words) if bits >> i & 1]


def test_repository_tables(spark, repo):
    at, git = repo
    r = repository.open_repository(spark, str(at))
    assert {(x.path, x.oid) for x in r.head_tree().collect()} == {(line.split("\t")[1], line.split()[2]) for line in git("ls-tree", "-r", "main").strip().split("\n")}
    assert [(x.name, x.type, x.object) for x in r.tags().collect()] == [("v1", "commit", git("rev-parse", "main").strip())]
    assert r.objects.count() == r.pack_entries.select("oid").distinct().count()
    assert r.index.count() == 3 and r.reflogs.count() > 5
    stat = {x.path: x for x in r.index.collect()}
    real = (at / "side.txt").stat()
    assert (stat["side.txt"].ino, stat["side.txt"].size, stat["side.txt"].mtime, stat["side.txt"].uid) == (real.st_ino & 0xFFFFFFFF, real.st_size, int(real.st_mtime), real.st_uid)
    assert not stat["side.txt"].assume_valid and not stat["side.txt"].skip_worktree
    assert {x.path for x in r.snapshot("tree", git("rev-parse", "side").strip()).collect()} == {"d/f0.txt", "d/f1.txt", "side.txt"}
    assert r.read(git("rev-parse", "main:side.txt").strip()) == ("blob", b"s\n")
    for call in (lambda: r.read("0" * 40), lambda: r.snapshot("tree", "0" * 40)):
        with pytest.raises(LookupError):
            call()
    (at / "new.txt").write_text("n")
    assert {(x.path, x.untracked) for x in r.status().collect()} == {("new.txt", True), ("x.bundle", True)}
    (at / "new.txt").unlink()
    git("update-index", "--assume-unchanged", "d/f0.txt")
    assert [x.path for x in store.index(spark, f"{at}/.git").where("assume_valid").collect()] == ["d/f0.txt"]
    trees = repository.linked_worktrees(spark, f"{at}/.git").collect()
    assert [(x.path, x.ref, x.is_main) for x in trees] == [(str(at), "refs/heads/main", True), (str(at.parent / "linked"), "refs/heads/wt", False)]
    work = {x.path: x.oid for x in repository.workdir(spark, str(at)).collect()}
    assert work["side.txt"] == git("hash-object", "side.txt").strip() and not any(p.startswith(".git/") for p in work)
    with pytest.raises(LookupError):
        repository.open_repository(spark, str(at / "d"))


def test_archives(spark, repo, tmp_path):
    at, git = repo
    r = repository.open_repository(spark, str(at))
    blobs = r.objects.where("type = 'blob'").select("oid", "content")
    entries = reading.archive_entries(r.head_tree(), blobs)
    want = {name: git("show", f"main:{name}") for name in ("d/f0.txt", "d/f1.txt", "side.txt")}
    n = archive.write_tar(entries, str(tmp_path / "a.tar"))
    with tarfile.open(tmp_path / "a.tar") as t:
        assert [m.name for m in t] == ["d", "d/f0.txt", "d/f1.txt", "side.txt"] and n == 4
        assert {m.name: t.extractfile(m).read().decode() for m in t if m.isfile()} == want
    archive.write_zip(entries, str(tmp_path / "a.zip"))
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.namelist() == ["d/", "d/f0.txt", "d/f1.txt", "side.txt"] and {k: z.read(k).decode() for k in want} == want


def test_text_files_come_back(spark, tmp_path):
    refs = spark.createDataFrame([("refs/tags/v", "1" * 40, "2" * 40), ("refs/heads/m", "3" * 40, None)], "name string, oid string, peeled string")
    lines = [r.line for r in archive.packed_refs(refs).orderBy("ord").collect()]
    assert lines == ["# pack-refs with: peeled fully-peeled sorted ", "3" * 40 + " refs/heads/m", "1" * 40 + " refs/tags/v", "^" + "2" * 40]
    assert archive.packed_refs(refs.limit(0)).collect() == []
    (tmp_path / "packed-refs").write_text("\n".join(lines) + "\n")
    (tmp_path / "HEAD").write_text("ref: refs/heads/m\n")
    back = {(r.name, r.oid, r.peeled) for r in store.refs(spark, str(tmp_path)).collect()}
    assert back == {("refs/tags/v", "1" * 40, "2" * 40), ("refs/heads/m", "3" * 40, None), ("HEAD", None, None)}
    patterns = spark.createDataFrame([("/a/b/",), ("/c",)], "pattern string")
    assert [r.line for r in archive.sparse_text(patterns, True).orderBy("ord").collect()] == ["/*", "!/*/", "/a/", "!/a/*/", "/a/b/", "/c/"]


def test_generations(spark, tmp_path):
    events = tmp_path / "events"
    for i, rows in enumerate([[("r1", "ref", "a", "1")], [("r2", "ref", "b", "2"), ("r1", "index", "", "3")], [("r2", "ref", "b", "4")]]):
        spark.createDataFrame(rows, bus.SCHEMA).coalesce(1).write.mode("append").parquet(str(events))
    seen = []

    def subscriber(rows, number):
        now = {r.scope: r.generation for r in bus.generations(spark, str(tmp_path / "gen")).collect()}
        seen.append((number, sorted(r.scope for r in rows.collect()), now))

    stream = spark.readStream.schema(bus.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(events))
    bus.publish(stream, str(tmp_path / "gen"), str(tmp_path / "ck"), subscriber).awaitTermination()
    assert len(seen) == 3
    for number, scopes, now in seen:  # the counter has moved before the subscriber sees a batch
        assert all(now[s] == number + 1 for s in scopes)
    held = spark.createDataFrame([("r1", 1), ("r2", 99)], "scope string, generation long")
    assert [r.scope for r in bus.stale(held, bus.generations(spark, str(tmp_path / "gen"))).collect()] in (["r1"], [])


def test_hunk_headings(spark):
    rows = [("f", i, line) for i, line in enumerate(["  x", "def a():  ", " y", "_z" + "é" * 60, "9", "", "class B"])]
    got = reading.funcname_rows(spark.createDataFrame(rows, "path string, n int, line string")).orderBy("n").collect()
    cut = ("_z" + "é" * 60).encode()[:80].decode()
    assert [r.heading for r in got] == [None, "def a():", "def a():", cut, cut, cut, "class B"]


def test_arrays_are_limited(spark):
    df = spark.range(5).select(F.col("id"))
    assert len(reading.to_array(df, 5)) == 5
    with pytest.raises(ValueError):
        reading.to_array(df, 4)
    with pytest.raises(LookupError):
        reading.required(None, "nothing")


def test_written_packs_are_read(spark, repo, tmp_path):
    at, git = repo
    r = repository.open_repository(spark, str(at))
    objects = {(x.oid, x.type, bytes(x.content)) for x in r.objects.collect()}
    made = writing.packs(r.objects.repartition(2), 500).collect()
    assert len(made) > 2
    back = set()
    for m in made:
        rows = list(store.pack_objects(bytes(m.pack)))
        back |= {(o, k, c) for o, k, c in rows}
        assert [o for o, _, _ in packs.pack_index(bytes(m.idx))] == sorted(o for o, _, _ in rows)
        (tmp_path / f"{m.name}.pack").write_bytes(m.pack)
        (tmp_path / f"{m.name}.idx").write_bytes(m.idx)
        git("verify-pack", str(tmp_path / f"{m.name}.idx"))
    assert back == objects
    assert {(p, store.loose_object(bytes(raw))) for p, raw in writing.loose_files(r.objects).collect()} == {(f"{o[:2]}/{o[2:]}", (k, c)) for o, k, c in objects}
    body, idx = writing.pack([("blob", b"x" * n) for n in (0, 1, 15, 16, 2047, 2048, 70_000)] * 2)
    assert len(packs.pack_index(idx)) == 7 and {len(c) for _, _, c in store.pack_objects(body)} == {0, 1, 15, 16, 2047, 2048, 70_000}
    whole, _ = writing.pack([(k, c) for _, k, c in sorted(objects)])
    (tmp_path / "y.bundle").write_bytes(writing.bundle({"refs/heads/main": git("rev-parse", "main").strip()}, [], whole))
    git("bundle", "verify", str(tmp_path / "y.bundle"))
    assert writing.pack_index({"ab" * 20: (1, 5 << 31)}, b"\0" * 20)[-48:-40] == struct.pack(">Q", 5 << 31)


def test_written_index_is_read(repo, tmp_path):
    at, git = repo
    raw = (at / ".git/index").read_bytes()
    entries = store.index_entries(raw)
    assert store.index_entries(writing.index_file(entries[::-1])) == entries
    odd = [("a" * 5000, 2, "100755", "1" * 40, *range(9), True, True, False), ("b", 0, "120000", "2" * 40, *range(9), False, False, True)]
    assert store.index_entries(writing.index_file(odd)) == odd
    (tmp_path / "index").write_bytes(writing.index_file(entries))
    env = {"GIT_INDEX_FILE": str(tmp_path / "index"), "PATH": "/usr/bin:/bin:/usr/local/bin"}
    listed = subprocess.run(["git", "-C", str(at), "ls-files", "--stage"], check=True, capture_output=True, text=True, env=env).stdout
    assert [tuple(x.split("\t")[0].split()) for x in listed.strip().split("\n")] == [(e[2], e[3], str(e[1])) for e in entries]
