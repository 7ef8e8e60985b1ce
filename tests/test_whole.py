"""Queries that take all rows, against plain Python over the smallest tables."""

from __future__ import annotations

import hashlib
import random
from itertools import permutations

from histframe.functions import linediff
from histframe.operators import content as C
from histframe.plans import content
from histframe.sources import lenses as L


def least_cost(old, new):
    """The cheapest way to pair two small series, equal texts first."""
    old, new = list(old), list(new)
    for t in list(new):
        if t in old:
            old.remove(t), new.remove(t)
    alone = lambda t: (t.count("\n") + 1) * 60 // 100
    slots = [*range(len(old)), *[None] * len(new)]
    costs = [sum(alone(t) if i is None else sum(linediff.counts(old[i], t)) for i, t in zip(p, new, strict=True)) + sum(alone(old[i]) for i in range(len(old)) if i not in p) for p in permutations(slots, len(new))]
    return min(costs)


def test_range_diff_takes_every_patch(spark, small):
    steps = C.steps(L.versions(spark, small)).collect()
    sides = {}
    for r in sorted(steps, key=lambda r: (r.file, r.version)):
        n, text = r.file * 100 + r.version, linediff.patch("f", r.old, r.new)
        old, new = sides.setdefault(r.file, ([], []))
        old.append(text)
        if n % 3:
            new.append(text + "+more\n" if n % 5 == 0 else text)
    found = {}
    for r in content.range_diff(spark, small).collect():
        found.setdefault(r.series, []).append(r)
    assert found.keys() == sides.keys() and len(sides) > 5
    alone = lambda t: (t.count("\n") + 1) * 60 // 100
    for series, (old, new) in sides.items():
        rows = found[series]
        assert sorted(r.old for r in rows if r.old is not None) == list(range(len(old)))
        assert sorted(r.new for r in rows if r.new is not None) == list(range(len(new)))
        assert all((old[r.old] == new[r.new]) == (r.status == "=") for r in rows if r.status in "=!")
        cost = {"=": lambda r: 0, "!": lambda r: sum(linediff.counts(old[r.old], new[r.new])), "<": lambda r: alone(old[r.old]), ">": lambda r: alone(new[r.new])}
        assert sum(cost[r.status](r) for r in rows) == least_cost(old, new)


def pieces(text):
    held = {}
    for line in text.encode().split(b"\n"):
        line += b"\n"
        for i in range(0, len(line), 64):
            held[line[i : i + 64]] = held.get(line[i : i + 64], 0) + len(line[i : i + 64])
    last = text.encode().split(b"\n")[-1] + b"\n"  # ends without a newline
    start = (len(last) - 1) // 64 * 64
    held[last[start:]] -= len(last[start:])
    if last[start:-1]:
        held[last[start:-1]] = held.get(last[start:-1], 0) + len(last[start:-1])
    return held


def test_similarity_scores_every_text(spark, small):
    want = {}
    for r in L.blobs(spark, small).collect():
        a, b = pieces(r.content), pieces("line\n" + r.content)
        want[r.oid, r.oid + "~"] = sum(min(n, b.get(c, 0)) for c, n in a.items()) * 60_000 // (r.size + 5)
    got = content.similarity(spark, small).collect()
    assert {(r.src, r.dst): r.score for r in got} == want and len(got) == len(want)


def test_whitespace_and_cat_file_take_every_document(spark, small):
    rows = L.blobs(spark, small).collect()
    assert sorted(map(tuple, content.whitespace(spark, small).collect())) == sorted((r.doc_id, r.doc_id % 4 == 0) for r in rows)
    want = sorted((r.doc_id, "f" * 40 if r.doc_id % 7 == 0 else r.oid, r.doc_id % 7 != 0, r.size if r.doc_id % 7 else None) for r in rows)
    assert sorted(map(tuple, content.cat_file(spark, small).collect())) == want
    larger = small.replace("sf0.001", "sf0.01")  # more than 300 ids
    assert content.cat_file(spark, larger).count() == L.table(spark, larger, "documents").count() > 300


def slow_renames(gone, new, least=30_000):
    """Every pair scored; four sources a destination, then the best pairs first."""
    parts = {p: pieces(t) for p, t in [*gone, *new]}
    size = {p: len(t.encode()) for p, t in [*gone, *new]}
    order = []
    for d, _ in sorted(new):
        slots = []
        for s, _ in sorted(gone):
            most = max(size[s], size[d])
            score = sum(min(n, parts[d].get(c, 0)) for c, n in parts[s].items()) * 60_000 // most if most else 0
            if score < least:
                continue
            if len(slots) < 4:
                slots.append((score, s, d))
            elif score > min(slots)[0]:
                slots[[x[0] for x in slots].index(min(slots)[0])] = (score, s, d)
        order += slots
    out, used = [], set()
    for score, s, d in sorted(order, key=lambda x: -x[0]):
        if not {(0, s), (1, d)} & used:
            used |= {(0, s), (1, d)}
            out.append((s, d, score))
    return sorted(out)


def test_inexact_renames_equal_brute_force(spark, small):
    rng = random.Random(5)
    texts = sorted({r.oid: r.content for r in L.blobs(spark, small).collect() if r.size < 4_000}.values())[:70]
    lines = [f"line {i} {'x' * rng.randrange(80)}" for i in range(40)]
    texts += ["\n".join(rng.choice(lines[: 8 + i % 20]) for _ in range(rng.randrange(1, 25))) for i in range(40)] + ["", "a\n", "a"]
    gone = [(f"g{i:03}", t) for i, t in enumerate(texts)]
    new = [(f"n{rng.random()}", "\n".join(x for x in t.split("\n") if rng.random() < 0.8) + rng.choice(["", "\nmore\n", "\nother\n"])) for _, t in gone]
    frames = [spark.createDataFrame([(p, hashlib.sha1(t.encode()).hexdigest(), len(t.encode()), t) for p, t in side], "path string, oid string, size long, content string") for side in (gone, new)]
    want = slow_renames(gone, new)
    assert sorted(map(tuple, C.inexact_renames(*frames, limit=0).collect())) == want and len(want) > 50
    assert C.inexact_renames(*frames, limit=100).collect() == []
    assert sorted(map(tuple, C.inexact_renames(*frames, limit=200).collect())) == want


def test_inexact_renames_query_takes_every_text(spark, small):
    rows = L.blobs(spark, small).dropDuplicates(["oid"]).collect()
    want = slow_renames([(r.path, r.content) for r in rows], [("new/" + r.path, r.content + "\nadded!\n") for r in rows])
    assert sorted(map(tuple, content.renames(spark, small).collect())) == want and len(want) > 150


def slow_full(diff, texts, copies, breaks, preimage=(), least=30_000):
    """Renames, copies and rewrites pair by pair."""
    size = {o: len(t.encode()) for o, t in texts.items()}
    parts = {o: pieces(t) for o, t in texts.items()}
    common = lambda a, b: sum(min(n, parts[b].get(c, 0)) for c, n in parts[a].items())
    work, broken = [], {}
    for path, kind, old, new in diff:
        most = max(size[old], size[new]) if kind == "modify" else 0
        shared = common(old, new) if kind == "modify" else 0
        if breaks and kind == "modify" and most and min(size[old] + size[new] - 2 * shared, most) * 60_000 // most >= breaks[0]:
            broken[path] = (old, new, (size[old] - shared) * 60_000 // size[old] if size[old] else 0)
            work += [(path, "delete", old, None), (path, "add", None, new)]
        else:
            work.append((path, kind, old, new))
    by_id = {}
    for path, kind, old, _ in work:
        if kind == "delete":
            by_id.setdefault(old, []).append(path)
    out, gone, adds = [], set(), []
    for path, kind, old, new in work:
        if kind == "add" and len(by_id.get(new, [])) == 1:
            gone.add(by_id[new][0])
            out.append((path, "rename", by_id[new][0], new, new, 60_000))
        elif kind == "add":
            adds.append((path, new))
    deletes = [(p, o) for p, k, o, _ in work if k == "delete" and p not in gone]
    others = [(p, o) for p, k, o, _ in work if k == "modify"]
    sources = {"off": [], "on": deletes + others, "harder": list(preimage)}[copies]
    order = []
    for d, new in adds:
        for copy, from_ in ((0, deletes), (1, sources)):
            slots = []
            for s, old in sorted(from_):
                most = max(size[old], size[new])
                score = common(old, new) * 60_000 // most if most else 0
                if score < least:
                    continue
                if len(slots) < 4:
                    slots.append((score, s, old))
                elif score > min(slots, key=lambda x: x[0])[0]:
                    slots[[x[0] for x in slots].index(min(slots, key=lambda x: x[0])[0])] = (score, s, old)
            order += [(-score, copy, d, i, s, old, new) for i, (score, s, old) in enumerate(slots)]
    used, done = set(), set()
    for score, copy, d, _, s, old, new in sorted(order):
        if d in done or not copy and s in used:
            continue
        done.add(d)
        used |= set() if copy else {s}
        out.append((d, "copy" if copy else "rename", s, old, new, -score))
    left = [(p, "delete", None, o, None, None) for p, o in deletes if p not in used] + [(p, "add", None, None, n, None) for p, n in adds if p not in done]
    for path, (old, new, dissimilarity) in broken.items():
        halves = [x for x in left if x[0] == path]
        if len(halves) == 2:
            left = [x for x in left if x not in halves]
            out.append((path, "modify", None, old, new, dissimilarity if dissimilarity >= breaks[1] else None))
    return sorted(out + left + [(p, k, None, o, n, None) for p, k, o, n in work if k == "modify"], key=str)


def test_renames_copies_and_rewrites_equal_brute_force(spark):
    rng = random.Random(13)
    line = lambda: f"line {rng.randrange(60)} {'y' * rng.randrange(50)}\n"
    texts, diff, before = {}, [], []

    def put(text):
        oid = hashlib.sha1(text.encode()).hexdigest()
        texts[oid] = text
        return oid

    for i in range(60):
        base = [line() for _ in range(rng.randint(1, 14))]
        near = "".join(x for x in base if rng.random() < 0.75) + line()
        other = "".join(line() for _ in range(rng.randint(1, 12)))
        p, old = f"p{i:02}", put("".join(base))
        before.append((p, old))
        kind = i % 5
        if kind == 0:
            diff += [(p, "delete", old, None), (f"m{rng.random()}", "add", None, put(near))]
        elif kind == 1:
            diff += [(p, "modify", old, put(near + "z")), (f"c{rng.random()}", "add", None, put(near))]
        elif kind == 2:
            diff += [(p, "modify", old, put(other)), (f"c{rng.random()}", "add", None, put(near))]
        elif kind == 3:
            diff += [(p, "delete", old, None), (f"e{rng.random()}", "add", None, old)]
        else:
            diff.append((f"h{rng.random()}", "add", None, put(near)))
    diff = [x for x in diff if x[2] != x[3] or x[2] is None]
    frame = spark.createDataFrame(diff, "path string, kind string, old_oid string, new_oid string")
    blobs = spark.createDataFrame([(o, len(t.encode()), t) for o, t in texts.items()], "oid string, size long, content string")
    tree = spark.createDataFrame(before, "path string, oid string")
    kinds = set()
    for copies, breaks in (("off", None), ("on", None), ("harder", None), ("on", (30_000, 36_000)), ("off", (1, 1))):
        got = C.renames(frame, blobs, copies=copies, breaks=breaks, preimage=tree if copies == "harder" else None, limit=0).select("path", "kind", "old_path", "old_oid", "new_oid", "score").collect()
        want = slow_full(diff, texts, copies, breaks, before)
        assert sorted(map(tuple, got), key=str) == want, (copies, breaks)
        kinds |= {r.kind for r in got} | {"broken" for r in got if r.kind == "modify" and r.score}
    assert kinds == {"rename", "copy", "modify", "add", "delete", "broken"}
    none = C.renames(frame, blobs, limit=2).where("score < 60000").count()
    assert none == 0
