"""Names of commits against a walk over every path in plain Python."""

from __future__ import annotations

from histframe.operators import graph as G
from histframe.plans import graph
from histframe.sources import lenses as L

EDGES, REFS = "child long, parent long, idx int", "oid long, name string, tagger_ts long"


def slow_names(edges, refs):
    """Commit -> (name, distance): each commit's least offer, commits after all of their children."""
    parents, waiting = {}, {}
    for child, parent, idx in edges:
        parents.setdefault(child, []).append((parent, idx))
        waiting[parent] = waiting.get(parent, 0) + 1
    best = {}

    def offer(oid, n):
        best[oid] = min(best.get(oid, n), n)

    for oid, name, ts in refs:
        tag = name.startswith("refs/tags/")
        offer(oid, (not tag, 0, 1 << 62 if ts is None else ts, name.removeprefix("refs/heads/").removeprefix("refs/"), "", 0))
    ready = [x for x in {*parents, *waiting} if x not in waiting]
    while ready:
        at = ready.pop()
        for parent, idx in parents.get(at, []):
            if at in best:
                other, distance, ts, ref, path, tail = best[at]
                offer(parent, (other, distance + 1, ts, ref, path, tail + 1) if idx == 0 else (other, distance + 65_535, ts, ref, path + (f"~{tail}" if tail else "") + f"^{idx + 1}", 0))
            waiting[parent] -= 1
            if not waiting[parent]:
                ready.append(parent)
    return {oid: (n[3] + n[4] + (f"~{n[5]}" if n[5] else ""), n[1]) for oid, n in best.items()}


def names(df):
    return {r.oid: (r.name, r.distance) for r in df.collect()}


def test_long_chain_is_named_to_its_end(spark):
    edges = [(i, i + 1, 0) for i in range(400)] + [(1000 + i, 1001 + i, 0) for i in range(150)] + [(30, 1000, 1), (1100, 380, 1), (200, 1120, 1)]
    refs = [(0, "refs/heads/main", None), (250, "refs/tags/v1", 5), (1010, "refs/heads/side", None), (250, "refs/tags/v0", 9)]
    got = names(G.named(spark.createDataFrame(edges, EDGES), spark.createDataFrame(refs, REFS)))
    assert got == slow_names(edges, refs)
    assert got[249] == ("main~249", 249) and got[400] == ("tags/v1~150", 150) and len(got) == 552


def test_query_names_from_all_refs(spark, small):
    c = L.commits(spark, small)
    edges = [tuple(r) for r in L.edges(c).select("child", "parent", "idx").collect()]
    refs = [tuple(r) for r in L.tags(c).select("oid", "name", "tagger_ts").collect()] + [(r.oid, r.name, None) for r in L.branches(c).collect()]
    got = names(graph.name_rev(spark, small))
    assert got == slow_names(edges, refs)
    assert got.keys() == {r.oid for r in c.collect()}
