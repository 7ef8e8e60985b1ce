"""Revision expressions over state tables: names, hex prefixes, `@{n}`, `@{seconds}`, `~n`, `^n`, `^{type}`, `rev:path`.

An expression is parsed on the driver; every step is a point lookup, so what comes
back at each is one id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histframe.functions.scalar import is_oid

PREFIXES = ("", "refs/", "refs/tags/", "refs/heads/", "refs/remotes/")
MOST_LINKS = 5


@dataclass(frozen=True)
class Step:
    kind: str  # name, log, date, back, parent, peel, path
    text: str = ""
    number: int = 0


def parse(expression: str) -> list[Step]:
    """The steps of an expression; ValueError names the place that can't be read."""
    m = re.match(r"[^\x00-\x20~^:?*\[\\@]+|@(?!\{)", expression)
    at = m.end() if m else 0
    steps = [Step("name", "HEAD" if not m or m[0] == "@" else m[0])]
    if not m and not expression.startswith(("@{", ":")):
        raise ValueError(f"no revision at 0 in {expression!r}")
    while at < len(expression):
        rest = expression[at:]
        if m := re.match(r"@\{(\d+)\}", rest):
            n = int(m[1])
            steps.append(Step("log", number=n) if n < 100_000_000 else Step("date", number=n))
        elif m := re.match(r"~(\d*)", rest):
            steps.append(Step("back", number=int(m[1] or 1)))
        elif m := re.match(r"\^\{(commit|tree|blob|tag|)\}", rest):
            steps.append(Step("peel", m[1]))
        elif m := re.match(r"\^(\d*)", rest):
            steps.append(Step("parent", number=int(m[1] or 1)))
        elif m := re.match(r":(.*)$", rest, re.S):
            steps.append(Step("path", m[1].removeprefix("./")))
        else:
            raise ValueError(f"can't read {rest!r} at {at} in {expression!r}")
        at += m.end()
    return steps


@dataclass
class Tables:
    """refs (name, oid, symbolic), commits (oid, tree, parents), tags (oid, object), trees (tree_oid, name, mode, oid), reflog (ref, seq, old_oid, new_oid, ts)."""

    refs: DataFrame
    commits: DataFrame
    tags: DataFrame
    trees: DataFrame
    reflog: DataFrame

    def _one(self, df: DataFrame, what: str):
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise LookupError(f"{what}: {'ambiguous' if rows else 'unknown'}")
        return rows[0]

    def ref(self, name: str) -> tuple[str, str]:
        """The full name and id of a ref, symbolic refs followed; candidates in their order."""
        wanted = [p + name for p in PREFIXES] + [f"refs/remotes/{name}/HEAD"]
        held = {r.name: r for r in self.refs.where(F.col("name").isin(wanted)).collect()}
        found = next((held[w] for w in wanted if w in held), None)
        for _ in range(MOST_LINKS + 1):
            if found is None:
                break
            if found.symbolic is None:
                return found.name, found.oid
            found = next(iter(self.refs.where(F.col("name") == found.symbolic).limit(1).collect()), None)
        raise LookupError(f"{name}: unknown ref")

    def prefix(self, text: str) -> str:
        ids = self.commits.select("oid").unionByName(self.tags.select("oid")).unionByName(self.trees.select("oid")).unionByName(self.trees.select(F.col("tree_oid").alias("oid")))
        return self._one(ids.where(F.col("oid").startswith(text.lower())).distinct(), text).oid

    def peel(self, oid: str, kind: str) -> str:
        while True:
            tag = self.tags.where(F.col("oid") == oid).limit(1).collect()
            if not tag or kind == "tag":
                break
            oid = tag[0].object
        if kind == "tree":
            commit = self.commits.where(F.col("oid") == oid).limit(1).collect()
            return commit[0].tree if commit else oid
        return oid

    def resolve(self, expression: str) -> str:
        steps, full, oid = parse(expression), "", ""
        for s in steps:
            if s.kind == "name":
                try:
                    full, oid = self.ref(s.text)
                except LookupError:
                    if not re.fullmatch("[0-9a-fA-F]{4,40}", s.text):
                        raise
                    full, oid = "", self.prefix(s.text)
            elif s.kind in ("log", "date"):
                # HEAD has a log of its own; a bare @{n} asks for the branch that HEAD stands for
                full = "HEAD" if expression.startswith("HEAD") else full
                rows = self.reflog.where(F.col("ref") == full)
                if s.kind == "log":
                    n = rows.count()
                    if s.number >= n:
                        raise LookupError(f"{full} has {n} entries only")
                    oid = rows.orderBy(F.desc("seq")).limit(s.number + 1).orderBy("seq").first().new_oid
                else:
                    hit = rows.where(F.col("ts") <= s.number).orderBy(F.desc("seq")).limit(1).collect()
                    oid = hit[0].new_oid if hit else rows.orderBy("seq").first().old_oid
            elif s.kind == "back":
                oid = self.peel(oid, "commit")
                for _ in range(s.number):
                    oid = self._parent(oid, 1)
            elif s.kind == "parent":
                oid = self.peel(oid, "commit")
                oid = self._parent(oid, s.number) if s.number else oid
            elif s.kind == "peel":
                oid = self.peel(oid, s.text or "commit")
            else:
                oid = self.peel(oid, "tree")
                for name in filter(None, s.text.split("/")):
                    oid = self._one(self.trees.where((F.col("tree_oid") == oid) & (F.col("name") == name)), f"{s.text} in {expression}").oid
        return oid

    def _parent(self, oid: str, n: int) -> str:
        row = self._one(self.commits.where(F.col("oid") == oid).select("parents"), oid)
        if n > len(row.parents):
            raise LookupError(f"{oid} has {len(row.parents)} parents")
        return row.parents[n - 1]


def approximate_date(text: str, now: int) -> int | None:
    """Seconds of "now", "yesterday", an ISO time (UTC) or "N units ago"; else None."""
    from datetime import UTC, datetime

    low = text.strip().lower()
    if low == "now":
        return now
    if low == "yesterday":
        return now - 86_400
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}
    if m := re.fullmatch(r"(\d+)[ .](second|minute|hour|day|week|month|year)s?[ .]ago", low):
        return now - int(m[1]) * units[m[2]]
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[t ](\d\d):(\d\d)(?::(\d\d))?)?z?", low):
        try:
            return int(datetime(*(int(x or 0) for x in m.groups()), tzinfo=UTC).timestamp())
        except ValueError:
            return None
    return None


def valid_ids(df: DataFrame, column: str = "oid") -> DataFrame:
    return df.where(is_oid(F.col(column)))
