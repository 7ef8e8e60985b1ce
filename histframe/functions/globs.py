"""Path patterns as regular expressions.

`*` and `?` stay within a segment, `**` crosses them, `**/` stands for any number of
whole segments; brackets are plain characters. Patterns come from a short list on the
driver; a path is tested by one expression inside code generation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


def _escaped(text: str) -> str:
    return re.sub(r"([.+^${}()|\[\]\\*?])", r"\\\1", text)


def _piece(tokens: list[str]) -> str:
    return "".join("[^/\n]" if t == "?" else _escaped(t) for t in tokens)


def _cut(tokens: list[str], at: tuple[str, ...]) -> tuple[list[list[str]], list[str]]:
    """The runs between the tokens in `at`, and those tokens."""
    runs, seps = [[]], []
    for t in tokens:
        if t in at:
            seps.append(t)
            runs.append([])
        else:
            runs[-1].append(t)
    return runs, seps


def _chunk(tokens: list[str], last: bool) -> str:
    """A run without `**`: after each star the first place where the next piece fits will do, so it is kept (atomic).

    Only the pattern's very last star may come back, since what follows must reach the end.
    """
    pieces, stars = _cut(tokens, ("*",))
    out = _piece(pieces[0])
    for i, p in enumerate(pieces[1:], 1):
        out += f"[^/\n]*{_piece(p)}" if last and i == len(stars) else f"(?>[^/\n]*?{_piece(p)})"
    return out


def glob_regex(pattern: str, anchored: bool = True, below: bool = False) -> str:
    """The pattern's regular expression; unanchored it may begin at any segment, with `below` it takes descendants too.

    A star comes back to other places only where it is the last one, or the last before
    a `**/`, which takes whole segments and not just anything; so time is polynomial
    in the path, of a degree that only such tokens raise.
    """
    tokens = [t for t in re.split(r"(\*\*/|\*\*|\*|\?)", pattern) if t]
    chunks, wide = _cut(tokens, ("**", "**/"))
    out = _chunk(chunks[0], not wide or wide[0] == "**/")
    for i, (c, w) in enumerate(zip(chunks[1:], wide, strict=True), 1):
        last = i == len(wide) or wide[i] == "**/"
        if w == "**":
            out += f"[^\n]*{_chunk(c, True)}" if last else f"(?>[^\n]*?{_chunk(c, False)})"
        else:
            out += f"(?:[^\n]*/)?{_chunk(c, True)}" if last else f"(?>(?:[^\n]*?/)??{_chunk(c, False)})"
    return "^" + ("" if anchored else "(?:[^\n]*/)?") + out + ("(?:/[^\n]*)?" if below else "") + "$"


def ref_glob_regex(pattern: str) -> str:
    """Of ref names, where `*` and `?` also cross slashes."""
    return "^" + "".join({"*": ".*", "?": "."}.get(x, _escaped(x)) for x in pattern) + "$"


@dataclass(frozen=True)
class Rule:
    """One line of a rule list. `value` is whatever the list assigns."""

    regex: str
    negated: bool = False
    dir_only: bool = False
    line: int = 0
    pattern: str = ""


def pathspec(patterns: list[str]) -> list[Rule]:
    """A literal takes its descendants too; a glob with a slash is anchored; `!` takes back."""
    out = []
    for i, raw in enumerate(patterns):
        body = raw.removeprefix("!")
        literal = not set(body) & {"*", "?"}
        out.append(Rule(glob_regex(body, literal or "/" in body, literal), raw.startswith("!"), False, i + 1, raw))
    return out


def ignore_rules(text: str) -> list[Rule]:
    """The rules of an ignore file: comments, `!`, a trailing slash for directories, `\\` before a plain character."""
    out = []
    for number, raw in enumerate(text.split("\n"), 1):
        if not raw.strip() or raw.startswith("#"):
            continue
        line = raw
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        body = line.removeprefix("!")
        negated, dir_only = line != body, body.endswith("/")
        body = body.removesuffix("/") if dir_only else body
        plain = lambda s: re.sub(r"\\(.)", r"\1", s)
        out.append(Rule(glob_regex(plain(body.removeprefix("/")), "/" in body), negated, dir_only, number, plain(line)))
    return out
