"""Token counts by a compiled transducer.

A merge table with word-end symbols is compiled, state by state as texts ask for them,
into a deterministic transducer over bytes whose transitions carry the number of
tokens that they add. It rests on this fact: for each prefix of a word exactly one
token can stand last, namely the one that ends there and that may follow the last
token of what is before it. So a state holds, for each way in which the last bytes
may begin a longer token, the token before them and the difference in count; equal
sets are one state, and the set of states is finite.

White space is dropped and ends every word, so it brings the transducer to its start
state. The distinct runs without white space of many texts are looked at once each. A
very long word, as texts without white space have, is cut into chunks. A chunk's map
takes a state to the state behind the chunk and the tokens between; it is known for
the states that words leave behind which begin a little before the chunk, since states
hardly depend on what is far away, and found by another run over the chunk for any
other state. Maps compose associatively and are combined in the tree of a parallel
prefix scan; memory follows the text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, kept, offsets, only, pieces, strings, tidy

#: Bytes of a chunk of a very long word, and of what is read before it to guess its state.
CHUNK, BEFORE = 1 << 16, 256
#: Bytes of text whose distinct runs are looked at together, and runs of a longer text.
SLICE, RUNS = 4 << 20, 500_000


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of one pre-token. Symbols 0-255 are bytes, 256-511 bytes that end the word."""

    START = 0
    #: States above which a word begins with none.
    MOST = 150_000

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        byte = _byte_of()
        symbol = {c: byte[c] for c in byte} | {c + suffix: byte[c] + 256 for c in byte}
        number: dict[str, int] = dict(symbol)
        self.parts: list[tuple[int, int] | None] = [None] * 512
        self.pairs: dict[tuple[int, int], int] = {}
        spelled: list[tuple[int, ...]] = [(i,) for i in range(512)]
        for a, b in merges:
            x, y = number[a], number[b]
            t = number.setdefault(a + b, len(self.parts))
            if t == len(self.parts):
                self.parts.append((x, y))
                spelled.append(spelled[x] + spelled[y])
            self.pairs.setdefault((x, y), t)
        # a trie of the tokens' symbols
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, way in enumerate(spelled):
            node = 0
            for s in way:
                nxt = self.child[node].get(s)
                if nxt is None:
                    nxt = self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = t
        self.follows = lru_cache(1 << 18)(self._follows)
        self.restart()

    def restart(self) -> None:
        """Forget the compiled states."""
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((0, -1, 0),))

    def restart_if_full(self) -> None:
        if len(self.content) > self.MOST:
            self.restart()

    def _state(self, content: tuple) -> int:
        if (s := self.states.get(content)) is None:
            s = self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
        return s

    def _follows(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart: undoing merges from the latest, no pair across the border would merge earlier."""
        limit = len(self.parts)
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            # of equal merges the right one came later, so that it is undone first
            if a > b:
                if a < 512:
                    return True
                limit, a = a, self.parts[a][1]
            else:
                if b < 512:
                    return True
                limit, b = b + 1, self.parts[b][0]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens that the transition adds."""
        known = self.moves[state].get(symbol)
        if known is None:
            on, last, added = [], -1, 0
            for node, before, rel in self.content[state]:
                nxt = self.child[node].get(symbol)
                if nxt is None:
                    continue
                t = self.token[nxt]
                if t >= 0 and last < 0 and (before < 0 or self.follows(before, t)):
                    last, added = t, rel + 1
                if self.child[nxt]:
                    on.append((nxt, before, rel))
            content = (*((n, b, r - added) for n, b, r in on), (0, last, 0))
            known = self.moves[state][symbol] = (self._state(content), added)
        return known

    def through(self, state: int, raw: bytes) -> tuple[int, int]:
        """The state behind some bytes inside a word, and the tokens that they add."""
        total, moves, move = 0, self.moves, self.move
        for b in raw:
            state, added = moves[state].get(b) or move(state, b)
            total += added
        return state, total

    def count(self, raw: bytes, chunk: int = CHUNK, before: int = BEFORE) -> int:
        """Tokens of a whole pre-token."""
        if not raw:
            return 0
        inner = raw[:-1]
        if len(inner) <= chunk:
            state, total = self.through(self.START, inner)
        else:
            cuts = range(0, len(inner), chunk)
            maps = [StateMap(self, inner[i : i + chunk], self.content[self.through(self.START, inner[max(0, i - before) : i])[0]]) for i in cuts]
            while len(maps) > 1:  # the scan's upward half: neighbours by pairs, in log2(n) levels
                maps = [a.then(b) for a, b in zip(maps[::2], maps[1::2], strict=False)] + maps[len(maps) & ~1 :]
            after, total = maps[0].at(self.content[self.START])
            state = self._state(after)
        return total + self.move(state, raw[-1] + 256)[1]


class StateMap:
    """What a chunk does to states: state -> (state behind it, tokens). States go by their contents, which outlive a restart."""

    def __init__(self, transducer: Transducer, raw: bytes, guess: tuple):
        self.transducer, self.raw = transducer, raw
        self.known = {guess: self._run(guess)}

    def _run(self, state: tuple) -> tuple[tuple, int]:
        self.transducer.restart_if_full()
        after, total = self.transducer.through(self.transducer._state(state), self.raw)
        return self.transducer.content[after], total

    def at(self, state: tuple) -> tuple[tuple, int]:
        if state not in self.known:
            self.known[state] = self._run(state)
        return self.known[state]

    def then(self, other: StateMap) -> StateMap:
        """First this, then the other one: associative."""
        return _Both(self, other)


class _Both(StateMap):
    """A composition; known where its first part is."""

    def __init__(self, first: StateMap, second: StateMap):
        self.first, self.second = first, second
        self.known = {s: self._run(s) for s in first.known}

    def _run(self, state: tuple) -> tuple[tuple, int]:
        middle, a = self.first.at(state)
        after, b = self.second.at(middle)
        return after, a + b


class TokenCounter:
    """Counts as the library reads the file: lower case, NFC, special strings found in the text as it is."""

    #: Entries of each memo's two generations, and the longest word or run that is remembered.
    KEPT, KEPT_CHARS = 100_000, 40
    #: Characters of a run whose words are listed; those of a longer one come one by one.
    LISTED = 1 << 16

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        self.transducer = Transducer([tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model["end_of_word_suffix"])
        self.words = regex.compile(given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        added = sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.counts = Memo(self._word, self.KEPT, self.KEPT_CHARS)
        self.known = Memo(self.run, self.KEPT, self.KEPT_CHARS)

    def _word(self, word: str) -> int:
        self.transducer.restart_if_full()
        return self.transducer.count(word.encode("utf-8", "surrogatepass"))

    def run(self, text: str) -> int:
        """Tokens of a text without white space."""
        if self.special is not None and "<|" in text and (cuts := self.special.split(text)) and len(cuts) > 1:
            return len(cuts) - 1 + sum(map(self.run, cuts))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text))  # letter by letter: no final form of sigma
        else:
            text = text.lower()
        words = self.words.findall(text) if len(text) <= self.LISTED else (m[0] for m in self.words.finditer(text))
        return sum(map(self.counts.__getitem__, words))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b in pieces(texts, SLICE):
            if b - a == 1:  # maybe very long
                text = texts[a].as_py()
                found = (m[0] for m in (_ODD_RUN if _ODD.search(text) else _RUN).finditer(text))
                while some := list(islice(found, RUNS)):
                    out[a] += self._runs(some).sum()
                continue
            lists = [_ODD_RUN.findall(t) if _ODD.search(t) else t.split() for t in texts.slice(a, b - a).to_pylist()]
            doc = np.repeat(np.arange(a, b), list(map(len, lists)))
            np.add.at(out, doc, self._runs([r for found in lists for r in found]))
        return out

    def _runs(self, runs: list[str]) -> np.ndarray:
        """Tokens of each run; distinct ones are counted once."""
        coded = pa.array(runs, pa.large_string()).dictionary_encode()
        return np.array(list(map(self.known.__getitem__, coded.dictionary.to_pylist())), np.int64)[coded.indices.to_numpy()] if runs else np.zeros(0, np.int64)

    def count(self, text: str) -> int:
        return int(self.texts(pa.array([text], pa.large_string()))[0])


#: Runs without white space; what `re` takes for white space and the tokenizer doesn't needs another pattern.
_RUN, _ODD, _ODD_RUN = re.compile(r"\S+"), re.compile("[\x1c-\x1f]"), regex.compile(r"\S+")


def counter(path: str) -> TokenCounter:
    return kept(("tokens", path), lambda: TokenCounter(path))


def counted(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, n_bytes (UTF-8) and n_tokens of every whole text.

    A null text counts as empty. Rows are independent: repeated rows give repeated
    results, an empty table gives none. A very long text is counted by the task that has
    its row, in memory that follows the text and not the number of its tokens. Other
    columns of `docs` don't matter, whatever their names.
    """
    schema = only(docs, *keep).schema.add("n_bytes", "long").add("n_tokens", "long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(offsets(texts))), pa.array(c.texts(texts))], names=schema.names)

    return only(docs, *keep, text).mapInArrow(run, schema)


def report(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    return counted(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
