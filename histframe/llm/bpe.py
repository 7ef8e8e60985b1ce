"""Byte-level BPE with a rank queue: buckets per merge rank under a hierarchical bitmap.

The parts of a pre-token form a linked list. Bucket r holds the positions whose pair
merges at rank r, a bitmap of two levels says which buckets are filled, and its lowest
set bit names the next merge, so a merge costs a few word operations however long the
pre-token is. An entry whose pair has changed since is stale and skipped.

Texts are encoded a slice at a time. The distinct pre-tokens of a slice that are no
tokens stand in one linked list, one after the other, and share one queue whose buckets
hold 256 ranks each: they take turns as the bitmap says, and of the lowest filled bucket
each pre-token merges its lowest pair, all of them in one step. A very long pre-token
has a queue of its own with a bucket for every rank. Ids, their decimal forms and the
decoded bytes of whole documents are then looked up by number.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import contents, gathered, kept, offsets, only, pieces, strings, tidy

_BITS = 8
_MASK = (1 << _BITS) - 1
_ONE = [1 << i for i in range(1 << _BITS)]
#: Longest pre-token, in bytes, that shares a queue with others.
SHORT = 240
#: Bytes of text that are encoded at once; a longer text is cut where a space begins a pre-token.
SLICE = 2 << 20


class RankQueue:
    """Positions by merge rank; pops the lowest rank's lowest position. Empty again after every encoding.

    Two levels of bitmap: `top` tells which words of `low` are filled, those tell
    which buckets are. A bucket is a heap, so that its work doesn't follow the text's length.
    """

    def __init__(self, ranks: int):
        self.low, self.top = [0] * ((ranks >> _BITS) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> _BITS] |= _ONE[rank & _MASK]
        self.top |= 1 << (rank >> _BITS)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        w = self.low[i]
        rank = i << _BITS | (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[i] = w = w & (w - 1)
            if not w:
                self.top &= self.top - 1
        return rank, position


class SharedQueue:
    """Entries (pre-token, rank, position) of many pre-tokens, as arrays in buckets of 256 ranks.

    A bitmap names the filled buckets. An entry is one number that sorts by pre-token,
    rank and position.
    """

    PLACE, RANK = 23, 18

    def __init__(self):
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, owners: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> None:
        high = ranks >> _BITS
        order = np.argsort(high, kind="stable")
        high, entries = high[order], ((owners << self.RANK | ranks) << self.PLACE | places)[order]
        cuts = [0, *(np.flatnonzero(high[1:] != high[:-1]) + 1).tolist(), len(high)] if len(high) else []
        for i, j in pairwise(cuts):
            h = int(high[i])
            self.buckets.setdefault(h, []).append(entries[i:j])
            self.top |= 1 << h

    def pop(self) -> np.ndarray | None:
        """All entries of the lowest filled bucket, sorted."""
        if not self.top:
            return None
        h = (self.top & -self.top).bit_length() - 1
        self.top &= self.top - 1
        return np.sort(np.concatenate(self.buckets.pop(h)))

    @classmethod
    def apart(cls, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return entries >> (cls.PLACE + cls.RANK), entries >> cls.PLACE & ((1 << cls.RANK) - 1), entries & ((1 << cls.PLACE) - 1)


class Pairs:
    """(left id, right id) -> id of both together, by open addressing in arrays; -1 where the bytes are no token."""

    def __init__(self, ranks: dict[bytes, int]):
        found: dict[int, int] = {}
        for whole, r in ranks.items():
            for i in range(1, len(whole)):
                a = ranks.get(whole[:i])
                if a is not None and (b := ranks.get(whole[i:])) is not None:
                    found[a << 24 | b] = r
        self.bits = max(4, (3 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            late = self.keys[at] != keys  # someone else has the slot
            keys, values, at = keys[late], values[late], (at[late] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 24 | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


#: Where a text may be cut: a space before anything but white space begins a pre-token, whatever stands before it.
_CUT = re.compile(r" (?=\S)")
_MEETING = re.compile(r"\s\s").search


class BytePairEncoder:
    """Encodes like the library that reads the same rank file, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.queue = RankQueue(size)
        self.pairs = Pairs(self.ranks)
        spelled = [b""] * size
        for b, i in self.ranks.items():
            spelled[i] = b
        self.bytes_of = pa.array(spelled, pa.large_binary())
        self.decimal = pa.array([f"{i} " for i in range(size)], pa.large_string())
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token, by a queue of its own."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        rank_of, push, pop, n = self.ranks.get, self.queue.push, self.queue.pop, len(raw)
        end, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n

        def join(i: int, to: int) -> None:
            r = rank_of(raw[i:to])
            pair[i] = -1 if r is None else r
            if r is not None:
                push(r, i)

        for i in range(n - 1):
            join(i, i + 2)
        while (head := pop()) is not None:
            r, i = head
            if pair[i] != r:
                continue  # stale
            j = end[i]
            e = end[i] = end[j]
            pair[i] = pair[j] = -1
            if e < n:
                before[e] = i
                join(i, end[e])
            if before[i] >= 0:
                join(before[i], e)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def together(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens raw[ends[i]:ends[i + 1]], by one queue, and where each one's ids end."""
        n = len(raw)
        part = self.byte_id[raw]
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        border = np.zeros(n + 1, bool)  # nothing merges across it
        border[ends] = True
        alive = np.ones(n, bool)
        rank = np.full(n, -1, np.int64)
        queue = SharedQueue()

        def join(left: np.ndarray, right: np.ndarray) -> None:
            r = self.pairs.get(part[left], part[right])
            rank[left] = r
            some = r >= 0
            queue.push(owner[left[some]], r[some], left[some])

        inner = np.flatnonzero(~border[1:n]) if n else np.zeros(0, np.int64)
        join(inner, inner + 1)
        while (entries := queue.pop()) is not None:
            owners, ranks, left = SharedQueue.apart(entries)
            live = rank[left] == ranks  # the others are stale
            owners, ranks, left = owners[live], ranks[live], left[live]
            lowest = np.ones(len(owners), bool)
            lowest[1:] = owners[1:] != owners[:-1]
            queue.push(owners[~lowest], ranks[~lowest], left[~lowest])
            # each pre-token merges its lowest pair, so that no two merges touch
            i = left[lowest]
            j = after[i]
            part[i] = rank[i]
            e = after[i] = after[j]
            alive[j] = False
            rank[i] = rank[j] = -1
            on, back = ~border[e], ~border[i]
            before[e[on]] = i[on]
            join(np.concatenate([i[on], before[i[back]]]), np.concatenate([e[on], i[back]]))
        return part[alive], np.r_[0, np.cumsum(np.bincount(owner[alive], minlength=len(ends) - 1))]

    def pre_tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens and where each one's end."""
        raw = tokens.cast(pa.large_binary())
        whole = pc.index_in(raw, value_set=self.bytes_of)
        known = whole.is_valid().to_numpy(zero_copy_only=False)
        ends = offsets(raw)
        short = ~known & (np.diff(ends) <= SHORT)
        counts, parts = np.ones(len(tokens), np.int64), {}
        for i in np.flatnonzero(~known & ~short).tolist():
            parts[i] = np.array(self.piece(raw[i].as_py()), np.int64)
            counts[i] = len(parts[i])
        rows = np.flatnonzero(short)
        shared = []
        # as many at once as an entry's bits can tell apart
        held = np.cumsum(np.diff(ends)[rows]) >> (SharedQueue.PLACE - 1)
        for rows_ in np.split(rows, np.flatnonzero(np.diff(held)) + 1):
            some = raw.take(pa.array(rows_))
            values, upto = self.together(contents(some), offsets(some))
            shared.append(values)
            counts[rows_] = np.diff(upto)
        to = np.r_[0, np.cumsum(counts)]
        out = np.empty(to[-1], np.int64)
        out[to[:-1][known]] = whole.drop_null().to_numpy()
        out[np.repeat(short, counts)] = np.concatenate(shared)
        for i, ids in parts.items():
            out[to[i] : to[i + 1]] = ids
        return out, to

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts and where each text's end."""
        leads, rest, sizes = [], [], []
        for t in texts.to_pylist():
            lead, *fields = _CUT.split(t) if _MEETING(t) else t.split(" ")
            leads.append(lead)
            rest += fields
            sizes.append(len(fields))
        coded = pa.array(rest, pa.large_string()).dictionary_encode()
        del rest
        # distinct fields with their space stay apart in one string; what a text begins with is split by itself
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string()))
        found = self.find(contents(spaced).tobytes().decode())
        upto = np.searchsorted(np.cumsum([0, *map(len, map(str.encode, found))]), offsets(spaced))
        n = [len(found)]
        for lead in leads:
            found += self.find(lead)
            n.append(len(found))
        upto = np.r_[upto, n[1:]]
        tokens = pa.array(found, pa.large_string()).dictionary_encode()
        del found
        ids, ends = gathered(*self.pre_tokens(tokens.dictionary), tokens.indices.to_numpy())
        # the fields of each text: its lead and what follows
        first = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]
        number = np.empty(first[-1], np.int64)
        lead = np.zeros(len(number), bool)
        lead[first[:-1]] = True
        number[lead], number[~lead] = np.arange(len(leads)) + len(spaced), coded.indices.to_numpy()
        ids, to = gathered(ids, ends[upto], number)
        return ids, to[first]

    def encode(self, text: str) -> list[int]:
        return self.encode_slice(pa.array([text], pa.large_string()))[0].tolist()

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and where each id's end."""
        return _looked_up(self.bytes_of, ids)

    def shown(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, a space after each, and where each one's end."""
        return _looked_up(self.decimal, ids)

    def decode(self, ids: list[int]) -> bytes:
        return self.decoded(np.array(ids, np.int64))[0].tobytes()


def _looked_up(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table.take(pa.array(ids))
    return contents(found), offsets(found)


def encoder(path: str, pattern: str) -> BytePairEncoder:
    return kept(("bpe", path, pattern), lambda: BytePairEncoder(path, pattern))


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that are encoded apart: each but the first begins with a space that begins a pre-token."""
    at = 0
    while (cut := _CUT.search(text, at + SLICE)) is not None:
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every whole text beside the columns in `keep`; with ids also token_ids.

    A null text counts as empty: no tokens, hashes of nothing. Rows are independent, so
    repeated rows give repeated results and an empty table gives none. A very long text
    is encoded part by part, so that only its ids are held whole. Other columns of
    `docs` don't matter, whatever their names. `path` must be readable on executors.
    """
    schema = only(docs, *keep).schema if keep else docs.limit(0).select().schema
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("token_ids", ArrayType(IntegerType()))
    narrow = only(docs, *keep, text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            for a, b in pieces(texts, SLICE):
                slices = [texts.slice(a, b - a)]
                if b - a == 1:
                    slices = (pa.array([p], pa.large_string()) for p in _parts(texts[a].as_py()))
                counts, shown, spelled, lists = np.zeros(b - a, np.int64), [hashlib.sha256() for _ in range(a, b)], [hashlib.sha256() for _ in range(a, b)], []
                for part in slices:
                    values, ends = bpe.encode_slice(part)
                    (digits, at), (raw, upto) = bpe.shown(values), bpe.decoded(values)
                    for i, (lo, hi) in enumerate(pairwise(ends.tolist())):
                        if hi > lo:
                            if counts[i]:
                                shown[i].update(b" ")
                            shown[i].update(digits[at[lo] : at[hi] - 1])
                            spelled[i].update(raw[upto[lo] : upto[hi]])
                    counts += np.diff(ends)
                    if ids:
                        lists.append(values.astype(np.int32))
                columns = [*batch.slice(a, b - a).columns[: len(keep)], pa.array(counts), pa.array([h.hexdigest() for h in shown]), pa.array([h.hexdigest() for h in spelled])]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(np.concatenate(lists))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(run, schema)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encoded(docs, path, pattern, keep=("doc_id",), ids=False)
