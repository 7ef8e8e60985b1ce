"""Benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is a window of ten consecutive words of a benchmark item, its words
joined by one space. Documents are brought to the same form, and many cursors walk
through them in step: the block of bytes that ends at a cursor looks up how far no
pattern can end (the shift table), so most positions are never looked at. Where the
shift is 0, the hash of the block and of the window's first bytes names the bucket
of patterns to compare byte by byte.

Patterns of very different lengths would cut every shift down to the shortest one;
they are searched in classes of similar length, each with tables of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, kept, mixed, numbered, only, pieces, restored, shingle_hashes, strings, tidy, word_hashes, written

WINDOW = 10
#: Bytes of benchmark text that are searched for at once; a larger benchmark takes several passes. A window takes some 40 bytes of tables.
BLOCK_BYTES = 4 << 20
_LANE = 1024
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Patterns:
    """Windows as places in one buffer of words; whose they are: items[owner[first[k]:first[k + 1]]] own window k."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    items: list[str]


def windows(items: list[str], texts: pa.Array, window: int = WINDOW) -> Patterns:
    """The distinct windows of some items' texts; one of all its words if they are fewer; none without words."""
    names = sorted(set(items))
    place = {x: i for i, x in enumerate(names)}
    number = np.array([place[x] for x in items], np.int64)
    words = Words(texts)
    hashes = word_hashes(words)
    h1, row = shingle_hashes(hashes, words.counts, window)
    h2, _ = shingle_hashes(mixed(hashes ^ _MULT), words.counts, window)  # 128 bits tell windows apart
    base = np.cumsum(words.counts) - words.counts
    runs = np.bincount(row, minlength=len(words.counts))
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + base[row]
    start, end = words.start[at], words.end[at + np.minimum(words.counts[row], window) - 1]
    order = np.lexsort((number[row], h2, h1))
    h1, h2, own = h1[order], h2[order], number[row][order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    again = np.r_[False, ~new[1:] & (own[1:] == own[:-1])] if len(h1) else new  # the same item's
    head = order[new]
    return Patterns(words.buf, start[head], end[head], np.r_[np.flatnonzero(new[~again]), (~again).sum()], own[~again], names)


def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that end before each position of a buffer with eight bytes in front."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))


class _Class:
    """Shift table and suffix buckets for patterns of similar length."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, numbers: np.ndarray):
        """buf has eight bytes in front, which start and end don't count."""
        self.m = m = int((end - start).min())
        self.block = b = min(8, max(1, m // 2))
        self.view, self.start, self.end, self.numbers = memoryview(buf)[8:], start, end, numbers
        self.cut = np.uint64(8 * (8 - b))
        loads = _loads(buf)
        bits = int(min(22, max(12, np.ceil(np.log2(len(start) * (m - b + 1) * 8)))))
        self.right = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - b + 1, np.int64)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self._slot(loads[start + j + b]), m - b - j)
        key = self._key(loads[start + m], loads[start + min(m, 8)])
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _slot(self, loaded: np.ndarray) -> np.ndarray:
        return ((loaded >> self.cut) * _MULT) >> self.right

    def _key(self, suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        width = np.uint64(8 * (8 - min(self.m, 8)))
        return (suffix >> self.cut) * _MULT ^ ((prefix >> width) * np.uint64(0xC2B2AE3D27D4EB4F))

    def search(self, buf: np.ndarray, starts_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and pattern number of each occurrence that begins and ends with whole words; buf has eight bytes in front."""
        n, m = len(buf) - 8, self.m
        loads = _loads(buf)
        pos = np.arange(m, n + 1, _LANE)  # where the window ends, exclusive
        stop = np.minimum(pos + _LANE, n + 1)
        found = []
        while len(pos):
            jump = self.shift[self._slot(loads[pos])]
            here = jump == 0
            if here.any():
                found.append(pos[here])
                jump = np.maximum(jump, 1)
            pos = pos + jump
            if (left := pos < stop).sum() < len(pos):
                pos, stop = pos[left], stop[left]
        none = np.zeros(0, np.int64)
        if not found:
            return none, none, none
        at = np.concatenate(found) - m
        at = at[starts_word[at]]
        key = self._key(loads[at + m], loads[at + min(m, 8)])
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        s, e, k = [], [], []
        view = memoryview(buf)[8:]
        for a, i, j in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for x in self.order[i:j].tolist():
                z = a + int(self.end[x] - self.start[x])
                if view[a:z] == self.view[self.start[x] : self.end[x]] and (z == n or view[z] <= 32):
                    s.append(a), e.append(z), k.append(self.numbers[x])
        return np.array(s, np.int64), np.array(e, np.int64), np.array(k, np.int64)


class WuManber:
    """Finds whole-word occurrences of many strings of words in a Words buffer."""

    def __init__(self, given: Patterns):
        buf = np.concatenate([np.zeros(8, np.uint8), given.buf])
        size = np.minimum(6, np.frexp((given.end - given.start).astype(float))[1])  # the number of bits, 6 for all long ones
        self.classes = [_Class(buf, given.start[g], given.end[g], g) for g in (np.flatnonzero(size == k) for k in np.unique(size))]

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = np.concatenate([np.zeros(8, np.uint8), words.buf])
        starts = np.zeros(len(words.buf) + 1, bool)
        starts[words.start] = True
        found = [c.search(buf, starts) for c in self.classes if len(words.buf) >= c.m]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the same positions."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    first = np.r_[True, s[1:] > e[:-1]] if len(s) else np.zeros(0, bool)
    return s[first], e[np.r_[first[1:], True]] if len(s) else e


def _pass(docs: DataFrame, at: int, patterns: Patterns) -> DataFrame:
    """The rows with what this block of the benchmark adds to the last three columns; the text stands in column `at`."""
    given = docs.sparkSession.sparkContext.broadcast(patterns)  # at most `block_bytes` of benchmark text and tables of its size
    number = uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = given.value
        finder = kept(("wu-manber", number), lambda: WuManber(of))
        for batch in batches:
            texts = strings(batch.column(at))
            for a, b in pieces(texts):
                part = batch.slice(a, b - a)
                words = Words(texts.slice(a, b - a))
                spans: list[list] = [[] for _ in range(b - a)]
                items: list[set] = [set() for _ in range(b - a)]
                s, e, k = finder.search(words)
                for d, x in {*zip(np.searchsorted(words.ends, s).tolist(), k.tolist(), strict=True)}:
                    items[d].update(of.items[i] for i in of.owner[of.first[x] : of.first[x + 1]])
                base = np.cumsum(words.counts) - words.counts
                ms, me = _merged(s, e)
                f, t = np.searchsorted(words.start, ms), np.searchsorted(words.start, me)
                for d, x, y in zip(np.searchsorted(words.ends, ms).tolist(), f.tolist(), t.tolist(), strict=True):
                    spans[d].append({"first": x - int(base[d]), "last": y - int(base[d])})
                columns = [*part.columns[:-3], pa.array(words.counts)]
                for j, (old, new) in enumerate(zip((part.column(-2), part.column(-1)), (spans, [sorted(i) for i in items]), strict=True)):
                    if old.null_count < len(old):
                        new = [(o or []) + list(x) for o, x in zip(old.to_pylist(), new, strict=True)]
                    columns.append(pa.array(new, part.schema.field(len(part.schema) - 2 + j).type))
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


OUTPUT = ("n_words", "n_hit", "hit_spans", "item_ids", "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, scope: str = "session") -> DataFrame:
    """docs with n_words, n_hit, hit_spans (disjoint word ranges [first, last)), item_ids (sorted as strings) and contaminated.

    Each row is looked at by itself, so repeated rows give repeated results, and an empty
    table gives none. A null or empty text has no words; items without words are never
    found; an item whose id is null counts under the empty string. With an empty
    benchmark nothing is hit. Windows that several items hold count for each of them.
    Input columns called like an output column (in any case) are replaced, all others
    stay, clashing names among them. The benchmark is gathered in blocks of about
    `block_bytes` of text; each takes a search pass, whose results are written before
    the next, so that a task holds the tables of one block.
    """
    plain, names = numbered(docs)
    found = _found(plain, names.index(text), only(benchmark, item_id, item_text), window, block_bytes, scope)
    keep = [i for i, n in enumerate(names) if n.lower() not in OUTPUT]
    return restored(found, [*(names[i] for i in keep), *OUTPUT], [*keep, *range(len(names), len(names) + len(OUTPUT))])


def _found(docs: DataFrame, at: int, benchmark: DataFrame, window: int, block_bytes: int, scope: str) -> DataFrame:
    """The columns as they are and, last, those of OUTPUT."""
    columns = docs.columns
    # the spans and items found so far travel in the row
    docs = docs.withColumns({"_n": F.lit(None).cast("long"), "_spans": F.lit(None).cast("array<struct<first:long,last:long>>"), "_items": F.lit(None).cast("array<string>")})
    items = benchmark.toDF("i", "t").select(F.coalesce(F.col("i").cast("string"), F.lit("")).alias("i"), "t").where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = [(r.i, r.t) for r in part.toLocalIterator()] or [("", "")]
        docs = _pass(docs, at, windows([i for i, _ in rows], pa.array([t for _, t in rows], pa.large_string()), window))
        if k + 1 < blocks:
            docs = written(docs, "search", scope)
    if blocks > 1:
        # spans of several passes may overlap: those that begin inside an earlier one are joined to it
        docs = docs.withColumn("_spans", F.expr("""aggregate(array_sort(_spans), cast(array() as array<struct<first:long,last:long>>), (acc, x) ->
            case when size(acc) > 0 and element_at(acc, -1).last >= x.first
                 then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last))))
                 else concat(acc, array(x)) end)"""))
    hit = F.expr("aggregate(_spans, 0L, (n, x) -> n + x.last - x.first)")
    return docs.select(*columns, F.col("_n").alias("n_words"), hit.alias("n_hit"), F.col("_spans").alias("hit_spans"), F.array_sort(F.array_distinct("_items")).alias("item_ids"), (F.size("_spans") > 0).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination`` for each document."""
    found = contamination(only(docs, "doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", scope: str = "session") -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns, whatever their names.

    Documents without words stay; repeated rows stay or go together.
    """
    plain, names = numbered(docs)
    found = _found(plain, names.index(text), only(benchmark, "item_id", "text"), WINDOW, BLOCK_BYTES, scope)
    return restored(found.where(~F.col("contaminated")), names, range(len(names)))
