"""Shared helpers: byte-level word streams, Arrow access, column naming."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from histframe.scratch import release, shared_dir, written  # noqa: F401  for this package's modules

#: Bytes of text that one vectorised step looks at.
SLICE_BYTES = 2 << 20

def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, found by position where names clash in case or are repeated: the first wins."""
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*(f"`{c}`" for c in columns))
    renamed = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return renamed.select(*(renamed[f"_{at[c]}"].alias(c) for c in columns))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ... by position, so that no name can clash, and the names that they had."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def restored(df: DataFrame, names: Sequence[str], at: Iterable[int]) -> DataFrame:
    """The columns at these positions under these names."""
    return df.select(*(f"`{df.columns[i]}`" for i in at)).toDF(*names)


def strings(column: pa.Array) -> pa.Array:
    """A text column without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows that hold about `most` bytes each; a longer text stands alone."""
    ends = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b
        a = b


def offsets(values: pa.Array) -> np.ndarray:
    """Where the contents of large strings or binaries begin and end, from 0."""
    at = np.frombuffer(values.buffers()[1], "<i8")[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return at - at[0]


def contents(values: pa.Array) -> np.ndarray:
    """The bytes of large strings or binaries, one after the other."""
    if not len(values) or values.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    at = np.frombuffer(values.buffers()[1], "<i8")[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]]


def gathered(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[ends[r]:ends[r + 1]] of the rows r, one after the other, and where each ends."""
    sizes = np.diff(ends)[rows]
    to = np.r_[0, np.cumsum(sizes)]
    return values[np.repeat(ends[:-1][rows] - to[:-1], sizes) + np.arange(to[-1])], to


class Memo(dict):
    """A bounded memo of two generations: what is asked for again outlives a full one."""

    def __init__(self, make, kept: int, chars: int):
        self.make, self.kept, self.chars, self.old = make, kept, chars, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.chars:
                return value
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: tables of the operator that it runs, and of no other."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back at the end of each task, since workers live on."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


#: Separators of words, and the lower-casing of A-Z: every other byte stands for itself.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x00:0x30] = _FOLD[0x3A:0x61] = _FOLD[0x7B:0x80] = 32
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


class Words:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of several texts, A-Z lower-cased, in one buffer.

    buf: words with one byte (32) between them, 0 after each text; start, end: of
    each word in buf; doc: row of each word; ends: where each text's 0 stands.
    """

    def __init__(self, texts: pa.Array):
        joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        offsets = np.frombuffer(joined.buffers()[1], dtype="<i8")[joined.offset : joined.offset + len(joined) + 1]
        raw = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        folded = _FOLD[raw]
        last = offsets[1:] - offsets[0] - 1
        keep = folded != 32
        keep[1:] |= keep[:-1].copy()
        folded[last] = 0
        keep[last] = True
        self.buf = buf = folded[keep]
        word = buf > 32
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(buf == 0)
        self.doc = np.searchsorted(self.ends, self.start)
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)


_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(_P, -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, p, np.uint64)]) for p in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: polynomial prefix sums, so that all words are hashed at once."""
    out = np.empty(len(words.start), np.uint64)
    i, n = 0, len(words.start)
    while i < n:
        lo = words.start[i]
        j = max(i + 1, int(np.searchsorted(words.end, lo + SLICE_BYTES, side="right")))
        hi = words.end[j - 1]
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_TABLE[words.buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = words.start[i:j] - lo, words.end[i:j] - lo
        out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each text and their rows; a text of fewer words, but not none, is one run."""
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
    size = np.minimum(counts, width)[doc]
    out = size.astype(np.uint64)
    for k in range(width):
        inside = k < size
        nxt = hashes[np.where(inside, at + k, 0)] if len(hashes) else np.zeros(len(at), np.uint64)
        out = np.where(inside, mixed(out * np.uint64(_P) + nxt), out)
    return out, doc
