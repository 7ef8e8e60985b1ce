"""Line dedup: sorted line hashes are streamed for first occurrences; the result is a keep bitmap per document.

1. Every long enough line becomes (128-bit hash of its key, document, position).
2. These rows are range-partitioned on all four columns and sorted, so a line that a
   third of all documents hold is spread over many partitions, in document order.
3. Each partition streams its rows once. A hash that begins inside the partition has
   its first document there; the run that a partition begins with may go on from the
   partition before, so it is decided when each partition's first and last run (two
   rows a partition) are put together.
4. The dropped positions of each document become a compressed bitmap; text is only
   touched again by whoever applies it.
"""

from __future__ import annotations

import io
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import numbered, only, partitions, pieces, restored, strings, tidy, written

LEAST = 10
_BLANK = b" \t\n\v\f\r"


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The line stripped and with A-Z in lower case; None if it has fewer than `least` code points."""
    key = line.strip(_BLANK).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


#: Lines that are hashed before they are handed on, and bytes of text that are joined or cut at once.
LINES, SLICE = 100_000, 4 << 20


def _lines(least: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, where, sums, sizes = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, strings(batch.column(1)).cast(pa.large_binary()), strict=True):
                if doc is None:
                    continue
                raw = text.as_buffer()
                row, n = xxhash.xxh3_64_intdigest(raw) - (1 << 63), raw.to_pybytes().count(b"\n") + 1
                for i, line in enumerate(io.BytesIO(raw)):  # line by line, however many a text has
                    if (key := line_key(line, least)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc), where.append(i), sums.append(row), sizes.append(n)
                        if len(digests) == LINES:
                            yield _packed(digests, docs, where, sums, sizes)
                            digests, docs, where, sums, sizes = [], [], [], [], []
            yield _packed(digests, docs, where, sums, sizes)

    return run


def _packed(digests, docs, where, sums, sizes) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(where, pa.int32()), pa.array(sums, pa.int64()), pa.array(sizes, pa.int32())], names=["h1", "h2", "doc", "pos", "row", "n"])


@tidy
def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: kind 0, dropped rows; 1, rows of its first run; 2, first and last run with their first document."""
    lead = last = None  # (h1, h2, first document)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        if last is not None:
            new[0] = (h1[0], h2[0]) != last[:2]
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first = np.where(at >= 0, doc[at], last[2] if last else 0)
        lead = lead or (h1[0], h2[0], doc[0])
        leading = (h1 == lead[0]) & (h2 == lead[1])
        last = (h1[-1], h2[-1], first[-1])
        kind = leading.astype(np.int8)
        take = leading | (doc != first)
        yield pa.RecordBatch.from_arrays([pa.array(kind), *batch.columns], names=["kind", *batch.schema.names]).filter(pa.array(take))
    if lead is not None:
        ends = [lead, last]
        columns = [[2, 2], [x[0] for x in ends], [x[1] for x in ends], [x[2] for x in ends], [0, 0], [0, 0], [0, 0]]
        types = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "h1", "h2", "doc", "pos", "row", "n"])


def pack(dropped: np.ndarray, n: int) -> bytes:
    """A compressed bitmap of n lines, 1 for kept."""
    keep = np.ones(n, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


@tidy
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(2).to_pylist()
        maps = [pack(np.array(p), n) for p, n in zip(batch.column(3).to_pylist(), sizes, strict=True)]
        dropped = pc.list_value_length(batch.column(3)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dropped, pa.array(maps, pa.binary())], names=["doc", "row", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, scope: str = "session") -> DataFrame:
    """(doc, row, n_dropped, keep) of each document that loses lines; keep is a compressed bitmap of its lines.

    A key found in several documents stays where the smallest id holds it. Rows of
    one id count as one document; `row`, a hash of the text, tells rows of one id
    apart, and equal rows share a bitmap. Rows with a null id neither lose lines nor
    make others lose them. A null text is one empty line.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id, text).select(F.col(doc_id).cast("long"), text)
    lines = written(rows.mapInArrow(_lines(least), "h1 long, h2 long, doc long, pos int, row long, n int"), "lines", scope)
    # the sample that sets the ranges reads the small written table, not the texts
    ordered = lines.repartitionByRange(partitions(spark), "h1", "h2", "doc", "pos", "row").sortWithinPartitions("h1", "h2", "doc", "pos", "row")
    found = written(ordered.mapInArrow(_firsts, "kind byte, h1 long, h2 long, doc long, pos int, row long, n int"), "line-firsts", scope)
    # two rows a partition at most, so small enough to send to every executor
    lead = F.broadcast(found.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("first")))
    late = found.where("kind = 1").join(lead, ["h1", "h2"]).where("doc != first").select("doc", "row", "n", "pos")
    dropped = found.where("kind = 0").select("doc", "row", "n", "pos").unionByName(late)
    # a group is one document's lines, which were one row before
    return dropped.groupBy("doc", "row", "n").agg(F.collect_set("pos").alias("at")).mapInArrow(_bitmaps, "doc long, row long, n_dropped long, keep binary")


def _apply(at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(at)).cast(pa.large_binary())
            for a, b in pieces(texts, SLICE):
                left, sizes = [], []
                for text, keep in zip(texts.slice(a, b - a), batch.column(-1).slice(a, b - a), strict=True):
                    raw = text.as_py()
                    n = raw.count(b"\n") + 1
                    if keep.is_valid:
                        raw = b"\n".join(itertools.compress(raw.split(b"\n"), unpack(keep.as_py(), n)))
                    left.append(raw)
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(left, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "kept_text", "n_lines"])

    return run


def _with_row(at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(at)).cast(pa.large_binary())
            rows = np.fromiter((xxhash.xxh3_64_intdigest(t.as_buffer()) for t in texts), np.uint64, len(texts))
            rows = (rows - np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows)], names=[*batch.schema.names, "_row"])

    return run


def _extended(schema: StructType, **more: str) -> StructType:
    schema = StructType([*schema.fields])
    for name, kind in more.items():
        schema.add(name, kind)
    return schema


OUTPUT = ("n_dropped", "kept_text", "n_lines")


def _deduped(plain: DataFrame, doc_id: str, text: str, least: int, scope: str) -> DataFrame:
    """The columns as they are and, last, those of OUTPUT; column names don't clash here."""
    at = plain.columns.index(text)
    maps = keep_bitmaps(plain, doc_id, text, least, scope)
    # the bitmaps know a row by its id and the hash of its text
    named = plain.mapInArrow(_with_row(at), _extended(plain.schema, _row="long"))
    same = (named[doc_id].cast("long") == maps["doc"]) & (named["_row"] == maps["row"])
    joined = named.join(maps, same, "left").select(*(named[c] for c in plain.columns), F.coalesce(maps["n_dropped"], F.lit(0).cast("long")).alias("n_dropped"), maps["keep"].alias("_keep"))
    return joined.mapInArrow(_apply(at), _extended(plain.schema, n_dropped="long", kept_text="string", n_lines="long"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, scope: str = "session") -> DataFrame:
    """docs with n_dropped, kept_text and n_lines (before dropping).

    Cases as in ``keep_bitmaps``. A document all of whose lines go keeps an empty text;
    an empty table stays empty. Columns named like these three (in any case) are
    replaced, all others stay, clashing names among them.
    """
    plain, names = numbered(docs)
    out = _deduped(plain, f"c{names.index(doc_id)}", f"c{names.index(text)}", least, scope)
    keep = [i for i, n in enumerate(names) if n.lower() not in OUTPUT]
    return restored(out, [*(names[i] for i in keep), *OUTPUT], [*keep, *range(len(names), len(names) + len(OUTPUT))])


def without_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, length: str | None = None, scope: str = "session") -> DataFrame:
    """docs with their own columns, whatever their names, and the text without the dropped lines.

    A column called `length`, if there is one, gets the new text's number of code points.
    Cases as in ``dedup_lines``.
    """
    plain, names = numbered(docs)
    at = names.index(text)
    out = _deduped(plain, f"c{names.index(doc_id)}", f"c{at}", least, scope)
    new = {f"c{at}": F.col("kept_text")}
    if length in names:
        i = names.index(length)
        new[f"c{i}"] = F.char_length("kept_text").cast(plain.schema[i].dataType)
    return restored(out.withColumns(new), names, range(len(names)))


def report(docs: DataFrame) -> DataFrame:
    """The digest of ``dedup_lines`` for each document."""
    out = dedup_lines(only(docs, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
