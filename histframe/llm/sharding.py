"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

The order of records is that of (hash of the text, id), so equal texts stand together.
A sample that takes each record with a probability in proportion to its size gives
splitters at its quantiles; the ranges between them are counted exactly, and those
that are overfull are sampled again and subdivided, also inside one hash. Every range
then knows how many bytes and rows come before it, so that a record's place in the
whole order, and with it its shard and slot, needs a window over its own range only.

Everything on the main path is a DataFrame or SQL function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

SHARDS = 8
#: Rows that a range aims at, the fewest and the most ranges, samples for each, and rounds of subdivision.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLES, ROUNDS = 500_000, 64, 2048, 48, 4
#: A range above this many times the mean of bytes or rows is overfull.
OVERFULL = 2.0


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key): size is the UTF-8 bytes of the text plus 1; a null text counts as empty.

    key is the text's MD5 and the id, the latter as twenty digits that sort like it.
    """
    t = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    place = F.expr("lpad(cast(cast(coalesce(doc_id, -9223372036854775808L) as decimal(20, 0)) + 9223372036854775808BD as string), 20, '0')")
    return t.select("doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.concat(F.md5("t"), place).alias("key"))


def _range(cuts: list[str]) -> Column:
    """How many cuts are not after a record's key: a binary search over a constant array."""
    steps = len(cuts).bit_length()
    if not steps:
        return F.lit(0)
    held = F.array(*(F.lit(c) for c in [*cuts, *["g"] * ((1 << steps) - 1 - len(cuts))]))  # no key comes after "g"
    jumps = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get(held, at + jump - 1) <= F.col("key"), at + jump).otherwise(at))


def splitters(rows: DataFrame, total: int, ranges: int, seed: int) -> list[str]:
    """Boundaries at the quantiles of a size-weighted sample: about ranges * SAMPLES keys, whatever the input holds."""
    want = ranges * SAMPLES
    # a record of size s is drawn with probability want * s / total
    chance = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30)) < (F.col("size").cast("double") * want / total)
    # the rate bounds the sample's size, and only its quantiles come to the driver
    drawn = rows.where(chance).select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("t"))
    return sorted({r.key for r in drawn.groupBy("t").agg(F.min("key").alias("key")).where("t > 1").collect()})


def assigned(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is `bytes`: in the order of (hash of the text, id) a record goes to the
    shard in which the middle of its bytes falls, so shards differ by about one
    record's size. slot counts from 0 in that order. Repeated rows stand side by side.
    A null id stands first among equal texts. An empty table gives no rows.
    """
    rows = written(keyed(docs, doc_id, text), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    cuts = splitters(rows, total, ranges, 0) if n else []
    for seed in range(1, ROUNDS + 1):
        spread = rows.groupBy(_range(cuts).alias("range")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        over = [r for r in spread.collect() if max(r.bytes / total, r.n / n) * ranges > OVERFULL]  # a row a range
        more = set(cuts)
        for r in over:
            pieces = math.ceil(max(r.bytes / total, r.n / n) * ranges)
            more.update(splitters(rows.where(_range(cuts) == r.range), r.bytes, pieces, seed))
        if len(more) == len(cuts):
            break  # nothing is overfull, or only by a single record
        cuts = sorted(more)
    rows = rows.withColumn("range", _range(cuts))
    sums = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("range").orderBy("key")
    placed = rows.withColumns({"i": F.row_number().over(inside), "b": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(offsets), "range")
    # 2 * (b0 + b) - size is twice the place of the record's middle byte
    shard = F.least(F.expr(f"cast((cast(2 * (b0 + b) - size as decimal(38, 0)) * {shards}) div {2 * total}BD as int)"), F.lit(shards - 1))
    placed = written(placed.select("doc_id", "size", "text_crc32", (F.col("n0") + F.col("i") - 1).alias("at"), shard.alias("shard")), "shards")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def report(docs: DataFrame) -> DataFrame:
    return assigned(docs)
