"""MinHash near-dedup by ProbMinHash: weighted shingles, banding, exact verification.

Each shingle sends a Poisson process of points at the rate of its weight, seeded by its
own hash; a point falls into one of m registers, and a register keeps its earliest
point's shingle. Two texts agree in a register with the probability Jaccard of their
weights. Points come in rounds for all shingles of many texts at once; a shingle
stops as soon as its next point lies behind its text's latest register, so most send
one or two points only.

Copies (equal word sequences) are put together first, by a hash. Among their
representatives, texts that agree in a whole band share a bucket, and links are looked
for in three passes, each verified exactly before the next. First each member meets its
bucket's least one. Then, in buckets that hold several classes, each member meets the
two members of other classes that its registers call nearest, within blocks of bounded
size; that leaves hardly anything to join. Last, every pair of a member outside its
bucket's largest class with a member of another class is estimated, block by block, by
a longer signature, and those near the threshold are verified. So the number of pairs
follows the number of members and not its square, no pair of a bucket that could join
two classes goes unseen, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, Words, mixed, numbered, only, pieces, restored, shingle_hashes, strings, tidy, word_hashes, written

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 24, 6
#: Pairs whose estimate is this many standard deviations below the threshold aren't verified.
MARGIN = 4.0
#: Members of a block, neighbours for each in the second pass, and registers of the longer signature.
GROUP, NEIGHBOURS, LONG = 1024, 2, 1024
#: Bytes of text whose shingles are looked at at once.
SLICE = 1 << 20
#: A bucket with more than one in so many rows is hot; there are no more than so many of them.
HOT = 2048
_U = 1.0 / (1 << 53)


def weighted(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (doc, hash, weight = occurrences) and the hash of each text's words (two columns)."""
    words = Words(texts)
    hashes = word_hashes(words)
    shingle, doc = shingle_hashes(hashes, words.counts, width)
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    weight = np.diff(np.r_[at, len(doc)]).astype(np.float64)
    # the word sequence: sums of hashes that are mixed with their places
    place = (np.arange(len(hashes)) - np.repeat(np.cumsum(words.counts) - words.counts, words.counts)).astype(np.uint64)
    whole = np.zeros((2, len(words.counts)), np.uint64)
    for k, odd in enumerate((np.uint64(_P), np.uint64(0xD6E8FEB86659FD93))):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mixed(hashes ^ mixed(place * odd + np.uint64(k + 1))), out=sums[1:])
        ends = np.cumsum(words.counts)
        whole[k] = mixed(sums[ends] - sums[ends - words.counts] + words.counts.astype(np.uint64))
    return doc[at], shingle[at], weight, whole.T


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """The shingle in each of m registers, for each text; texts without shingles have zeros."""
    earliest = np.full(docs * m, np.inf)
    kept = np.zeros(docs * m, np.uint64)
    time = np.zeros(len(doc))
    at, state, base = np.arange(len(doc)), mixed(shingle + np.uint64(_P)), doc * m
    limit = np.full(docs, np.inf)
    while len(at):
        state = mixed(state + np.uint64(_P))
        time = time - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * _U) / weight[at]
        live = time < limit[doc[at]]
        at, state, time = at[live], state[live], time[live]
        # the register comes from bits of their own, not from those that made the time
        register = base[at] + (mixed(state ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, register, time)
        won = time == earliest[register]
        kept[register[won]] = shingle[at[won]]
        limit = earliest.reshape(docs, m).max(1)
        live = time < limit[doc[at]]
        at, state, time = at[live], state[live], time[live]
    return kept.reshape(docs, m)


def _profile(text: int, width: int, bands: int, rows: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(text))
            for a, b in pieces(texts, SLICE):
                doc, shingle, weight, whole = weighted(texts.slice(a, b - a), width)
                kept = signatures(doc, shingle, weight, b - a, bands * rows)
                some = np.bincount(doc, minlength=b - a) > 0
                band = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], b - a, 0)
                for r in range(rows):
                    band = mixed(band * np.uint64(_P) + kept.reshape(b - a, bands, rows)[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands), pa.int32()), pa.array(band.view(np.int64).ravel()))
                low = np.ascontiguousarray(kept.astype(np.uint8))  # a byte of each register is enough to estimate
                sig = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, low.size + 1, bands * rows, dtype=np.int32)), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(whole[:, 0].copy().view(np.int64)), pa.array(whole[:, 1].copy().view(np.int64)), pa.array(some), lists, sig], names=["doc", "k1", "k2", "some", "bands", "sig"])

    return run


def _shingles(width: int):
    """(doc, shingles, weights) of each text, sorted by shingle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in pieces(texts, SLICE):
                doc, shingle, weight, _ = weighted(texts.slice(a, b - a), width)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=b - a))], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (shingle.view(np.int64), weight.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["doc", "sh", "w"])

    return run


def similarity(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """Probability Jaccard of sorted shingles with their weights."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = u[i].astype(float), v[j].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    rest_a, rest_b = u.sum() - x.sum(), v.sum() - y.sum()
    t = y / x
    # ties in t take either side alike, so plain prefix sums do
    ca, cb = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1.0 / ((rest_a + ca) / x + (rest_b + cb) / y)).sum()) if len(t) else 0.0


def _verify(least: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in range(2))
            sides = []
            for c in (2, 3, 4, 5):
                column = batch.column(c)
                ends = column.offsets.to_numpy()
                values = column.values.to_numpy()
                sides.append([values[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)])
            score = np.array([similarity(*x) for x in zip(*sides, strict=True)])
            ok = score >= least - 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(score[ok])], names=["a", "b", "similarity"])

    return run


def components(links: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    """(doc, class) for every node: the least node that links lead to.

    Large stars and small stars by turns: each round links the neighbours of a node to
    their least one, so that chains shorten by more than half; written each round. It
    ends when the links are stars already: each lesser end a centre, each greater end
    the leaf of one centre.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", scope)
    while True:
        ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("a").alias("v"), F.lit(None).cast("int").alias("leaf")).distinct())
        mixed_ends = ends.groupBy("v").agg(F.count("*").alias("n"), F.count("leaf").alias("leaf")).where("leaf > 0 and n > 1")
        if mixed_ends.isEmpty():
            break
        for larger in (True, False):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.join(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")
            if larger:
                moved = near.where("b > a").select(F.col("m").alias("a"), "b")
            else:
                moved = near.where("b < a").select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b")
            edges = moved.where("a < b").distinct()
        edges = written(edges, "edges", scope)
    return nodes.join(edges.select(F.col("b").alias("doc"), F.col("a").alias("class")), "doc", "left").select("doc", F.coalesce("class", "doc").alias("class"))


def _sigs(column: pa.Array) -> np.ndarray:
    width = len(column[0].as_buffer()) if len(column) else 1
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _cut(least: float, m: int) -> float:
    """The least share of equal register bytes; bytes of unequal registers agree once in 256."""
    return max(0.0, least - MARGIN * (least * (1 - least) / m) ** 0.5)


def _estimated(least: float):
    """The pairs (a, b, sa, sb) whose registers come near the threshold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sigs(batch.column(2)), _sigs(batch.column(3))
            ok = (x == y).mean(1) >= _cut(least, x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Columns of each run of rows with one value in the first column; signatures as byte tables."""
    held, last = [], None

    def whole(parts: list) -> tuple:
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_sigs(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and key[i] != last:
                yield whole(held)
                held = []
            last = key[i]
            held.append([c[i:j] for c in columns])
    if held:
        yield whole(held)


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])


def _nearest(least: float):
    """Of (group, doc, class, sig): each member with its nearest ones of other classes, if they come near the threshold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc, kind, sig in _by_group(batches):
            for i in range(0, len(doc), 64):  # in strips, so that memory follows a strip and not the square
                share = (sig[i : i + 64, None] == sig[None]).mean(2)
                share[kind[i : i + 64, None] == kind[None]] = -1
                best = np.argsort(-share, axis=1, kind="stable")[:, :NEIGHBOURS]
                u, k = np.nonzero(np.take_along_axis(share, best, 1) >= _cut(least, sig.shape[1]))
                yield _pairs(doc[i + u], doc[best[u, k]])

    return run


def _outside(least: float):
    """Of (group, doc, class, outside, sig, long): pairs of an outsider and a member of another class that come near the threshold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc, kind, out, sig, long in _by_group(batches):
            a, b = np.flatnonzero(out), np.flatnonzero(~out)
            for i in range(0, len(a), 64):
                s = a[i : i + 64]
                near = (sig[s, None] == sig[None, b]).mean(2) >= _cut(least, sig.shape[1])
                u, v = np.nonzero(near & (kind[s, None] != kind[None, b]))
                for k in range(0, len(u), 4096):
                    x, y = s[u[k : k + 4096]], b[v[k : k + 4096]]
                    ok = (long[x] == long[y]).mean(1) >= _cut(least, long.shape[1])
                    yield _pairs(doc[x[ok]], doc[y[ok]])

    return run


def _long(m: int):
    """(doc, long): a byte of each of m registers, from shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                n = part.num_rows
                doc = np.repeat(np.arange(n), pc.list_value_length(part.column(1)).to_numpy())
                shingle, weight = part.column(1).flatten().to_numpy().view(np.uint64), part.column(2).flatten().to_numpy().astype(np.float64)
                low = np.ascontiguousarray(signatures(doc, shingle, weight, n, m).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in low], pa.binary())], names=["doc", "long"])

    return run


def _by_bucket(rows: DataFrame, about: DataFrame) -> DataFrame:
    """rows joined with a row about each bucket that holds n of them; hot buckets stay where they are."""
    least = (about.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(about.where(F.col("n") > least))  # fewer than HOT rows
    rest = rows.join(hot.select("bucket"), "bucket", "left_anti").join(about.where(F.col("n") <= least), "bucket")
    return rows.join(hot, "bucket").unionByName(rest)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, scope: str = "session") -> DataFrame:
    """(doc, copy_of, class_id): copy_of is the least id with the same words, class_id the least id of its class.

    A class holds what links of probability Jaccard >= `least` connect; weights are
    occurrences of shingles of `width` words, or of the whole text if it has fewer
    words. Texts without words (null, empty) are copies of each other and resemble
    nothing else. Rows with the same id count as one node, a null id gets no row, an
    empty table none at all; other columns of `docs` don't matter, whatever their names.
    Of a very long text its words and shingles are held, some 100 bytes for each word.
    With `bands` and `rows` as they are a pair at 0.8 shares a bucket with probability
    0.999, at 0.85 0.99999, and MARGIN loses 3 of 100,000 pairs at 0.8.
    """
    texts = only(docs, doc_id, text).toDF("doc", "text").withColumn("doc", F.col("doc").cast("long")).where("doc is not null")
    seen = written(texts.mapInArrow(_profile(1, width, bands, rows), "doc long, k1 long, k2 long, some boolean, bands array<long>, sig binary"), "profiles", scope)
    # copies: the least id of each word sequence; partial sums, so that a hot one is no hot task
    least_ids = written(seen.groupBy("k1", "k2").agg(F.min("doc").alias("doc")), "leasts", scope)
    members = seen.select("doc", "k1", "k2").join(least_ids.withColumnRenamed("doc", "copy_of"), ["k1", "k2"]).select("doc", "copy_of").distinct()
    first = written(seen.where("some").join(least_ids, ["doc", "k1", "k2"]).dropDuplicates(["doc", "k1", "k2"]), "firsts", scope)
    buckets = first.select("doc", F.explode("bands").alias("bucket")).distinct()
    shared = written(buckets.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "shared", scope)
    inside = written(_by_bucket(buckets, shared).select("bucket", "doc", "pivot"), "buckets", scope)
    nodes = inside.select("doc").distinct()
    own = written(first.select("doc", "sig").join(nodes, "doc"), "nodes", scope)
    shingles = written(texts.join(nodes, "doc", "left_semi").mapInArrow(_shingles(width), "doc long, sh array<long>, w array<int>").dropDuplicates(["doc"]), "shingles", scope)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs", scope)
        need = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        held = shingles.join(need, "doc", "left_semi")
        left = held.select(F.col("doc").alias("a"), F.col("sh").alias("sa"), F.col("w").alias("wa"))
        right = held.select(F.col("doc").alias("b"), F.col("sh").alias("sb"), F.col("w").alias("wb"))
        sides = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb")
        return written(sides.mapInArrow(_verify(least), "a long, b long, similarity double"), "links", scope)

    def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
        """classes after more links, which connect classes and not documents anew."""
        ends = links.join(classes.select(F.col("doc").alias("a"), F.col("class").alias("ca")), "a").join(classes.select(F.col("doc").alias("b"), F.col("class").alias("cb")), "b")
        top = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), classes.select(F.col("class").alias("doc")).distinct(), scope)
        return written(classes.join(top.select(F.col("doc").alias("class"), F.col("class").alias("top")), "class").select("doc", F.col("top").alias("class")), "classes", scope)

    def open_buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(bucket, doc, class) of the buckets with several classes, and about each of these n, main, its largest class, and others, the members outside."""
        held = inside.select("bucket", "doc").join(classes, "doc")
        sizes = held.groupBy("bucket", "class").agg(F.count("*").alias("k"))
        about = sizes.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "class")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
        return held, written(about.select("bucket", "n", F.col("top.class").alias("main"), (F.col("n") - F.col("top.k")).alias("others")), "open", scope)

    stars = inside.where("doc > pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    sided = stars.join(own.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(own.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    classes = written(components(verified(sided.mapInArrow(_estimated(least), "a long, b long")), nodes, scope), "classes", scope)

    block = lambda: F.expr(f"pmod(xxhash64(doc), cast(ceil(n / {GROUP}) as bigint))")
    held, about = open_buckets(classes)
    groups = _by_bucket(held, about.select("bucket", "n")).withColumn("g", F.xxhash64("bucket", block())).join(own, "doc").select("g", "doc", "class", "sig")
    near = groups.repartition("g").sortWithinPartitions("g").mapInArrow(_nearest(least), "a long, b long").distinct()
    classes = joined(classes, verified(near))

    held = _by_bucket(*open_buckets(classes))
    many, few = F.ceil(F.col("n") / GROUP).cast("long"), F.ceil(F.col("others") / GROUP).cast("long")
    # outsiders meet every block of members, members every block of outsiders
    out = held.where("class != main").select("bucket", "doc", "class", F.lit(True).alias("outside"), F.pmod(F.xxhash64("doc"), few).alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("m"))
    all_ = held.select("bucket", "doc", "class", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0).cast("long"), few - 1)).alias("o"), F.pmod(F.xxhash64("doc"), many).alias("m"))
    both = out.unionByName(all_).select(F.xxhash64("bucket", "o", "m").alias("g"), "doc", "class", "outside")
    long = written(shingles.join(held.select("doc").distinct(), "doc", "left_semi").mapInArrow(_long(LONG), "doc long, long binary"), "long", scope)
    groups = both.join(own, "doc").join(long, "doc").select("g", "doc", "class", "outside", "sig", "long")
    rest = groups.repartition("g").sortWithinPartitions("g").mapInArrow(_outside(least), "a long, b long").distinct()
    classes = joined(classes, verified(rest))
    return members.join(classes.select(F.col("doc").alias("copy_of"), F.col("class").alias("class_id")), "copy_of", "left").select("doc", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of, class_id and is_kept (the one document of its class that stays)."""
    return near_duplicates(docs).select(F.col("doc").alias("doc_id"), "copy_of", "class_id", (F.col("doc") == F.col("class_id")).alias("is_kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "session") -> DataFrame:
    """docs without near copies, with their own columns, whatever their names.

    Of each class the document with the least id stays, and so does one of all texts
    without words; rows without an id stay, and repeated rows stay or go together.
    """
    plain, names = numbered(docs)
    gone = near_duplicates(docs, doc_id, text, scope=scope).where("doc != class_id").select(F.col("doc").alias("gone"))
    left = plain.join(gone, F.col(f"c{names.index(doc_id)}").cast("long") == F.col("gone"), "left_anti")
    return restored(left, names, range(len(names)))
