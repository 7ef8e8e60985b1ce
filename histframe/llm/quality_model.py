"""Quality classifier: random-indexing word vectors, pooled, under a calibrated two-layer network.

Random indexing gives every word a sparse index vector of +1 and -1 that its hash
picks, and a context vector, the sum of the index vectors of the words around it in
the training texts. A token counts as two words, its letters in lower case and its
shape (cases, digits and marks, runs shortened), so that unseen tokens still have a
known shape. Longer runs without white space are cut into pieces, each a token, so that
all of a text counts. A document is the mean and spread of its tokens' vectors, with a few
measures of length and repetition. A two-layer network in numpy learns the label from
these; its temperature is set on texts that it was not fitted to.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import numbered, only, pieces, restored, strings, tidy, written

#: Labelled rows that the classifier is fitted to at most: those with the least hashes of their ids.
SAMPLE = 4_000
#: Tasks that look at these rows; each sends one table of SLOTS * DIM floats, the driver gets no texts.
SAMPLE_TASKS = 8
DIM, SLOTS, NEAR = 32, 1 << 14, 2
HIDDEN, EPOCHS, STEP, DECAY = 32, 60, 0.004, 1e-4
EXTRAS = 6
WIDTH = 4 * DIM + EXTRAS
#: The longest token; what is longer counts as several.
PIECE = 40
#: Bytes of text whose tokens are numbered at once, and tokens that are pooled at once.
SLICE, POOLED = 2 << 20, 100_000

_TOKEN = re.compile(rf"\S{{1,{PIECE}}}")
_RUN = re.compile(r"(.)\1+", re.S)
_MARKS = re.compile(r"[^\w\n]+")


class _Shapes(dict):
    """X for capitals, x for other letters, 9 for digits, marks as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return out


_SHAPE = _Shapes()


def tokens(text: str) -> list[str]:
    """The runs of a text without white space, the long ones in pieces."""
    return _TOKEN.findall(text)


def shapes(joined: str) -> str:
    """The shapes of tokens, a line each, runs of one character once."""
    return _RUN.sub(r"\1", joined.translate(_SHAPE))


def _slots(kind: bytes, lines: str) -> np.ndarray:
    return np.array([zlib.crc32(kind + w) % SLOTS for w in lines.encode("utf-8", "surrogatepass").split(b"\n")], np.int64)


def slots(found: list[str]) -> np.ndarray:
    """For each token the slots of its letters in lower case and of its shape; distinct tokens are looked at once."""
    if not found:
        return np.zeros((0, 2), np.int64)
    coded = pa.array(found, pa.large_string()).dictionary_encode()
    joined = "\n".join(coded.dictionary.to_pylist())
    return np.stack([_slots(b"w:", _MARKS.sub("", joined.lower())), _slots(b"s:", shapes(joined))], 1)[coded.indices.to_numpy()]


def index_vectors(seed: int = 7, ones: int = 4) -> np.ndarray:
    """Sparse random vectors, one for each slot."""
    rng = np.random.default_rng(seed)
    out = np.zeros((SLOTS, DIM), np.float32)
    at = rng.permuted(np.tile(np.arange(DIM), (SLOTS, 1)), axis=1)[:, :ones]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (SLOTS, ones)), axis=1)
    return out


def context_sums(ids: np.ndarray, index: np.ndarray, out: np.ndarray, near: int = NEAR) -> None:
    """Adds to each slot's row the index vectors of what stands up to `near` tokens away. Whole numbers: any order gives the same sums."""
    vectors = index[ids[:, 0]] + index[ids[:, 1]]
    around = np.zeros_like(vectors)
    for k in range(1, near + 1):
        around[k:] += vectors[:-k]
        around[:-k] += vectors[k:]
    for c in range(2):
        np.add.at(out, ids[:, c], around)


def context_vectors(sums: np.ndarray) -> np.ndarray:
    """The sums scaled to length 1, plus half of the slot's own index vector."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(norm, 1) + index_vectors() / 2).astype(np.float32)


def _numbered(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slots) of the tokens of some texts, a bounded number of them at a time, rows in order."""
    for a, b in pieces(texts, SLICE):
        if b - a == 1:  # maybe very long
            found = (m[0] for m in _TOKEN.finditer(texts[a].as_py()))
            while some := list(islice(found, POOLED)):
                yield np.full(len(some), a), slots(some)
            continue
        lists = [tokens(t) for t in texts.slice(a, b - a).to_pylist()]
        sizes = np.array(list(map(len, lists)), np.int64)
        ids = slots([t for found in lists for t in found])
        del lists
        upto = np.cumsum(sizes)
        at = 0
        while at < b - a:
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + POOLED, side="right")))
            yield np.repeat(np.arange(a + at, a + to), sizes[at:to]), ids[done : upto[to - 1]]
            at = to


def _moments(doc: np.ndarray, slot: np.ndarray, times: np.ndarray, docs: int, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean and spread of the vectors, the share of distinct ones and the chance that two are the same, from counts sorted by document."""
    share = (times / np.bincount(doc, times, docs)[doc]).astype(np.float32)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    mean, square = np.zeros((docs, DIM), np.float32), np.zeros((docs, DIM), np.float32)
    if len(doc):
        v = table[slot]
        part = share[:, None] * v
        mean[doc[first]] = np.add.reduceat(part, first)
        part *= v
        square[doc[first]] = np.add.reduceat(part, first)
    n = np.maximum(np.bincount(doc, times, docs), 1)
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.bincount(doc, minlength=docs) / n, np.bincount(doc, share * share, docs)


def features(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word and shape vectors, and measures of length and repetition; zeros without tokens."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    kept: tuple[int, list[np.ndarray], int] | None = None  # a long text's counts so far: row, by slot, repeated neighbours

    def put(rows: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], same: np.ndarray) -> None:
        docs = len(rows)
        n = np.bincount(counts[0][0], counts[0][2], docs)
        (m0, s0, d0, c0), (m1, s1, _, c1) = (_moments(*c, docs, table) for c in counts)
        extras = np.stack([np.log1p(n) / 5, d0, c0, c1, same / np.maximum(n - 1, 1), 1 / np.maximum(n, 1)], 1)
        out[rows[n > 0]] = np.concatenate([m0, s0, m1, s1, extras], 1)[n > 0]

    def put_kept() -> None:
        nonlocal kept
        if kept is not None:
            row, sums, same = kept
            put(np.array([row]), [(np.zeros((at := np.flatnonzero(c)).size, np.int64), at, c[at]) for c in sums], np.array([same]))
            kept = None

    last = (-1, -1)  # row and word of the token before
    for doc, ids in _numbered(texts):
        if not len(doc):
            continue
        again = np.r_[(doc[0], ids[0, 0]) == last, (ids[1:, 0] == ids[:-1, 0]) & (doc[1:] == doc[:-1])]
        last = (doc[-1], ids[-1, 0])
        if kept is not None and kept[0] != doc[0]:
            put_kept()
        if doc[0] == doc[-1]:
            sums = [np.bincount(ids[:, c], minlength=SLOTS) for c in range(2)]
            kept = (int(doc[0]), [x + y for x, y in zip(kept[1], sums, strict=True)], kept[2] + int(again.sum())) if kept else (int(doc[0]), sums, int(again.sum()))
            continue
        base = doc[0]
        keys = [np.unique((doc - base) * SLOTS + ids[:, c], return_counts=True) for c in range(2)]
        put(np.arange(base, doc[-1] + 1), [(k // SLOTS, k % SLOTS, t) for k, t in keys], np.bincount(doc - base, again, doc[-1] - base + 1))
    put_kept()
    return out


@dataclass
class Model:
    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, late: np.ndarray, table: np.ndarray, seed: int = 11) -> Model:
    """A network for the rows that aren't late; those only set its temperature. Deterministic for the same rows in the same order."""
    fx, fy = x[~late], y[~late]
    centre, scale = (fx.mean(0), fx.std(0) + 1e-3) if len(fx) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    fx = np.clip((fx - centre) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS if len(fy) else 0):
        rate = STEP * (1 - epoch / EPOCHS)
        order = rng.permutation(len(fy))
        for at in range(0, len(fy), 128):
            b = order[at : at + 128]
            h = fx[b] @ params[0] + params[1]
            a = np.maximum(h, 0)
            d = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -40, 40))) - fy[b]) / len(b)
            back = np.outer(d, params[2]) * (h > 0)
            grads = [fx[b].T @ back + DECAY * params[0], back.sum(0), a.T @ d + DECAY * params[2], d.sum(keepdims=True)]
            step += 1
            for p, g, i, j in zip(params, grads, m, v, strict=True):
                i += 0.1 * (g - i)
                j += 0.001 * (g * g - j)
                p -= rate * (i / (1 - 0.9**step)) / (np.sqrt(j / (1 - 0.999**step)) + 1e-8)
    model = Model(table, centre, scale, (params[0], params[1], params[2], float(params[3][0])), 1.0)
    if late.any():
        z = model.logits(x[late])
        # the loss is convex in the inverse temperature
        inverse = np.geomspace(0.05, 4, 200)
        model.temperature = float(1 / inverse[np.argmin([_loss(z * k, y[late]) for k in inverse])])
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    """A model from at most `most` labelled rows that aren't held out.

    Null ids, labels and texts teach nothing; of an id with several labels the largest
    counts. Without labelled rows the model is untrained and scores 0.5 about. Word
    vectors and weights come from four fifths of the rows, the temperature from the rest.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    # the bound comes first, so that only the chosen rows meet their texts
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(most)
    texts = only(docs, doc_id, text).toDF("i", "t").where("t is not null")
    rows = written(texts.join(F.broadcast(chosen), "i").select("i", "t", "y").distinct().repartition(SAMPLE_TASKS, F.xxhash64("i")), "labelled")
    # every fifth id; too few rows are all fitted to
    late = F.pmod(F.xxhash64("i", F.lit("late")), F.lit(5)) == 4 if rows.limit(10).count() == 10 else F.lit(False)
    rows = rows.withColumn("late", late)
    sums = np.zeros((SLOTS, DIM))
    for r in rows.where("not late").select("t").mapInArrow(_contexts, "sums binary").toLocalIterator():
        sums += np.frombuffer(r.sums, np.float32).reshape(SLOTS, DIM)
    table = context_vectors(sums)
    found = rows.mapInArrow(_measured(docs.sparkSession.sparkContext.broadcast(table)), StructType([rows.schema["i"], rows.schema["y"], rows.schema["late"]]).add("x", "binary")).collect()  # a vector a row
    found.sort(key=lambda r: (zlib.crc32(str(r.i).encode()), str(r.i), r.y, r.x))
    x = np.frombuffer(b"".join(r.x for r in found), np.float32).reshape(len(found), WIDTH).astype(np.float64)
    return fit(x, np.array([r.y for r in found], np.float64), np.array([r.late for r in found], bool), table)


@tidy
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's context sums, as one row."""
    index, out = index_vectors(), np.zeros((SLOTS, DIM), np.float32)
    for batch in batches:
        for doc, ids in _numbered(strings(batch.column(0))):
            for part in np.split(ids, np.flatnonzero(np.diff(doc)) + 1):
                context_sums(part, index, out)
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])


def _measured(table):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(strings(batch.column(1)), table.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([row.tobytes() for row in x], pa.binary())], names=["i", "y", "late", "x"])

    return run


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1, in a last column.

    Scores depend on the text alone: null counts as empty, whole texts are read, very
    long ones a bounded part at a time, and equal texts score alike. Repeated rows stay
    repeated, an empty table stays empty. A column that is named score already (in any
    case) is replaced; all others stay as they are, clashing names among them.
    """
    plain, names = numbered(docs)
    out = _scored(plain, model, names.index(text))
    keep = [i for i, n in enumerate(names) if n.lower() != "score"]
    return restored(out, [names[i] for i in keep] + ["score"], [*keep, len(names)])


def _scored(plain: DataFrame, model: Model, at: int) -> DataFrame:
    """The columns as they are and, last, the score."""
    given = plain.sparkSession.sparkContext.broadcast(model)  # SLOTS * DIM floats: 2 MB

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            x = features(strings(batch.column(at)), m.table).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.scores(x))], names=[*batch.schema.names, "_score"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields]).add("_score", "double"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = scored(only(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns, whatever their names.

    Null and empty texts are judged like any text without words; repeated rows stay or go together.
    """
    plain, names = numbered(docs)
    good = _scored(plain, train(docs, labels), names.index("text")).where("_score >= 0.5")
    return restored(good, names, range(len(names)))
