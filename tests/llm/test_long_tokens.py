"""Texts without white space count to their end in the classifier."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from histframe.llm import quality_model


def test_pieces_hold_every_character():
    text = "short " + "字" * 95 + "\n" + "a" * 40 + " " + "b" * 41
    assert [len(p) for p in quality_model.tokens(text)] == [5, 40, 40, 15, 40, 40, 1]
    assert "".join(quality_model.tokens(text)) == "".join(text.split())


def test_unspaced_texts_differ_behind_their_start(spark):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["house", "river", "walks", "slowly", "green", "Monday"], 30)) for _ in range(40)]
    bad = [" ".join(rng.choice(["%%#", "0x7f", "}}{{", "buy!!1", "AAAA9"], 30)) for _ in range(40)]
    start = "thequickbrownfoxjumpsoverthelazydogtwice"
    texts = [*good, *bad, start + "andrunshomebytheriver" * 40, start + "}{0x7F%%#9!" * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_model.report(docs, labels).collect()}
    assert len(start) == 40 and scores[80] != scores[81]


def slow_features(text, table):
    """Token by token, without slices and without counting distinct ones together."""
    found = [w[i : i + 40] for w in text.split() for i in range(0, len(w), 40)]
    if not found:
        return np.zeros(quality_model.WIDTH)

    def slot(kind, word):
        return zlib.crc32(f"{kind}:{word}".encode()) % quality_model.SLOTS

    shape = lambda t: "".join(c for c, _ in itertools.groupby("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in t))
    word = [slot("w", re.sub(r"[^\w]+", "", t.lower())) for t in found]
    form = [slot("s", shape(t)) for t in found]
    n, out, kinds = len(found), [], []
    for ids in (word, form):
        v = table[ids].astype(float)
        out += [v.mean(0), np.sqrt(np.maximum((v * v).mean(0) - v.mean(0) ** 2, 0))]
        kinds.append(Counter(ids))
    chance = [sum((k / n) ** 2 for k in c.values()) for c in kinds]
    same = sum(a == b for a, b in itertools.pairwise(word)) / max(1, n - 1)
    return np.concatenate([*out, [np.log1p(n) / 5, len(kinds[0]) / n, *chance, same, 1 / n]])


def test_features_are_those_of_a_slow_version(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["a", "Ab", "été", "x9-", "字" * 50, "--", "ΣΑΣ", "don't", "123", "\n", "  ", "İx"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)] + ["", " ", "x" * 500, "the " * 400]
    table = quality_model.context_vectors(np.zeros((quality_model.SLOTS, quality_model.DIM)))
    want = np.array([slow_features(t, table) for t in texts])
    column = pa.array(texts, pa.large_string())
    assert np.allclose(quality_model.features(column, table), want, atol=2e-4)
    monkeypatch.setattr(quality_model, "SLICE", 100), monkeypatch.setattr(quality_model, "POOLED", 7)
    assert np.allclose(quality_model.features(column, table), want, atol=2e-4)
    monkeypatch.setattr(quality_model, "SLICE", 1)
    assert np.allclose(quality_model.features(column, table), want, atol=2e-4)


def test_context_sums_are_those_of_a_slow_version():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 30, (50, 2))
    index = quality_model.index_vectors()
    got = np.zeros((quality_model.SLOTS, quality_model.DIM))
    quality_model.context_sums(ids, index, got)
    want = np.zeros_like(got)
    for i in range(50):
        for j in range(max(0, i - 2), min(50, i + 3)):
            if i != j:
                for c in range(2):
                    want[ids[i, c]] += index[ids[j, 0]] + index[ids[j, 1]]
    assert (got == want).all()


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(i, "some words here", "a", 0.5, 7) for i in range(4)], "doc_id long, text string, TEXT string, Score double, _score int")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    scored = quality_model.scored(docs, quality_model.train(docs, labels))
    assert scored.columns == ["doc_id", "text", "TEXT", "_score", "score"] and {r[4] for r in scored.collect()} != {0.5}
