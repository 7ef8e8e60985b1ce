"""Clashing column names, empty tables, nulls and very long texts through operators and the pipeline; shingles found anew."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from histframe.llm import decontam, linededup, probminhash, quality_model, quality_rules, tokencount

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, DOC_ID int, _n int, _spans string, _row long, _keep binary, _gone long, gone long, n_words string, n_lines int, Score float, kept_text string, item_ids int, c0 string"


def clashing(spark, rows):
    """Rows (doc_id, text) with columns whose names operators use themselves."""
    full = [(i, t, "en", "s", len(t or ""), "T", 1, 2, "x", 4, b"5", 6, 7, "8", 9, 0.5, "k", 11, "c") for i, t in rows]
    names = [c.strip().split(" ")[0] for c in CLASHING.split(",")]
    numbered = ", ".join(f"x{i} {c.strip().split(' ')[1]}" for i, c in enumerate(CLASHING.split(",")))
    return spark.createDataFrame(full, numbered).toDF(*names)


def by_place(df):
    """Rows as plain tuples, whatever the names."""
    return sorted((tuple(r) for r in df.toDF(*(f"x{i}" for i in range(len(df.columns)))).collect()), key=str)


WORDS = [f"w{i}" for i in range(60)]
ROWS = [(1, " ".join(WORDS)), (2, " ".join(WORDS)), (3, "a line that is long enough\nother words here\n" + " ".join(reversed(WORDS))), (4, "a line that is long enough\nmore"), (5, None), (6, ""), (None, "no id")]


def test_clashing_names_stay(spark):
    docs = clashing(spark, ROWS)
    whole = by_place(docs)
    benchmark = spark.createDataFrame([("b", " ".join(reversed(WORDS)), 1)], "item_id string, text string, N_WORDS int")
    cleaned = decontam.clean(docs, benchmark)
    assert cleaned.columns == docs.columns and by_place(cleaned) == [r for r in whole if r[0] != 3]
    unique = probminhash.dedup(docs)
    assert unique.columns == docs.columns and by_place(unique) == [r for r in whole if r[0] not in (2, 6)]
    fewer = linededup.without_lines(docs, length="n_chars")
    assert fewer.columns == docs.columns
    got = {r[0]: r for r in by_place(fewer)}
    assert got[2][1] == "" and got[2][4] == 0 and got[4][1] == "more" and got[4][5:] == by_place(docs.where("n_chars = 31"))[0][5:]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    good = quality_model.keep_good(docs, labels)
    assert good.columns == docs.columns and set(by_place(good)) <= set(whole)


def test_pipeline_stages_keep_clashing_columns(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({"_row": F.lit(1), "score": F.lit("s"), "kept_text": F.lit("k"), "contaminated": F.lit(1), "c0": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {tuple(r) for r in docs.select("_row", "score", "kept_text", "contaminated", "c0").collect()} == {(1, "s", "k", 1, 0)}


def test_pipeline_on_nulls_and_nothing(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9_000_001, None, None, None, None), (9_000_001, "", "xx", "y", 0), (9_000_002, " \n ", None, None, 3), (None, "text without an id", None, None, None)], docs.schema)
    for k, frame in enumerate((docs.unionByName(odd).unionByName(odd), docs.limit(0))):
        at = frame
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, at, small).write.parquet(str(tmp_path / f"{k}{name}"))
            at = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (at.count() > 0) == (k == 0)
        assert {"doc_id", "token_ids", "n_tokens"} <= set(at.columns)


def test_quality_stage_is_the_classifier_s_verdict(spark, small):
    """The stage against scores of a slow version of the features under the same network."""
    import numpy as np
    from test_long_tokens import slow_features

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, small).collect()}
    w1, b1, w2, b2 = model.layers
    for r in docs.collect():
        x = np.clip((slow_features(r.text or "", model.table) - model.centre) / model.scale, -6, 6)
        z = sum(max(0.0, float(x @ w1[:, j] + b1[j])) * w2[j] for j in range(len(b1))) + b2
        if abs(z) > 0.05:  # what lies on the border may fall to either side
            assert (r.doc_id in kept) == (z > 0), r.doc_id


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    return "\n".join(" ".join(f"{rng.choice(WORDS)}x{rng.randrange(5000)}" for _ in range(40)) for _ in range(6_000))  # some 2 MB


def test_very_long_texts(spark, long_text):
    assert len(long_text) > 1_500_000
    lines = long_text.split("\n")
    again = lines[3000]
    changed = long_text.replace(lines[17], "one line of its own")
    docs = spark.createDataFrame([(1, long_text, "en", "s"), (2, changed, "en", "s"), (3, again + "\nsomething else entirely here", "en", "s"), (4, again.upper(), "en", "s")], "doc_id long, text string, lang string, source string")
    item = " ".join(lines[5000].split()[5:20])
    found = {r.doc_id: r for r in decontam.report(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert [found[i].contaminated for i in (1, 2, 3, 4)] == [True, True, False, False] and found[1].n_hit == 15 and found[1].n_words == 240_000
    dropped = {r.doc_id: r for r in linededup.report(docs).collect()}
    assert [dropped[i].n_dropped for i in (1, 2, 3, 4)] == [0, 5999, 1, 1]
    assert dropped[2].kept_sha256 == hashlib.sha256(b"one line of its own").hexdigest()
    assert {r.doc_id: r.class_id for r in probminhash.report(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}  # 36 of 40 shingles
    measured = {r.doc_id: r for r in quality_rules.report(docs).collect()}
    assert measured[1].n_words == 240_000 and measured[1].word_chars == len(long_text) - long_text.count(" ") - 5_999 and not measured[1].base_failed
    theirs = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    part = long_text[:300_000]
    counted = tokencount.report(spark.createDataFrame([(1, part), (2, long_text)], "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in counted}[1] == len(theirs.encode(part, add_special_tokens=False).ids)


def own_shingles(text, width=5):
    """Shingles as tuples of words with their numbers, without the package's hashing."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    runs = [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    out = {}
    for r in runs:
        out[r] = out.get(r, 0) + 1
    return out


def test_shingles_are_those_of_words():
    rng = random.Random(2)
    texts = ["", "a", "a b c d", "A-b c.D e", "a b a b a b a b a b", *(" ".join(rng.choice(["é", "x", "Y9", "-", "z"]) for _ in range(rng.randint(0, 60))) for _ in range(80))]
    doc, shingle, weight, whole = probminhash.weighted(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert sorted(weight[doc == i].tolist()) == sorted(own_shingles(t).values())
    # equal shingles have equal hashes and others don't, over all texts
    names = {}
    for i, t in enumerate(texts):
        mine = own_shingles(t)
        assert len(mine) == (doc == i).sum()
        for j, u in enumerate(texts[:i]):
            theirs = own_shingles(u)
            common = {*shingle[doc == i].tolist()} & {*shingle[doc == j].tolist()}
            assert len(common) == len({*mine} & {*theirs})
            assert (tuple(whole[i]) == tuple(whole[j])) == (re.findall(r"[^\W_]+", t.lower()) == re.findall(r"[^\W_]+", u.lower()))
        names[t] = i


def own_similarity(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a if d in b)


def test_classes_by_shingles_found_anew(spark):
    rng = random.Random(21)
    rows = []
    for g in range(15):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = [own_shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        return i if top[i] == i else find(top[i])

    for i in range(len(rows)):
        for j in range(i):
            if own_similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    got = {r.doc_id: r.class_id for r in probminhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
