"""Tokenizers against their libraries, models on rows they haven't seen, near-dedup against all pairs, the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from histframe.llm import bpe, probminhash, quality_model, queries, secrets, tokencount
from histframe.llm.common import Memo, strings

AWKWARD = [None, "", " ", "\n\n", "  two  spaces\n\n x ", "a" * 3000, "ab" * 700, "é́ 日本語 😀😀 \x1c \x85", "it's I'LL 'Re <|endoftext|><|startoftext|>x<|END", "ΣΊΣΥΦΟΣ İI", "tail "]
PATH = P.path("byte_bpe_50k.tiktoken")


def noise(n, seed=1):
    rng = random.Random(seed)
    alpha = "ab cdeéÉΣİ\n\t'st1<|>\x1c\x85 　日本字😀éTHE.re  lv"
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 70))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_library_s(library):
    mine = bpe.encoder(PATH, P.PATTERN)
    for t in noise(3000) + [t or "" for t in AWKWARD]:
        ids = mine.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert mine.decode(ids) == t.encode()


def test_shared_and_own_queues_agree(library):
    mine = bpe.encoder(PATH, P.PATTERN)
    rng = random.Random(2)
    given = [bytes(rng.choice(b"abcth er\xc3\xa9") for _ in range(rng.randint(2, 200))) for _ in range(300)] + [b"a" * 240]
    raw = np.frombuffer(b"".join(given), np.uint8)
    ids, ends = mine.together(raw, np.cumsum([0, *map(len, given)]))
    for i, g in enumerate(given):
        assert ids[ends[i] : ends[i + 1]].tolist() == mine.piece(g)
    assert not mine.queue.top and not any(mine.queue.low) and not mine.queue.buckets


def test_texts_are_encoded_the_same_together_and_apart(library, monkeypatch):
    mine = bpe.encoder(PATH, P.PATTERN)
    texts = noise(500, 8) + [t or "" for t in AWKWARD] + ["s x", "don' ", "x\n 's", " 's don't  'll", "  x"]
    ids, ends = mine.encode_slice(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "SLICE", 5)
    for t in texts:
        parts = list(bpe._parts(t))
        assert "".join(parts) == t and [i for p in parts for i in mine.encode(p)] == library.encode_ordinary(t)


def test_very_long_texts(spark, library):
    words = ["the ", "Ωmega", " x9 ", "\n\n", "straße ", "zq"]
    rng = random.Random(6)
    texts = ["".join(rng.choice(words) for _ in range(1_500_000)), "ab" * 500_000]
    got = {r.doc_id: r for r in bpe.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts[:1]):
        ids = library.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert [got[i].decoded_sha256 for i in range(2)] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_rank_queue_pops_in_order():
    q, rng = bpe.RankQueue(70_000), random.Random(3)
    given = [(rng.randrange(70_000), i) for i in range(2000)] + [(5, 9), (5, 3)]
    for x in given:
        q.push(*x)
    assert [q.pop() for _ in given] == sorted(given) and q.pop() is None


def test_memo_is_bounded():
    m = Memo(len, 10, 5)
    assert [m[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)]
    assert len(m) <= 10 and len(m.old) <= 10 and m["x" * 50] == 50 and "x" * 50 not in m


def test_encoded_frame(spark, library):
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(AWKWARD)] + [(1, "", 2)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.report(frame, PATH, P.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in enumerate(AWKWARD)}
    assert got == want
    assert bpe.report(frame.limit(0), PATH, P.PATTERN).collect() == []


def test_counts_are_the_library_s(spark):
    mine, theirs = tokencount.counter(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = noise(3000, 5) + [t or "" for t in AWKWARD]
    want = [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert mine.texts(pa.array(texts, pa.large_string())).tolist() == want
    assert [mine.count(t) for t in texts] == want
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(AWKWARD)] + [(0, None, 0)], "doc_id long, text string, n_bytes int")
    got = tokencount.report(frame, P.path("word_bpe_49k.json"), 20).collect()
    assert {tuple(r) for r in got} == {(i, len((t or "").encode()), n, n > 20) for i, (t, n) in enumerate(zip(AWKWARD, want[3000:], strict=True))}
    assert len(got) == len(AWKWARD) + 1


def test_chunk_maps_compose():
    c = tokencount.counter(P.path("word_bpe_49k.json"))
    rng, tr = random.Random(9), c.transducer
    for k in range(200):
        raw = "".join(rng.choice("theranionéß") for _ in range(rng.randint(1, 90))).encode()
        want = tr.count(raw)
        assert all(tr.count(raw, chunk, before) == want for chunk in (1, 3, 10) for before in (0, 1, 8)), raw
        cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
        a, b, d = (tokencount.StateMap(tr, raw[i:j], tr.content[tr.START]) for i, j in zip([0, *cuts], [*cuts, len(raw)], strict=True))
        other = tr.content[tr.through(tr.START, raw[:k % 7])[0]]
        for state in (tr.content[tr.START], other):
            assert a.then(b).then(d).at(state) == a.then(b.then(d)).at(state) == tokencount.StateMap(tr, raw, state).at(state)


def test_full_states_are_forgotten(monkeypatch):
    c = tokencount.counter(P.path("word_bpe_49k.json"))
    text = "".join(random.Random(4).choice("qwertyuiopasdfgé") for _ in range(5000))
    want = len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(c.transducer, "MOST", 50)
    assert c.transducer.count(text.encode(), 100, 16) == want


def test_text_without_white_space_takes_linear_memory():
    c, theirs = tokencount.counter(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    part = "".join(random.Random(12).choice("theranionstqq") for _ in range(50_000))
    assert c.count(part * 4) == len(theirs.encode(part * 4, add_special_tokens=False).ids)
    peaks = []
    for times in (20, 80):  # 1 and 4 million letters
        c.count(part * 2)
        tracemalloc.start()
        c.count(part * times)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 16 * 80 * len(part)
    marks = "9,9;" * 300_000
    assert c.count(marks) == 1_200_000


def test_transducer_states_are_few():
    c = tokencount.counter(P.path("word_bpe_49k.json"))
    c.transducer.restart()
    c.transducer.count(b"ha" * 2000)
    assert len(c.transducer.content) < 200  # a cycle, not a state for each byte


def test_forest_on_unseen_findings():
    forest = secrets.train(secrets.sample_findings(1500, seed=1), trees=15)
    unseen = secrets.sample_findings(800, seed=2)
    score = forest.scores(np.array([secrets.measured(f) for f, _ in unseen]))
    assert np.mean((score >= 0.5) == np.array([y for _, y in unseen])) > 0.95
    slow = [np.mean([_walk(t, secrets.measured(f)) for t in forest.nodes]) for f, _ in unseen[:50]]
    assert np.allclose(slow, score[:50])


def _walk(tree, x):
    f, t, lo, hi, share = tree
    i = 0
    while f[i] >= 0:
        i = lo[i] if x[f[i]] <= t[i] else hi[i]
    return share[i]


def test_scan(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f'the é token = "{key}" end', 'token = "your_token_here_please"', f"commit {key}", None, "", "plain words only", "AKIA" + "Q7RTZ2MXWP4LK9AB", "x" * 100_000]
    frame = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)] + [(0, texts[0], "src", 1)], "doc_id long, text string, source string, score int")
    got = secrets.report(frame).collect()
    assert {r.doc_id for r in got if r.is_secret} == {0, 6}
    for r in got:
        assert r.value_sha256 == hashlib.sha256(texts[r.doc_id][r.first : r.last].encode()).hexdigest()
    want = [(i, c.rule, c.start, c.end) for i, t in [*enumerate(texts), (0, texts[0])] for c in secrets.candidates(t or "")]
    assert sorted((r.doc_id, r.rule, r.first, r.last) for r in got) == sorted(want)
    assert secrets.report(frame.limit(0)).collect() == []


def test_classifier_on_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.report(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    unseen = [r for r in got if r.held_out]
    good, bad = ([r.score for r in unseen if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.5 for g in good]) > 0.97


def test_classifier_on_awkward_rows(spark):
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(AWKWARD)] + [(None, "x", 0.0), (3, "again", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (None, 1), (5, None), (77, 0)], "doc_id long, quality int")
    got = quality_model.report(frame, labels).collect()
    assert len(got) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1
    assert quality_model.report(frame.limit(0), labels.limit(0)).collect() == []


def near_texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        texts.append(" ".join(base).upper())
    chain = [word() for _ in range(120)]
    for _ in range(10):  # a chain: neighbours are alike, the ends aren't
        chain = [*chain[3:], word(), word(), word()]
        texts.append(" ".join(chain))
    return texts


def exact_weights(text):
    docs, shingle, weight, _ = probminhash.weighted(strings(pa.array([text], pa.string())))
    return dict(zip(shingle.tolist(), weight.tolist(), strict=True))


def slow_similarity(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in a if d in b)


def brute_classes(rows, least=0.8):
    sets = [exact_weights(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or not sets[i] and not sets[j] or sets[i] and sets[j] and len({*sets[i]} & {*sets[j]}) > 0 and slow_similarity(sets[i], sets[j]) >= least - 1e-12:
                top[find(i)] = find(j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), d), d)
    return {d: least_id[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_duplicates(spark):
    texts = near_texts() + [None, "", "!", "a b", "A, b", "a b c", "one", "one two three four five six " * 3]
    rng = random.Random(2)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    frame = spark.createDataFrame([(*r, 0) for r in [*rows, rows[3], (None, texts[0])]], "doc_id long, text string, class_id int").repartition(4)
    got = {r.doc_id: r.class_id for r in probminhash.report(frame).collect()}
    assert got == brute_classes(rows)
    kept = probminhash.dedup(frame).collect()
    assert {r.doc_id for r in kept} == {*got.values(), None}
    assert probminhash.report(frame.limit(0)).collect() == []


def test_shared_passages_are_split(spark, monkeypatch):
    """Texts that share most of their words but aren't near copies, with a few that are: buckets split by other bands."""
    monkeypatch.setattr(probminhash, "GROUP", 6)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(60):
        tail = [f"t{i}x{k}" for k in range(40)]
        rows.append((i, " ".join(passage + tail)))
        if i % 10 == 0:
            tail[rng.randrange(40)] = "changed"
            rows.append((1000 + i, " ".join(passage + tail)))
    got = {r.doc_id: r.class_id for r in probminhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_group_of_near_copies_costs_a_pair_each(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = probminhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(7)
    a = [f"w{rng.randrange(400)}" for _ in range(900)]
    b = a[:600] + [f"v{i}" for i in range(250)]
    texts = strings(pa.array([" ".join(a), " ".join(b), "", "x"]))
    doc, shingle, weight, _ = probminhash.weighted(texts, 1)
    kept = probminhash.signatures(doc, shingle, weight, 4, 4096)
    wa, wb = ({int(s): w for s, w, d in zip(shingle, weight, doc, strict=True) if d == k} for k in (0, 1))
    true = slow_similarity(wa, wb)
    side = lambda w: (np.array(sorted(w), np.uint64).view(np.int64), np.array([w[k] for k in sorted(w)]))
    assert abs(probminhash.similarity(*side(wa), *side(wb)) - true) < 1e-9
    assert abs((kept[0] == kept[1]).mean() - true) < 0.03
    assert not kept[2].any() and len({*kept[3].tolist()}) == 1


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, small).write.parquet(out := str(tmp_path / name))
        docs = spark.read.parquet(out)
        after = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        if name == "near_dedup":
            classes = brute_classes([r[:2] for r in before])
            assert set(after) == set(classes.values())
        if name == "decontamination":
            from test_text import brute_contamination

            items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {x[0] for x in brute_contamination(before, items) if not x[5]}
        if name == "line_dedup":
            from test_text import brute_lines

            assert {(i, hashlib.sha256(r.text.encode()).hexdigest()) for i, r in after.items()} == {(x[0], x[3]) for x in brute_lines(before)}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "byte_bpe":
            mine = bpe.encoder(PATH, P.PATTERN)
            assert {i: r.token_ids for i, r in after.items()} == {r[0]: mine.encode(r[1] or "") for r in before}
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).select("doc_id").collect()} == set(after)


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
