"""Decontamination, line dedup, rules, sharding and archives, against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from histframe.llm import decontam, linededup, quality_rules, sharding, warc
from histframe.llm.common import Words, pieces, shingle_hashes, strings, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(UP))


def rows_of(texts):
    return [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]


AWKWARD = [None, "", " ", "\n", "\n\n a \n", "one", "One two THREE\x00four", "é É ß 日本 x1", "a" * 5000, "word " * 3000, "  Repeated line here \nother\nrepeated line HERE\n", "repeated line here", "tiny\ntiny", "\x1c odd \x85 blank\x0b"]


def test_words_match_the_pattern():
    texts = strings(pa.array([*AWKWARD, "A-b.c", "!", "x"]))
    w = Words(texts)
    got = defaultdict(list)
    for d, s, e in zip(w.doc, w.start, w.end, strict=True):
        got[d].append(w.buf[s:e].tobytes().decode())
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts.to_pylist()]
    assert w.counts.tolist() == [len(words(t)) for t in texts.to_pylist()]
    assert [x for a, b in pieces(texts, 100) for x in range(a, b)] == list(range(len(texts)))


def test_equal_words_have_equal_hashes():
    texts = strings(pa.array(["a b c a b c d", "c a b", "", "b"]))
    w = Words(texts)
    h = word_hashes(w)
    by = defaultdict(set)
    for s, e, x in zip(w.start, w.end, h, strict=True):
        by[w.buf[s:e].tobytes()].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    shingles, doc = shingle_hashes(h, w.counts, 3)
    assert doc.tolist() == [0] * 5 + [1] + [3]
    assert shingles[2] == shingles[5] and shingles[0] == shingles[3]  # c a b, a b c


def brute_contamination(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    for row in docs:
        w = words(row[1])
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= of
        yield row[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_contamination(spark, block):
    rng = random.Random(3)
    some = ["the", "of", "a", "xy", "é", "long" * 6, "b", "thing"]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 16)))) for i in range(25)] + [(None, "single"), (77, None), (5, "Dup item text"), (5, "dup item text")]
    docs = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [f"pad, {t}! tail" for _, t in items if t] + ["x" + items[0][1], *AWKWARD]
    rows = rows_of(docs)
    rows.append(rows[3])
    frame = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame, bench, block_bytes=block)
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in found.collect())
    assert got == sorted(brute_contamination(rows, items))
    assert {r.doc_id for r in decontam.clean(frame, bench).collect()} == {x[0] for x in got if not x[5]}
    assert decontam.clean(frame, bench).columns == frame.columns


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame(rows_of(AWKWARD), DOCS)
    assert {r.contaminated for r in decontam.report(frame, bench).collect()} == {False}
    assert decontam.report(frame.limit(0), bench).collect() == []


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(UP)
    first = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(k := key(x)) >= 10 and i is not None:
                first[k] = min(first.get(k, i), i)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = ["A common line here", "  a COMMON line here\r", "short", "ééééééééé", "éééééééééé", "unique enough 1", "another shared line", ""]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["a common line here"] * 200 + AWKWARD
    rows = rows_of(texts)
    rng.shuffle(rows)
    rows += [rows[0], rows[0], (None, "a common line here\nx", None, None, 1), (rows[5][0], "a common line here\nsecond text of one id", None, None, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", keep string").repartition(5)
    got = sorted(map(tuple, linededup.report(frame).collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)
    assert linededup.report(frame.limit(0)).collect() == []


def test_clashing_columns(spark):
    """Columns that are called like outputs or like inputs in other letters do no harm."""
    frame = spark.createDataFrame([(1, "a common line", "k", "d", 2), (2, "a common line", "k", "d", 2)], "doc_id long, text string, keep string, doc string, n_dropped int")
    assert sorted((r.doc_id, r.keep, r.doc, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(frame).collect()) == [(1, "k", "d", 0, "a common line"), (2, "k", "d", 1, "")]
    twice = frame.select("doc_id", "text", frame["keep"].alias("TEXT"), frame["doc"].alias("Doc_Id"))
    assert sorted(r.n_dropped for r in linededup.report(twice).collect()) == [0, 1]


def test_bitmaps_survive_packing():
    for n in (1, 7, 8, 9, 1000):
        gone = [i for i in range(n) if i % 3 == 1]
        assert linededup.unpack(linededup.pack(gone, n), n).tolist() == [i % 3 != 1 for i in range(n)]


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again)


def test_quality_measures(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "bé", "c#", "<d>", "e\nf", "a\n"]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + AWKWARD + ["x y z " * 40]
    rows = rows_of(texts)
    frame = spark.createDataFrame([(*r, 5) for r in [*rows, rows[1]]], DOCS + ", n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measures(frame).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)}
    judged = quality_rules.report(frame).collect()
    assert len(judged) == len(rows) + 1
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.report(frame.limit(0)).collect() == []


def test_rules_follow_the_group(spark):
    clean = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    rows = [(i, clean(i) + (" ##" * 5 if i % 2 else ""), "en", "code") for i in range(60)] + [(100 + i, clean(i), "en", "prose") for i in range(60)]
    rows += [(200, clean(200) + " ####" * 30, "en", "prose"), (201, clean(201) + " ##" * 5, "en", "code")]
    kept = {r.doc_id for r in quality_rules.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.kept}
    assert kept == {r[0] for r in rows} - {200}


def test_sketches_merge_by_addition(spark):
    frame = quality_rules.measures(spark.createDataFrame(rows_of(AWKWARD * 3), DOCS))
    whole = {tuple(r) for r in quality_rules.sketches(frame).collect()}
    halves = [quality_rules.sketches(frame.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "rule", "bin").agg({"n": "sum"})
    assert {tuple(r) for r in merged.collect()} == whole


def test_sharding(spark):
    rng = random.Random(8)
    texts = [None, "", "é" * 50, *("copy" * 20 for _ in range(300)), *("x" * rng.randint(0, 400) for _ in range(500))]
    rows = rows_of(texts)
    rows += [rows[7], (None, "no id", None, None, 1)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], DOCS + ", size int").repartition(4)
    got = sharding.report(frame).collect()
    assert len(got) == len(rows)
    data = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(data(t)) + 1, zlib.crc32(data(t))) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(8)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    assert sharding.report(frame.limit(0)).collect() == []
    assert [(r.slot, r.law) for r in sharding.report(frame.limit(1)).collect()] == [(0, "bytes")]


def test_subdivision_splits_one_hot_text(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(4000)] + [(9000 + i, str(i)) for i in range(50)], "doc_id long, text string")
    keyed = sharding.keyed(rows)
    total = 4000 * 4 + sum(len(str(i)) + 1 for i in range(50))
    cuts = sharding.splitters(keyed, total, 16, 0)
    assert len(cuts) >= 12 and cuts == sorted(cuts)
    share = [r["count"] for r in keyed.groupBy(sharding._range(cuts).alias("r")).count().collect()]
    assert max(share) < 1200


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_read_back(zip64):
    records = [warc.record(i, f"http://x/{i}\r\nX: y", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), i, None) for i in range(30)]
    raw = warc.archive(records, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # a plain ZIP file to others
        assert z.testzip() is None and z.read(warc.DATA) == b"".join(records)
    asked = []
    read, size = warc.in_file(io.BytesIO(raw + b""))
    reader = warc.ZipReader(lambda at, n: asked.append(n) or read(at, n), size)
    assert set(reader.members) == {warc.DATA, warc.INDEX}
    asked.clear()
    place = list(reader.places())[17]
    fields, block = warc.parse(reader.range(warc.DATA, *place))
    assert fields["warc-record-id"] == "<urn:page:17>" and block.endswith(b"\r\n\r\n" + b"p" * 17)
    assert max(asked) < len(b"".join(records)) / 3  # by range
    with pytest.raises(ValueError):
        warc.ZipReader(*warc.in_memory(b"not a zip"))


def test_directory_fields_of_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"abc")
    raw = bytearray(out.getvalue())
    at = raw.index(b"PK\x01\x02")
    offset = raw[at + 42 : at + 46]
    raw[at + 20 : at + 28] = b"\xff" * 8
    raw[at + 42 : at + 46] = b"\xff" * 4
    extra = b"\x01\x00\x18\x00" + (3).to_bytes(8, "little") * 2 + bytes(offset) + b"\0" * 4
    raw[at + 30 : at + 32] = len(extra).to_bytes(2, "little")
    name_end = at + 47
    raw[name_end:name_end] = extra
    end = raw.rindex(b"PK\x05\x06")
    raw[end + 12 : end + 16] = (int.from_bytes(raw[end + 12 : end + 16], "little") + len(extra)).to_bytes(4, "little")
    assert warc.ZipReader(*warc.in_memory(bytes(raw))).range("a") == b"abc"


def test_warc_of_pages(spark):
    big, small = "<p>" + "x" * 1200, "<p>tiny"
    pages = [(1, "http://a", big), (2, None, big), (9, "c", big), (3, "d", small), (4, "d", small), (5, "e", None), (6, "", ""), (7, "é ü", "é" * 600), (9, "c", big), (None, "n", big), (8, "r", "HTTP\r\n\r\n" + "y" * 2000)]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.read_archives(warc.archives(frame, archive_bytes=2000)).collect()
    want = []
    for i, u, h in pages:
        raw = (h or "").encode()
        best = max((p for p, _, x in pages if p is not None and x == h), default=None) if len(raw) >= 1000 else i
        refers = best if i is not None and best != i else None
        want.append((i, "".join((u or "").split()), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers, None if refers else raw))
    nulls = lambda r: tuple(str(x) for x in r)
    got = [(*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(map(nulls, got)) == sorted(map(nulls, want))
    assert warc.report(frame.limit(0)).collect() == []


def test_limits_are_the_groups_own(spark):
    """On real-looking tables nearly every group has limits of its own, and good texts stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    measured = quality_rules.measures(docs, keep=("doc_id", "lang", "source")).cache()
    limits = quality_rules.thresholds(quality_rules.sketches(measured)).collect()
    for rule in quality_rules.SPREAD:
        assert sum(r[f"{rule}_own"] for r in limits) > len(limits) / 2
        assert len({(r[f"{rule}_least"], r[f"{rule}_most"]) for r in limits}) > len(limits) / 10
    assert len({r.symbols_most for r in limits}) > len(limits) / 2
    judged = quality_rules.report(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert sum(good) > 0.995 * len(good) and sum(bad) < 0.1 * len(bad)
    measured.unpersist()


def test_small_and_flat_groups_take_their_language_s_limits(spark):
    text = lambda n: " ".join(["word"] * n)
    rows = [(i, text(60 + i), "en", "large") for i in range(100)] + [(200 + i, text(70), "en", "flat") for i in range(60)] + [(300, text(90), "en", "small"), (301, text(90), None, "other"), (302, None, "de", "empty")]
    limits = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))).collect()}
    assert set(limits) == {("en", "large"), ("en", "flat"), ("en", "small"), (None, "other")}
    assert limits["en", "large"].symbols_own and not limits["en", "flat"].symbols_own and not limits["en", "small"].symbols_own
    assert limits["en", "flat"].symbols_most == limits["en", "small"].symbols_most != limits["en", "large"].symbols_most
    assert limits[None, "other"].symbols_most == limits["en", "small"].symbols_most  # of all documents, which are nearly all English here
    assert limits["en", "large"].word_length_most is None  # flat everywhere
