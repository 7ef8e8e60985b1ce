"""Secret scans: patterns propose candidates, a random forest throws the false ones out.

The forest looks at a candidate's length, its character transitions, how much of it
dictionary words cover, the path of its document and the words beside it, over the whole
candidate. It is trained from labelled findings, a table of (text, first, last, rule,
path, label) read by `labelled`; `sample_findings` draws some from documented rules for
where no such table is at hand.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, strings, tidy

# Public formats of credentials, and words that tell about a candidate.
RULES = {
    "private_key": r"-----BEGIN (?P<pem>(?:[A-Z]+ )*PRIVATE KEY)-----(?:(?:[^-]|-(?!----))*-----END (?P=pem)-----)?",
    "cloud_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "forge_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "chat_token": r"\bxox[abpors]-[A-Za-z0-9-]{10,}",
    "payment_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b",
    "web_token": r"(?<![\w-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assigned": r"(?i:(?<![\w-])[\w-]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential)s?[\"']?\s*(?::=|=>|[:=])\s*[\"']?)(?P<assigned_value>[^\s\"'<>,;]{8,})",
    "long_run": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}",
}
SECRET_WORDS = "api auth authorization bearer credential credentials key password passwd private pwd secret token".split()
DIGEST_WORDS = "blob checksum commit digest etag hash id integrity md5 revision sha sha1 sha256 sha512 tree uuid version".split()
SAMPLE_WORDS = "changeme demo dummy example fake foo insert placeholder sample test todo xxx your".split()
PATH_WORDS = "doc docs example examples fixture fixtures lock mock sample test tests vendor".split()
DICTIONARY = frozenset("""access account action active address admin after alert api app auth base before block body bucket build bundle button cache
change check class client cloud code column commit common config connect content context control count create custom data database date default delete demo
deploy detail device document domain download edit email enable end entity entry error event example export field file filter first folder form format
function get global group handler header here home host icon image import index info init input insert internal invalid item job key last layout level line
link list load local lock log login main manager map master member menu message method mode model module name network new node number object open option
order output page parameter parent password path place placeholder play point policy port post private process product profile project property public query
queue read record release remote remove report request reset resource response result role root route rule sample save schema scope screen script search
secret section select send server service session set setting setup show size sort source space start state status step store stream string style submit
success summary system table target task team template test text theme time title token tool tree type unit update upload url user value variable version
view web window word work write your zone""".split())

_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in RULES.items()))
#: A wider pattern without look-around, to pass over texts that hold no candidate.
_MAYBE = r"-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abpors]-|[sr]k_(live|test)_|eyJ|(?i:token|secret|passw|pwd|api[_-]?key|access[_-]?key|credential)|[A-Za-z0-9+/_-]{24}"
_WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Finding:
    rule: str
    start: int
    end: int
    value: str
    left: str
    right: str
    path: str


def candidates(text: str, path: str = "") -> Iterator[Finding]:
    """Every candidate of a text, with 60 characters on either side; offsets in code points."""
    for m in _ANY.finditer(text):
        rule = next(k for k in RULES if m[k] is not None)
        s, e = m.span("assigned_value") if rule == "assigned" else m.span()
        yield Finding(rule, s, e, text[s:e], text[max(0, s - 60) : s], text[e : e + 60], path)


_CLASS = np.full(128, 4)
for _i in range(128):
    _CLASS[_i] = 0 if chr(_i).isdigit() else 1 if chr(_i).islower() else 2 if chr(_i).isupper() else 3 if chr(_i) in "_-./+" else 4


_VOWEL, _HEX = (np.isin(np.arange(128), [ord(c) for c in a + a.upper()]) for a in ("aeiouy", "0123456789abcdef"))
_COVERED = re.compile("|".join(sorted({*DICTIONARY, *SAMPLE_WORDS}, key=lambda w: (-len(w), w))))


def coverage(value: str) -> float:
    """The share of a value's characters that dictionary words of three letters or more cover, the longest first from the left."""
    return sum(len(m[0]) for m in _COVERED.finditer(value.lower())) / max(1, len(value))


FEATURES = ["length", "entropy", "class_changes", "digits", "lower", "upper", "marks", "hex", "repeats", "steps", "vowel_turns", "coverage", "assigned", "known_format", "secret_left", "digest_left", "sample_near", "path_hint"]


def measured(f: Finding) -> list[float]:
    """The forest's view of a finding, in the order of FEATURES."""
    codes = np.frombuffer(f.value.encode("ascii", "replace"), np.uint8)
    n = max(1, len(codes))
    share = np.bincount(codes, minlength=128)[:128] / n
    share = share[share > 0]
    kind = _CLASS[codes]
    step = np.diff(codes.astype(int))
    vowels = _VOWEL[codes]
    turns = float((vowels[1:] != vowels[:-1]).mean()) if n > 1 else 0.0
    left = [w.lower() for w in _WORDS.findall(f.left.replace("_", " "))][-4:]
    right = [w.lower() for w in _WORDS.findall(f.right.replace("_", " "))][:3]
    near = [*left, *right, *(w.lower() for w in _WORDS.findall(f.value.replace("_", " ")))]
    path = [w.lower() for w in _WORDS.findall(f.path.replace("_", " "))]
    return [
        float(len(f.value)), float(-(share * np.log2(share)).sum()), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        *(float((kind == k).mean()) for k in range(4)), float(_HEX[codes].all()), float((step == 0).mean()) if n > 1 else 0.0,
        float((np.abs(step) == 1).mean()) if n > 1 else 0.0, turns, coverage(f.value), float(f.rule == "assigned"), float(f.rule not in ("assigned", "long_run")),
        float(any(w in SECRET_WORDS for w in left)), float(any(w in DIGEST_WORDS for w in left)), float(any(w in SAMPLE_WORDS for w in near)), float(any(w in PATH_WORDS for w in path)),
    ]


class Forest:
    """A random forest over numbers: Gini splits at sampled quantiles, bootstrapped trees, votes averaged."""

    def __init__(self, trees: int = 30, depth: int = 9, least: int = 3, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = [self._tree(x[at], y[at], rng) for at in (rng.integers(0, len(y), len(y)) for _ in range(self.trees))]
        return self

    def _tree(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        out: list[list] = []  # feature (-1: leaf), threshold, child at or below, child above, share of ones

        def grow(rows: np.ndarray, depth: int) -> int:
            me, share = len(out), float(y[rows].mean())
            out.append([-1, 0.0, -1, -1, share])
            if depth == self.depth or len(rows) < 2 * self.least or share in (0.0, 1.0):
                return me
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
                v = x[rows, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.03, 0.97, 24), method="lower"))
                below = v[:, None] <= cuts
                n = below.sum(0)
                ones = (below & (y[rows] == 1)[:, None]).sum(0)
                ok = (n >= self.least) & (len(rows) - n >= self.least)
                if not ok.any():
                    continue
                a, b = ones / np.maximum(n, 1), (y[rows].sum() - ones) / np.maximum(len(rows) - n, 1)
                gain = share * (1 - share) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                gain[~ok] = -1
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), int(f), float(cuts[k]))
            if best[1] >= 0:
                side = x[rows, best[1]] <= best[2]
                out[me][:2] = best[1:]
                out[me][2] = grow(rows[side], depth + 1)
                out[me][3] = grow(rows[~side], depth + 1)
            return me

        grow(np.arange(len(y)), 0)
        f, t, lo, hi, share = zip(*out, strict=True)
        return np.array(f), np.array(t), np.array(lo), np.array(hi), np.array(share)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, t, lo, hi, share in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = f[at] >= 0
                v = x[np.arange(len(x)), np.maximum(f[at], 0)]
                at = np.where(inner, np.where(v <= t[at], lo[at], hi[at]), at)
            total += share[at]
        return total / max(1, len(self.nodes))


def sample_findings(n: int = 4000, seed: int = 17) -> list[tuple[Finding, int]]:
    """Labelled findings drawn from rules, half of them real, for every form of candidate.

    Real ones are random characters of a credential's alphabet and length, in the place
    where such a credential stands. False ones are what looks alike: digests and
    identifiers beside words that say so, placeholders, words strung together, calls,
    one character over and over, and credentials' formats filled with a placeholder.
    """
    rng = random.Random(seed)
    pick = rng.choice
    chars = lambda k, a: "".join(pick(a) for _ in range(k))
    upper, lower, digits = (range(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
    hexa, alnum, capital = "0123456789abcdef", "".join(map(chr, [*upper, *lower, *digits])), "".join(map(chr, [*upper, *digits]))
    digits_ = "".join(map(chr, digits))
    words = sorted(DICTIONARY)
    syllables = sorted({w[i : i + 2] for w in words for i in range(0, len(w) - 1, 2)})
    filler = lambda: " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))
    strung = lambda lo, hi, mark: mark.join(pick(words) for _ in range(rng.randint(lo, hi)))
    dummy = lambda: pick(SAMPLE_WORDS)
    name = lambda: pick([pick(SECRET_WORDS[5:7] + ["token", "password", "passwd", "pwd", "credential"]), f"{pick(words)}_token", f"{pick(words)}_secret", "api_key", "access_key", "apikey", "client_secret"])
    given = lambda value: f"{name()}{pick([' = ', ': ', '=', ' := ', ' => '])}{(q := pick(['', chr(34), chr(39)]))}{value}{q}"
    pem = lambda body: f"-----BEGIN {(k := pick(['', 'RSA ', 'EC ', 'OPENSSH ']))}PRIVATE KEY-----\n{body}\n-----END {k}PRIVATE KEY-----"
    web = lambda a, b, c: f"eyJ{a}.eyJ{b}.{c}"
    real = [
        lambda: given(chars(pick([24, 32, 40, 48, 56, 64]), hexa)), lambda: given(chars(rng.randint(16, 64), alnum)), lambda: given(chars(rng.randint(24, 44), alnum + "+/") + pick(["", "="])), lambda: given(chars(rng.randint(10, 20), alnum + "!@#%^*")),
        lambda: "AKIA" + chars(16, capital), lambda: "ASIA" + chars(16, capital), lambda: f"gh{pick('pousr')}_{chars(36, alnum)}", lambda: f"xox{pick('abpors')}-{chars(11, digits_)}-{chars(24, alnum)}",
        lambda: f"{pick('sr')}k_live_{chars(rng.randint(24, 40), alnum)}", lambda: web(chars(rng.randint(17, 30), alnum), chars(rng.randint(30, 90), alnum), chars(43, alnum + "_-")), lambda: pem("\n".join(chars(64, alnum + "+/") for _ in range(rng.randint(3, 20)))),
    ]
    false = [
        lambda: f"{pick(DIGEST_WORDS)}{pick([' ', ': ', '='])}{chars(pick([32, 40, 64]), hexa)}", lambda: f"{pick(DIGEST_WORDS)} {'-'.join(chars(k, hexa) for k in (8, 4, 4, 4, 12))}", lambda: given(f"{dummy()}{pick('_-')}{name()}{pick(['', '_here', '-goes-here', '_1234'])}"),
        lambda: strung(5, 9, pick(["_", "-", "/"])), lambda: given(strung(2, 6, pick(["_", "-", ""]))), lambda: given(pick("x*0a-#") * rng.randint(10, 60)), lambda: given(f"{pick(['get', 'load', 'read', 'os.environ', 'config', 'settings'])}{pick('._')}{strung(1, 3, '_')}{pick(['()', '', '[0]'])}"),
        lambda: given("${" + strung(1, 3, "_").upper() + "}"), lambda: f"AKIA{pick(['EXAMPLE', 'SAMPLE', 'XXXX', 'TEST'])}{chars(16, 'X0')}"[:20], lambda: f"ghp_{pick(['x', 'X', '0', 'a']) * 36}", lambda: f"xoxb-{pick(['your', 'example', 'test'])}-{strung(2, 3, '-')}",
        lambda: f"{pick('sr')}k_test_{dummy()}{pick(['x', '0']) * 16}", lambda: web(*(strung(3, 5, "_") for _ in range(3))), lambda: pem(pick(["...", f"<{dummy()} key>", "MII...", "x" * 64])), lambda: "-----BEGIN PRIVATE KEY-----", lambda: chars(pick([32, 40, 64]), hexa),
    ]
    folders = [*(f"{strung(1, 3, '/')}.{pick(['py', 'yml', 'json', 'env', 'txt'])}" for _ in range(40)), ""]
    out: list[tuple[Finding, int]] = []
    while len(out) < n:
        label = int(rng.random() < 0.5)
        text = f"{filler()} {pick(real if label else false)()} {filler()}"
        path = pick(folders) if label or rng.random() < 0.6 else f"{pick(PATH_WORDS)}/{pick(folders)}"
        out += [(f, label) for f in candidates(text, path)][:1]
    return out


#: Labelled findings that a forest is fitted to at most: those with the least hashes.
LABELLED = 20_000


def labelled(findings: DataFrame, most: int = LABELLED) -> list[tuple[Finding, int]]:
    """Labelled findings of a table (text, first, last, rule, path, label): what stands from first to last (code points) in a text is a secret (label 1) or none (0).

    At most `most` rows, of which 60 characters to either side come along. Rows with a
    null text, place or label teach nothing; a null path has no words.
    """
    f = only(findings, "text", "first", "last", "rule", "path", "label").where("text is not null and first is not null and last > first and label in (0, 1)")
    part = lambda a, n: F.substring("text", (a + 1).cast("int"), n.cast("int"))
    left = F.greatest(F.col("first") - 60, F.lit(0))
    rows = f.select("rule", "first", "last", part(F.col("first"), F.col("last") - F.col("first")).alias("value"), part(left, F.col("first") - left).alias("left"), part(F.col("last"), F.lit(60)).alias("right"), F.coalesce("path", F.lit("")).alias("path"), "label")
    key = F.xxhash64("rule", "value", "left", "right", "path")
    found = rows.orderBy(key, "first", "label").limit(most).collect()  # bounded
    return [(Finding(r.rule or "long_run", r.first, r.last, r.value, r.left, r.right, r.path), int(r.label)) for r in found]


def train(findings: list[tuple[Finding, int]], **options: int) -> Forest:
    return Forest(**options).fit(np.array([measured(f) for f, _ in findings]), np.array([y for _, y in findings]))


def scanned(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """A row for each candidate of every whole text: doc_id, rule, first and last (code points, exclusive), value_sha256, score, is_secret.

    Texts without candidates, null and empty ones among them, give no rows, and so does
    an empty table; a null path has no words. Repeated rows give repeated findings. Of
    patterns that begin at one place the first in RULES counts, and a text is scanned to
    its end however long it is. Other columns don't matter, whatever their names.
    """
    rows = only(docs, *dict.fromkeys((doc_id, text, path)))
    kind = rows.schema[doc_id].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes
    names = ["doc_id", "rule", "first", "last", "value_sha256", "score", "is_secret"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = given.value
        for batch in batches:
            texts = strings(batch.column(1))
            batch = batch.filter(pc.match_substring_regex(texts, _MAYBE))
            ids, found = [], []
            for i, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                for c in candidates(t, p or ""):
                    ids.append(i), found.append(c)
            score = f.scores(np.array([measured(c) for c in found])) if found else np.zeros(0)
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array([c.rule for c in found], pa.string()), pa.array([c.start for c in found], pa.int64()), pa.array([c.end for c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(c.value.encode("utf-8", "surrogatepass")).hexdigest() for c in found], pa.string()), pa.array(score), pa.array(score >= least)], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, rule string, first long, last long, value_sha256 string, score double, is_secret boolean")


def report(docs: DataFrame) -> DataFrame:
    return scanned(docs, train(sample_findings()))
