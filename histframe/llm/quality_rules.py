"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is a histogram over fixed bins whose width is bounded relative to the value:
exact counts per (language, source, bin), merged by addition, so partial aggregates
merge in any order to the same sketch. Three measures have one: symbols a character,
repeated lines a line, and the mean length of words. A share that is mostly 0 tells
nothing by its quartiles, so a sketch holds its upper estimate (one more found among one
more looked at), which spreads with the texts' lengths; a document is dropped where even
its plain share lies beyond what the upper estimates of its group call usual: above the
upper quartile by several times the distance of the quartiles, for word lengths also
below the lower one. There are no fixed limits: a group too small or too flat for
quartiles of its own takes those of its language, and these those of all documents,
which are sums of sketches.

Everything on the main path is a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

#: How many quartile distances beyond the quartiles are still usual; a share of lines is at most 1, so three suffice.
SPREAD = {"symbols": 6, "dup_lines": 3, "word_length": 6}
#: Documents below which a group has no quartiles of its own.
LEAST = 50

_BLANK = r"[\x20\x09-\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns in `keep` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    A null text has no words. Rows are independent of each other.
    """
    t = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))) if text in docs.columns else docs
    t = only(t, *keep, "_t")
    words = t.withColumn("_w", F.expr(rf"filter(split(_t, '{_BLANK}', -1), x -> x != '')".replace("\\", "\\\\")))
    lines = r"filter(split(_t, '\n', -1), x -> x rlike '[^\x20\x09-\x0D]')".replace("\\", "\\\\")
    basic = words.select(
        *keep, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.expr(_let(lines, "l", "cast(size(l) - size(array_distinct(l)) as bigint)")).alias("n_dup_lines"),
        F.expr(_let(lines, "l", "cast(size(l) as bigint)")).alias("n_lines"),
        # windows of three words, as hashes
        F.expr("if(size(_w) < 3, cast(array() as array<bigint>), zip_with(zip_with(slice(_w, 1, size(_w) - 2), slice(_w, 2, size(_w) - 2), (a, b) -> named_struct('a', a, 'b', b)), slice(_w, 3, size(_w) - 2), (p, c) -> xxhash64(p.a, p.b, c)))").alias("_h"),
    )
    # windows found twice or more: their starts, by a sort of (hash, place); texts whose windows all differ skip it
    sorted_ = "array_sort(transform(_h, (h, i) -> named_struct('h', h, 'i', i)))"
    repeated = _let(sorted_, "s", "filter(zip_with(zip_with(s, concat(array(cast(null as struct<h:bigint,i:int>)), slice(s, 1, size(s) - 1)), (x, y) -> named_struct('x', x, 'same', x.h <=> y.h)), concat(slice(s, 2, size(s) - 1), array(cast(null as struct<h:bigint,i:int>))), (p, z) -> if(p.same or (p.x.h <=> z.h), p.x.i, null)), i -> i is not null)")
    covered = _let(f"array_sort({repeated})", "r", "aggregate(zip_with(r, slice(r, 2, greatest(size(r) - 1, 0)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (n, x) -> n + x)")
    return basic.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(f"if(size(_h) = size(array_distinct(_h)), 0L, {covered})").alias("n_repeat_words"))


#: Per rule what its sketch holds and what is judged, rounded down; null where a text has no words.
ESTIMATES = {
    "symbols": ("100000 * (n_symbols + 1) div (word_chars + 1)", "100000 * n_symbols div word_chars"),
    "dup_lines": ("1000 * (n_dup_lines + 1) div (n_lines + 1)", "1000 * n_dup_lines div n_lines"),
    "word_length": ("100 * word_chars div n_words", "100 * word_chars div n_words"),
}


def _measured(expression: str) -> Column:
    return F.expr(f"if(n_words = 0, null, {expression})").cast("long")


def bin_of(value: str) -> Column:
    """The sketch's bin: values below 64 have their own; above, bins are at most 1/32 of their value wide."""
    return F.expr(f"{value} - {value} % shiftleft(1L, greatest(length(bin({value})) - 6, 0))")


def sketches(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(groups, rule, bin, n): add up n to merge."""
    rules = F.map_from_arrays(F.array(*(F.lit(r) for r in ESTIMATES)), F.array(*(_measured(e) for e, _ in ESTIMATES.values())))
    return measured.select(*groups, F.explode(rules).alias("rule", "rate")).where("rate is not null").groupBy(*groups, "rule", bin_of("rate").alias("bin")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, rule, q1, q3) of the groups that are large and spread enough, from sketches of these or finer groups."""
    merged = sketch.groupBy(*groups, "rule", "bin").agg(F.sum("n").alias("n"))
    # a group's window holds one row a bin, some hundreds at most
    w = Window.partitionBy(*groups, "rule").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*groups, "rule"))})
    at = run.where(F.col("all") >= LEAST).groupBy(*groups, "rule").agg(*(F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin"))).alias(f"q{k}") for k in (1, 3)))
    return at.where("q1 < q3")


def thresholds(sketch: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(groups, <rule>_least and <rule>_most for each rule, <rule>_own): own tells whether the group's own sketch decides.

    A group takes the quartiles of the first of its prefixes (its language; all
    documents) that has some; without any, a rule has no limits.
    """
    known = sketch.select(*groups, "rule").distinct()
    for k in range(len(groups), -1, -1):
        level = quartiles(sketch, groups[:k]).select(F.col("rule").alias("_rule"), *(F.col(g).alias(f"_{g}") for g in groups[:k]), F.struct("q1", "q3").alias(f"_{k}"))
        on = F.col("rule") == F.col("_rule")
        for g in groups[:k]:
            on &= F.col(g).eqNullSafe(F.col(f"_{g}"))
        known = known.join(level, on, "left").drop("_rule", *(f"_{g}" for g in groups[:k]))
    q = known.withColumn("q", F.coalesce(*(f"_{k}" for k in range(len(groups), -1, -1)))).withColumn("own", F.col(f"_{len(groups)}").isNotNull())
    out = []
    for rule, spread in SPREAD.items():
        of = lambda c, rule=rule: F.max(F.when(F.col("rule") == rule, c))
        least = F.col("q.q1") - spread * (F.col("q.q3") - F.col("q.q1")) if rule == "word_length" else F.lit(0).cast("long")
        out += [of(least).alias(f"{rule}_least"), of(F.col("q.q3") + spread * (F.col("q.q3") - F.col("q.q1"))).alias(f"{rule}_most"), of(F.col("own")).alias(f"{rule}_own")]
    return q.groupBy(*groups).agg(*out)


def judged(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The columns in `keep`, the measures, base_failed and kept of every document.

    base_failed: under 50 words, or over half of the words in repeated windows. kept:
    not base_failed, and nothing measured beyond its group's limits, which all documents
    with words have set. A null or empty text has no words. A null group is a group of
    its own. Repeated rows count and are judged each; an empty table gives no rows. A
    very long text is measured whole, in one row's arrays. Other columns of `docs` don't
    matter, whatever their names. The texts are read once; the measured columns are
    written and read twice.
    """
    measured = written(measures(docs, text, (*keep, *groups)), "measures")
    limits = thresholds(sketches(measured, groups), groups).withColumnsRenamed({g: f"_{g}" for g in groups})
    on = F.lit(True)
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = measured.join(limits, on, "left").drop(*(f"_{g}" for g in groups))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    usual = F.lit(True)
    for rule, (_, rate) in ESTIMATES.items():
        usual &= F.coalesce(_measured(rate).between(F.col(f"{rule}_least"), F.col(f"{rule}_most")), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & usual)


def report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
