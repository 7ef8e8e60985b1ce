"""Column functions: object ids, modes, messages, identities, paths, refs, whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blob_oid(content: Column) -> Column:
    """SHA-1 of "blob <size>\\0" and the content, which is text or bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.lit(bytearray(b"\0")), raw))


def object_oid(kind: str, payload: Column) -> Column:
    raw = payload.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit(kind + " "), F.octet_length(raw).cast("string")), "UTF-8"), F.lit(bytearray(b"\0")), raw))


def is_oid(value: Column, width: int = 40) -> Column:
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{width}}}$"), F.lit(False))


def abbreviated(oid: Column, length: int = 7) -> Column:
    return F.substring(oid, 1, length)


def loose_path(oid: Column) -> Column:
    return F.concat_ws("/", F.substring(oid, 1, 2), F.substring(oid, 3, 100))


# --- modes ----------------------------------------------------------------------------------------------------


def mode_kind(mode: Column) -> Column:
    """file, symlink, directory or gitlink."""
    return F.when(mode == "120000", "symlink").when(mode.isin("40000", "040000"), "directory").when(mode == "160000", "gitlink").when(mode.isNotNull(), "file")


def normalized_mode(mode: Column) -> Column:
    """Regular modes come down to 100644 or 100755 by the owner's execute bit; others stay."""
    bits = F.conv(mode, 8, 10).cast("long")
    return F.when(mode.startswith("100"), F.when(bits.bitwiseAND(F.lit(73)) != 0, "100755").otherwise("100644")).when(mode == "040000", "40000").otherwise(mode)


# --- messages -------------------------------------------------------------------------------------------------


def subject_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def fold_subject(message: Column) -> Column:
    """The first paragraph on one line, blanks at line ends dropped."""
    lines = F.transform(F.split(F.regexp_replace(message, r"^(?:[ \t\r\f\x0B]*\n)+", ""), "\n"), lambda x: F.regexp_replace(x, r"[ \t\r\f\x0B]+$", ""))
    first_blank = F.array_position(lines, "")
    return F.array_join(F.when(first_blank > 0, F.slice(lines, 1, (first_blank - 1).cast("int"))).otherwise(lines), " ")


def stripspace(message: Column) -> Column:
    """Line ends trimmed, runs of blank lines to one, none at the ends, one newline last."""
    trimmed = F.regexp_replace(message, r"[ \t\r\f\x0B]+(?=\n|$)", "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\n+", ""), r"\n+$", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def shortlog_subject(message: Column) -> Column:
    """The folded subject, trimmed, without a [PATCH ...] mark."""
    return F.ltrim(F.regexp_replace(F.trim(fold_subject(message)), r"^\[PATCH[^\]]*\]", ""))


def reflog_message(message: Column) -> Column:
    return F.trim(F.regexp_replace(message, r"[\r\n]", " "))


def identity(line: Column) -> Column:
    """struct(name, email, ts, tz) of "Name <mail> seconds zone"."""
    pattern = r"^(.*?) ?<([^>]*)> (-?\d+) ([+-]\d{4})$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("long").alias("ts"), part(4).alias("tz")))


def identity_line(name: Column, email: Column, ts: Column, tz: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit("> "), ts.cast("string"), F.lit(" "), tz)


# --- refs and config ------------------------------------------------------------------------------------------


def short_ref(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads|tags|remotes)/", "")


def ref_candidates(base: Column) -> Column:
    """The six names that a short name may mean, first to last."""
    return F.array(base, *(F.concat(F.lit(p), base) for p in ("refs/", "refs/tags/", "refs/heads/", "refs/remotes/")), F.concat(F.lit("refs/remotes/"), base, F.lit("/HEAD")))


def valid_ref(name: Column) -> Column:
    """Whether a ref name obeys the grammar: no empty, dotted or locked component, none of the forbidden characters."""
    bad = r"(^|/)\.|\.\.|//|[\x00-\x20\x7f~^:?*\[\\]|@\{|\.lock(/|$)|^/|/$|\.$|^@$"
    return (F.length(name) > 0) & ~name.rlike(bad)


def git_boolean(value: Column) -> Column:
    """true, yes, on, a number but 0, or no value at all; false, no, off, 0 or empty; else null."""
    low = F.lower(value)
    return F.when(value.isNull() | low.isin("true", "yes", "on"), True).when(low.isin("false", "no", "off", ""), False).otherwise(git_int(value) != 0)


def git_int(value: Column) -> Column:
    """A whole number with an optional k, m or g; else null."""
    pattern = r"^\s*([+-]?\d+)([kKmMgG]?)$"
    scale = F.lower(F.regexp_extract(value, pattern, 2))
    factor = F.when(scale == "k", 1 << 10).when(scale == "m", 1 << 20).when(scale == "g", 1 << 30).otherwise(1)
    return F.when(value.rlike(pattern), F.expr("cast(1 as bigint)") * F.try_to_number(F.regexp_extract(value, pattern, 1), F.lit("S999999999999999999")).cast("long") * factor)


def config_key(raw: Column) -> Column:
    """struct(section, subsection, name): section and name in lower case."""
    p = r"^([^.]+)(?:\.(.+))?\.([^.]+)$"
    sub = F.regexp_extract(raw, p, 2)
    return F.when(raw.rlike(p), F.struct(F.lower(F.regexp_extract(raw, p, 1)).alias("section"), F.when(sub != "", sub).alias("subsection"), F.lower(F.regexp_extract(raw, p, 3)).alias("name")))


# --- paths ----------------------------------------------------------------------------------------------------


def parent_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def collapsed(path: Column) -> Column:
    """The path without empty and "." segments, ".." taking the one before it."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))


def fanout_path(oid: Column, fanout: int) -> Column:
    parts = [F.substring(oid, 2 * i + 1, 2) for i in range(fanout)]
    return F.concat_ws("/", *parts, F.substring(oid, 2 * fanout + 1, 100))


def unsafe_path(path: Column) -> Column:
    """Why a path must not be written, or null."""
    parts = F.split(path, "/")
    has = lambda test: F.exists(parts, test)
    return (
        F.when(path == "", "empty").when(path.startswith("/"), "absolute").when(path.contains("\\"), "backslash")
        .when(has(lambda x: x == ""), "empty-segment").when(has(lambda x: x.isin(".", "..")), "dot-segment")
        .when(has(lambda x: F.lower(F.regexp_replace(x, r"[ .]+$", "")).isin(".git", "git~1")), "dot-git")
    )


# --- lines ----------------------------------------------------------------------------------------------------


def split_lines(content: Column) -> Column:
    """Lines with their newline; no empty last line."""
    return F.regexp_extract_all(content, F.lit(r"([^\n]*\n|[^\n]+)"), F.lit(1))


def normalized_line(line: Column, mode: str = "exact") -> Column:
    """A line for comparison: exact, all (no blanks), change (runs of blanks as one) or at-eol."""
    bare = F.regexp_replace(line, r"\n$", "")
    if mode == "all":
        return F.regexp_replace(bare, r"[ \t\r\f\x0B]+", "")
    if mode == "change":
        return F.regexp_replace(F.regexp_replace(bare, r"[ \t\r\f\x0B]+$", ""), r"[ \t\r\f\x0B]+", " ")
    if mode == "at-eol":
        return F.regexp_replace(bare, r"[ \t\r\f\x0B]+$", "")
    return line


def is_binary(content: Column) -> Column:
    """A NUL byte within the first 8,000 bytes."""
    return F.contains(F.substring(content.cast("binary"), 1, 8000), F.lit(bytearray(b"\0")))


def similarity_percent(score: Column) -> Column:
    return F.floor(score * 100 / 60000).cast("long")


def bisect_steps(remaining: Column) -> Column:
    """About how many more tests a bisection of n candidates takes."""
    e = F.floor(F.log2(remaining.cast("double"))).cast("long")
    top = F.pow(F.lit(2), e).cast("long")
    return F.when(remaining < 3, 0).otherwise(F.when(top < 3 * (remaining - top), e).otherwise(e - 1)).cast("long")
