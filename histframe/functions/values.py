"""Column functions: bytes and hex, digests, hunk headings, URLs, admin ids, cutoffs, templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import normalized_line

DAY = 86_400


# --- bytes ----------------------------------------------------------------------------------------------------


def hexed(raw: Column) -> Column:
    """The bytes in lower-case hex."""
    return F.lower(F.hex(raw))


def unhexed(text: Column) -> Column:
    """The bytes of an even number of hex digits; null for anything else."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))


def bytes_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: how two byte strings compare."""
    x, y = F.hex(a), F.hex(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def code_units(name: Column) -> Column:
    """What ref names sort by: their UTF-16 code units, in hex."""
    return F.hex(F.encode(name, "UTF-16BE"))


def crc(raw: Column) -> Column:
    return F.crc32(raw.cast("binary"))


# --- lines ----------------------------------------------------------------------------------------------------


def line_digest(line: Column, mode: str) -> Column:
    """struct(length, hash) of a line as a whitespace mode sees it: digests that differ prove that lines differ."""
    seen = normalized_line(line, mode)
    return F.struct(F.octet_length(seen).alias("length"), F.xxhash64(seen).alias("hash"))


def heading(line: Column) -> Column:
    """What a hunk is headed with: a line that begins with a letter, _ or $, its first 80 bytes without white space at the end; else null."""
    raw = F.substring(F.encode(line, "UTF-8"), 1, 80)
    return F.when(line.rlike("^[A-Za-z_$]"), F.regexp_replace(F.decode(raw, "UTF-8"), r"[\x20\x09-\x0D]+$", ""))


# --- URLs -----------------------------------------------------------------------------------------------------


def _local(url: Column) -> Column:
    """Whether a URL is a path: no colon, or a slash before the first one."""
    colon, slash = F.instr(url, ":"), F.instr(url, "/")
    return (colon == 0) | ((slash > 0) & (slash < colon))


def relative_url(base: Column, url: Column) -> Column:
    """A URL that begins with ./ or ../ steps, from a base: each ../ takes the base's last part, after a slash or else after a colon.

    A URL that isn't a path, or begins with a slash, stands for itself. Null where the
    base has no part left to take.
    """
    bare = F.regexp_replace(base, "/$", "")
    relative = _local(bare) & ~bare.startswith("/")
    start = F.when(relative & ~bare.rlike(r"^\.\.?/"), F.concat(F.lit("./"), bare)).otherwise(bare)
    steps = F.regexp_extract(url, r"^((?:\.\.?/)*)", 1)
    rest = F.substring(url, F.length(steps) + 1, F.length(url))
    ups = F.size(F.filter(F.split(steps, "/"), lambda x: x == ".."))

    def up(acc: Column, _: Column) -> Column:
        path, colon = acc["path"], acc["colon"]
        slashed, coloned = F.instr(path, "/") > 0, F.instr(path, ":") > 0
        shorter = (
            F.when(slashed, F.regexp_replace(path, "/[^/]*$", "")).when(coloned, F.regexp_replace(path, ":[^:]*$", "")).when(~acc["relative"] & (path != "."), F.lit("."))
        )
        return F.struct(shorter.alias("path"), (colon | (~slashed & coloned)).alias("colon"), acc["relative"].alias("relative"))

    # array_repeat and not sequence: no steps make an empty array
    done = F.aggregate(F.array_repeat(F.lit(0), ups), F.struct(start.alias("path"), F.lit(False).alias("colon"), relative.alias("relative")), up)
    joined = F.concat(done["path"], F.when(done["colon"], ":").otherwise("/"), F.regexp_replace(rest, "/$", ""))
    return F.when(~_local(url) | url.startswith("/"), url).otherwise(F.regexp_replace(joined, r"^\./", ""))


def submodule_url(base: Column, url: Column) -> Column:
    """A module's URL: only what begins with ./ or ../ is relative."""
    return F.when(url.rlike(r"^\.\.?/"), relative_url(base, url)).otherwise(url)


# --- refs and commits -----------------------------------------------------------------------------------------


def gets_log(ref: Column, setting: Column, bare: Column) -> Column:
    """Whether an update of a ref begins a log: setting is "always", "true", "false" or null, where null means that the repository isn't bare."""
    usual = (ref == "HEAD") | ref.rlike("^refs/(heads|remotes|notes)/")
    enabled = F.when(setting.isNull(), ~F.coalesce(bare, F.lit(False))).otherwise(setting == "true")
    return F.when(setting == "always", True).otherwise(enabled & usual)


def name_cutoff(target_ts: Column) -> Column:
    """The time before which no commit can name a target: a day before it; 0 stays."""
    return F.when(target_ts == 0, 0).otherwise(target_ts - DAY).cast("long")


def before_cutoff(ts: Column, cutoff: Column) -> Column:
    return ts < cutoff


def tag_payload(target: Column, kind: Column, name: Column, tagger: Column, message: Column) -> Column:
    """The text of an annotated tag; without a tagger its line is left out."""
    return F.concat(F.lit("object "), target, F.lit("\ntype "), kind, F.lit("\ntag "), name, F.coalesce(F.concat(F.lit("\ntagger "), tagger), F.lit("")), F.lit("\n\n"), message)


# --- drivers --------------------------------------------------------------------------------------------------


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A command with %x replaced by the values, %% by %; an unknown %x and a % at the end stay.

    Pieces are read from left to right, so that nothing in a value is taken for a placeholder.
    """
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)(%.|%$|[^%]+)"), F.lit(1))

    def one(piece: Column) -> Column:
        out = F.when(piece == "%%", "%")
        for letter, value in values.items():
            out = out.when(piece == f"%{letter}", value)
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def binary_override(value: Column, textconv: Column, raw_binary: Column) -> Column:
    """struct(patch, numstat) of "binary", "text" or null, from a path's `diff` attribute: "true", "false", "unspecified" or a driver's name."""
    pair = lambda p, n: F.struct(F.lit(p).cast("string").alias("patch"), F.lit(n).cast("string").alias("numstat"))
    return (
        F.when(value == "false", pair("binary", "binary")).when(value == "true", pair("text", "text")).when((value == "unspecified") | ~textconv, pair(None, None))
        .when(raw_binary, pair("text", "binary")).otherwise(pair("text", "text"))
    )
