"""Drivers that attributes name: text conversion, clean and smudge filters, content merges.

A driver is a Python function that is registered under a name; nothing is run outside
of Python. Rows go to their driver by Arrow batches, and rows whose attribute names no
registered driver are left to the built-in way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histframe.functions.linediff import merge as merge_lines

MARKER = 7


class DriverFailed(RuntimeError):
    """A required driver failed."""


@dataclass
class Registry:
    """textconv and filters by name: (content) -> content, merges: (base, ours, theirs, marker size, path) -> (content, conflicts)."""

    textconv: dict[str, Callable[[str], str]] = field(default_factory=dict)
    clean: dict[str, Callable[[str], str]] = field(default_factory=dict)
    smudge: dict[str, Callable[[str], str]] = field(default_factory=dict)
    merges: dict[str, Callable[[str, str, str, int, str], tuple[str, int]]] = field(default_factory=dict)
    #: Filters that must not fail; of others the content stays as it is.
    required: frozenset[str] = frozenset()


def named(attribute: Column) -> Column:
    """The driver's name in an attribute's value; null for true, false and unspecified."""
    return F.when(~attribute.isin("true", "false", "unspecified"), attribute)


def merge_spec(paths: DataFrame, config: DataFrame) -> DataFrame:
    """(path, driver, command, marker_size) of paths (path, merge, marker): driver is text, binary, union or a name that config (name, command) knows.

    An attribute without a value stands for text, an unset one for binary, a name that
    isn't configured for text. The marker size is 7 unless it is a whole number above 0.
    """
    m = F.col("merge")
    j = paths.join(config.select(F.col("name").alias("_n"), "command"), m == F.col("_n"), "left")
    driver = F.when(m == "false", "binary").when(m.isin("text", "binary", "union"), m).when(F.col("_n").isNotNull(), m).otherwise("text")
    size = F.when(F.col("marker").rlike(r"^[1-9]\d{0,8}$"), F.col("marker").cast("int")).otherwise(MARKER)
    return j.select("path", driver.alias("driver"), F.when(driver == F.col("_n"), F.col("command")).alias("command"), size.alias("marker_size"))


def filter_spec(paths: DataFrame, config: DataFrame) -> DataFrame:
    """(path, driver, required) of paths (path, filter): a name that config (name, required) knows; else null, which leaves content as it is."""
    j = paths.join(config.select(F.col("name").alias("_n"), "required"), named(F.col("filter")) == F.col("_n"), "left")
    return j.select("path", F.col("_n").alias("driver"), F.coalesce(F.col("required"), F.lit(False)).alias("required"))


def _through(rows: DataFrame, drivers: dict[str, Callable[[str], str]], driver: str, content: str, required: frozenset[str]) -> DataFrame:
    names, at, by = rows.columns, rows.columns.index(content), rows.columns.index(driver)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch.column(by).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if text is not None and name in drivers:
                    try:
                        text = drivers[name](text)
                    except Exception as e:
                        if name in required:
                            raise DriverFailed(name) from e
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # rows without a driver stay in the JVM
    some = F.col(driver).isin(*drivers) if drivers else F.lit(False)
    return rows.where(~F.coalesce(some, F.lit(False))).unionByName(rows.where(some).mapInArrow(run, rows.schema))


def apply_textconv(rows: DataFrame, registry: Registry, driver: str = "driver", content: str = "content") -> DataFrame:
    """rows with content as its driver shows it; a driver that fails leaves it as it is."""
    return _through(rows, registry.textconv, driver, content, frozenset())


def apply_filter(rows: DataFrame, registry: Registry, direction: str, driver: str = "driver", content: str = "content") -> DataFrame:
    """rows with content cleaned (on its way into the store) or smudged (out of it)."""
    return _through(rows, {"clean": registry.clean, "smudge": registry.smudge}[direction], driver, content, registry.required)


def merge_contents(rows: DataFrame, registry: Registry) -> DataFrame:
    """(path, merged, conflicts) of rows (path, driver, marker_size, base, ours, theirs).

    text is the line merge, union takes both sides of a conflict, binary keeps ours as a
    conflict, and a registered driver gives its own result.
    """
    merges = registry.merges
    names = ["path", "driver", "marker_size", "base", "ours", "theirs"]

    def one(path: str, driver: str, size: int, base: str | None, ours: str, theirs: str) -> tuple[str, int]:
        if driver in merges:
            return merges[driver](base or "", ours, theirs, size, path)
        if driver == "binary":
            return ours, int(ours != theirs)
        return merge_lines(base or "", ours, theirs, favour="union" if driver == "union" else None, marker=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "merged", "conflicts"])

    return rows.select(*names).mapInArrow(run, "path string, merged string, conflicts long")
