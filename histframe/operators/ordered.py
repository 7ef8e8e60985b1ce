"""Whole-table order without a single task: range partitions, each known by number.

Operators that look at neighbours in a total order (islands, order checks, global row
numbers) partition by range of the key, write that, and carry what crosses a border in
a table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histframe.scratch import written


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df with _range, the number of the key range that a row is in; written, so that the numbers stay as they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    return written(parted, "ranged")


def numbered(df: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """df with the row's place, from 0, in the order of the keys."""
    r = ranged(df, *keys)
    sizes = r.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return r.withColumn("_in", place).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")


def lagged(df: DataFrame, value: str, *keys: str, name: str = "previous") -> DataFrame:
    """df with `value` of the row before it in the order of the keys, and _range."""
    r = ranged(df, *keys)
    inside = Window.partitionBy("_range").orderBy(*keys)
    last = r.groupBy("_range").agg(F.max(F.struct(*keys, F.col(value).alias("_v"))).alias("m"))
    carried = last.select("_range", F.lag(F.col("m._v")).over(Window.orderBy("_range")).alias("_carried"))  # one row a range
    return r.join(F.broadcast(carried), "_range").withColumn(name, F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(value).over(inside))).drop("_carried")


def carried(df: DataFrame, value: str, group: str, *keys: str, name: str = "carried") -> DataFrame:
    """df with the last value that isn't null at or before a row within its group, in the order of the keys.

    A range begins with one group only, so what is carried into it is a single value:
    the last one of that group in the ranges before. A group may thus fill many ranges.
    """
    r = ranged(df, group, *keys)
    inside = Window.partitionBy("_range", group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(group, *keys)
    ends = r.groupBy("_range").agg(F.min(group).alias("_first"), F.max(group).alias("_end"), F.max(F.when(F.col(value).isNotNull(), F.struct(place.alias("p"), F.col(value).alias("v")))).alias("_last"))
    # a value of the range's last group goes on; of any other it can't
    on = F.when(F.col(f"_last.p.{group}") == F.col("_end"), F.struct(F.col("_end").alias("g"), F.col("_last.v").alias("v")))
    before = F.last(on, ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    into = ends.select("_range", F.col("_first"), before.alias("_on")).where(F.col("_on.g") == F.col("_first")).select("_range", F.col("_first").alias("_group"), F.col("_on.v").alias("_v"))
    joined = r.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(F.broadcast(into), "_range", "left")
    return joined.withColumn(name, F.coalesce("_own", F.when(F.col(group) == F.col("_group"), F.col("_v")))).drop("_range", "_own", "_group", "_v")
