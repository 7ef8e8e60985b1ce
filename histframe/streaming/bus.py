"""Write events as a stream: a generation per scope, and subscribers that see each batch after its generation has moved.

An event is a row (scope, kind, name, oid). The generation of a scope is the number of
the last batch that wrote to it, so readers that hold an older one know that they are
stale. Generations are a Parquet table in the shared folder, a file a batch; a batch
that is done again after a failure writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "scope string, kind string, name string, oid string"


def generations(spark: SparkSession, table: str) -> DataFrame:
    """(scope, generation): the counter of every scope that was written to."""
    return spark.read.schema("scope string, generation long").parquet(table).groupBy("scope").agg(F.max("generation").alias("generation"))


def stale(held: DataFrame, current: DataFrame) -> DataFrame:
    """(scope, held, generation) of the held (scope, generation) that lie behind."""
    h = held.select("scope", F.col("generation").alias("held"))
    return h.join(current, "scope").where("held < generation")


def publish(events: DataFrame, table: str, checkpoint: str, subscriber: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start to publish a stream of events: each batch first moves the generations of its scopes, then goes to the subscriber."""

    def batch(rows: DataFrame, number: int) -> None:
        moved = rows.select("scope").distinct().withColumn("generation", F.lit(number + 1).cast("long"))
        moved.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if subscriber is not None:
            subscriber(rows, number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
