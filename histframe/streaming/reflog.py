"""The ref log as a stream: tips, retention and windows, with batch results as their measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event rows as a stream of log entries (ref, new_oid, ts, message) from a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.select(F.col("user_id").alias("ref"), F.col("event_id").alias("new_oid"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("message"))


def tips(log: DataFrame) -> DataFrame:
    """(ref, oid, entries): where each ref stands; the state is one row a ref."""
    return log.groupBy("ref").agg(F.max_by("new_oid", F.struct("ts", "new_oid")).alias("oid"), F.count("*").alias("entries"))


def windowed(log: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, message, n): entries per window; state is dropped once the watermark has passed."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", width), "message").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "message", "n")


def retained(log: DataFrame, cutoff: str) -> DataFrame:
    """Entries not older than a fixed time: no state, so batch and stream run one plan."""
    return log.where(F.col("ts") >= F.lit(cutoff).cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream has given once all there is has been read, as an in-memory table; for tests and small tables."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
