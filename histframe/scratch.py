"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, list[str]] = {}
#: A written table has at most so many files for each core: enough that tasks stay short, without thousands of small ones.
WAVES = 16


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = spark.conf.get("histframe.scratch.dir", None)
        if not known:
            known = tempfile.mkdtemp(prefix="histframe-")
            spark.conf.set("histframe.scratch.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str, scope: str = "session") -> DataFrame:
    """df as a Parquet table in the shared folder, read again; it stays until ``release(scope)`` or the driver's end."""
    path = f"{shared_dir(df.sparkSession)}/histframe/{name}-{uuid.uuid4().hex[:12]}"
    df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    _held.setdefault(scope, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scope: str = "session") -> None:
    """Delete the scope's tables; DataFrames that still read them must be done."""
    for path in _held.pop(scope, []):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession() if _held else None
    for scope in list(_held) if spark else []:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark, scope)
