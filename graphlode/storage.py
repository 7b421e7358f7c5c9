"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a local session without that setting gets a folder of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("graphlode.local.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphlode-")
        spark.conf.set("graphlode.local.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets a session that has not set it send `most` bytes at a time to Python: at its default of 64 MB batches of long texts take hundreds of MB outside the heap of each executor."""
    if spark.conf.get(BATCH_BYTES, "64m") in ("67108864b", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, most)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: cuts lineage, and lost executors do not matter to it."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
