"""What the corpus operators share: stored tables and input projection."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, small_batches, staged

__all__ = ["documents", "frugal", "frugal_group", "join_groups", "read", "release", "shared_dir", "staged"]


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), a null text as the empty one."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Returns to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow after which its worker returns what it has freed: workers live on from stage to stage, and what allocators keep of large arrays adds up."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """The same for applyInArrow, after each group."""

    def wrapped(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        release()
        return out

    # Spark tells the forms of the function by its number of parameters
    return (lambda left, right: wrapped(left, right)) if run.__code__.co_argcount == 2 else (lambda table: wrapped(table))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """rows left-joined with groups (stored; a row for each value of keys, `size` of the `total` rows or more behind it).

    Groups of more than a `share`-th of all rows, of which there are few however large the table, go to all tasks. The rest is shuffled
    by its keys, so no task gets more of one group than that.
    """
    hot = groups.where(F.col(size) * share > total)
    if hot.isEmpty():
        return rows.join(groups, keys, "left")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(groups.where(F.col(size) * share <= total), keys, "left"))
