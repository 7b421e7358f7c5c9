"""Generated vectors: each value depends on seed, row and column alone, so any split of the work gives the same table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeded import uniform


def _values(seed: str, dim: int, normal: bool) -> Column:
    def value(j: Column) -> Column:
        if not normal:
            return uniform(seed, F.col("id"), j)
        u, v = uniform(f"{seed}a", F.col("id"), j), uniform(f"{seed}b", F.col("id"), j)
        return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)

    return F.transform(F.sequence(F.lit(1), F.lit(dim)), value)


def vectors(spark: SparkSession, n: int, dim: int, seed: str = "base", normal: bool = True) -> DataFrame:
    """vec_id, embedding: standard normal values, or uniform ones in [0, 1)."""
    return spark.range(n).select(F.col("id").alias("vec_id"), _values(seed, dim, normal).cast("array<float>").alias("embedding"))


def data_and_queries(spark: SparkSession, n_data: int, n_queries: int, dim: int, indexed: bool, normal: bool = True) -> tuple[DataFrame, DataFrame]:
    """Queries are the first rows of the data if indexed, else rows of their own."""
    data = vectors(spark, n_data, dim, "base", normal)
    queries = data.where(F.col("vec_id") < n_queries) if indexed else vectors(spark, n_queries, dim, "query", normal)
    return data, queries.withColumnRenamed("vec_id", "query_id")
