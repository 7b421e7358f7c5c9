"""What the registered queries start from, and the pieces their SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import knn_graph
from ..storage import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def near(spark: SparkSession, sf_dir: str, degree: int) -> DataFrame:
    return staged(knn_graph(vectors(spark, sf_dir), degree), "knn-graph")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def knn_cte(k: int, name: str = "knn") -> str:
    """CTE: the exact k-NN graph (src, dst, dist, slot)."""
    return f"""{name} AS MATERIALIZED (
  SELECT src, dst, dist, CAST(rn - 1 AS INTEGER) AS slot FROM (
    SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM (
      SELECT a.vec_id AS src, b.vec_id AS dst, {dist("a.embedding", "b.embedding")} AS dist
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rn <= {k})"""


def random_cte(degree: int, seed: str, name: str = "rg") -> str:
    """CTE: the hash-drawn random graph (src, dst, slot)."""
    tries = degree * 2 + 20
    return f"""{name} AS MATERIALIZED (
  SELECT src, dst, CAST(rn - 1 AS INTEGER) AS slot FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY t) AS rn FROM (
      SELECT src, dst, min(t) AS t FROM (
        SELECT vec_id AS src, t, CAST('0x' || substr(md5('{seed}:' || vec_id || ':' || t), 1, 12) AS BIGINT) % (SELECT count(*) FROM embeddings) AS dst
        FROM embeddings, range(0, {tries}) r(t)) WHERE src <> dst GROUP BY src, dst)) WHERE rn <= {degree})"""


def exact_sql(k: int) -> str:
    """Exact k nearest rows of each row, itself included."""
    return f"""
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM (
  SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rn FROM (
    SELECT q.vec_id AS query_id, b.vec_id, {dist("q.embedding", "b.embedding")} AS dist FROM embeddings q, embeddings b)) WHERE rn <= {k}"""
