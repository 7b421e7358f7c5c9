"""Statistics of graphs and recall of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vec_id, degree); nodes without edges count with 0."""
    d = edges.groupBy(F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("vec_id").join(d, "vec_id", "left").select("vec_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = F.col("degree")
    return out_degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum(d).alias("n_edges"), F.max(d).alias("max_degree"), F.min(d).alias("min_degree"), F.avg(d).alias("avg_degree"), F.stddev_pop(d).alias("std_degree")
    )


def level_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each level of nodes (level, vec_id) and edges (level, src, dst): degrees' minimum, maximum and mean."""
    d = edges.groupBy("level", F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.select("level", "vec_id").join(d, ["level", "vec_id"], "left").select("level", F.coalesce("degree", F.lit(0)).alias("degree"))
    return joined.groupBy("level").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))


def total_degree(levels: DataFrame) -> DataFrame:
    """The unweighted mean of the levels' means."""
    return levels.agg(F.avg("avg_degree").alias("total_avg_out_degree"))


def edge_lengths(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return edges.groupBy(*by).agg(F.avg("dist").alias("avg_edge_dist"), F.min("dist").alias("min_edge_dist"), F.max("dist").alias("max_edge_dist"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges, and how many repeat another of the same ends."""
    per = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def edge_faults(edges: DataFrame, n: int) -> DataFrame:
    return edges.agg(
        F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("has_loops"), F.coalesce(F.bool_or(F.col("dst") >= n), F.lit(False)).alias("has_escaping_edges")
    )


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Per cent of the true pairs (query_id, vec_id) that were found; sets, so repeats do not count."""
    t, f = truth.select("query_id", "vec_id").distinct(), found.select("query_id", "vec_id").distinct()
    hits = t.join(f, ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    nq = truth.agg(F.count_distinct("query_id").alias("nq"))
    return hits.join(F.broadcast(nq)).select((F.col("hits") / (F.col("nq") * k) * 100).alias("recall"))  # two rows of totals
