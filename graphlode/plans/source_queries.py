"""Sources and sinks: vector files, generated vectors, truth tables, result files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.knn import knn
from ..operators.results import has_nan, read_results, write_results
from ..registry import query
from ..sources.datasets import Dataset, as_ranks, get_data, load_files, prefix, reduced_truth, write_parquet_set
from ..sources.synthetic import vectors as generated
from ..sources.vecs import read_ground_truth, read_vecs, write_vecs
from ..storage import shared_dir
from .tables import exact_sql, knn_cte, near, table, vectors


def _truth_lists(spark, sf, k):
    found = near(spark, sf, k)
    return found.groupBy(F.col("src").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "dst"))), lambda e: e["dst"]).alias("ids"))


@query("src1_fvecs", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(x AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def _(spark, sf):
    path = shared_dir(spark, "fvecs")
    write_vecs(vectors(spark, sf), path)
    return read_vecs(spark, path).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("v"))


@query("src1_load_files", f"WITH {knn_cte(8)} SELECT src AS query_id, CAST(slot + 1 AS INTEGER) AS rank, dst AS vec_id FROM knn WHERE slot < 5")
def _(spark, sf):
    base, truth = shared_dir(spark, "fvecs"), shared_dir(spark, "ivecs")
    write_vecs(vectors(spark, sf), base)
    write_vecs(_truth_lists(spark, sf, 8), truth, "i", "query_id", "ids")
    return load_files(spark, 64, 5, [base, base, truth]).truth


@query("src2_ivecs", f"WITH {knn_cte(8)} SELECT src AS query_id, CAST(slot + 1 AS INTEGER) AS rank, dst AS vec_id FROM knn")
def _(spark, sf):
    path = shared_dir(spark, "ivecs")
    write_vecs(_truth_lists(spark, sf, 8), path, "i", "query_id", "ids")
    return as_ranks(read_vecs(spark, path, "i"))


@query("src9_stored_set", f"WITH {knn_cte(5)} SELECT src AS query_id, CAST(slot + 1 AS INTEGER) AS rank, dst AS vec_id FROM knn")
def _(spark, sf):
    root, v = shared_dir(spark, "sets"), vectors(spark, sf)
    truth = near(spark, sf, 5).select(F.col("src").alias("query_id"), (F.col("slot") + 1).cast("int").alias("rank"), F.col("dst").alias("vec_id"))
    write_parquet_set(Dataset(v, v.withColumnRenamed("vec_id", "query_id"), truth), root, "NormalData")
    return get_data(spark, "NormalData", root).truth


@query("src4_one_based_truth", f"WITH {knn_cte(5)} SELECT src AS query_id, CAST(slot + 1 AS INTEGER) AS rank, dst AS vec_id FROM knn")
def _(spark, sf):
    stored = near(spark, sf, 5).select(F.col("src").alias("query_id"), (F.col("slot") + 1).cast("int").alias("rank"), (F.col("dst") + 1).alias("vec_id"))
    return read_ground_truth(stored)


def _uniform(seed: str, a: str = "i", b: str = "j") -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {a} || ':' || {b}), 1, 8) AS BIGINT) / 4294967296.0)"


@query("src7_uniform", f"SELECT CAST(i AS BIGINT) AS vec_id, CAST(j - 1 AS INTEGER) AS pos, round(CAST(CAST({_uniform('base')} AS FLOAT) AS DOUBLE), 5) AS v FROM (SELECT unnest(range(0, (SELECT count(*) FROM supplier))) AS i) t, range(1, 9) u(j)")
def _(spark, sf):
    out = generated(spark, table(spark, sf, "supplier").count(), 8, normal=False).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return out.select("vec_id", "pos", F.round(F.col("x").cast("double"), 5).alias("v"))


@query(
    "src7_normal",
    f"SELECT CAST(i AS BIGINT) AS vec_id, CAST(j - 1 AS INTEGER) AS pos, round(CAST(CAST(sqrt(-2.0 * ln(1.0 - {_uniform('basea')})) * cos(2 * pi() * {_uniform('baseb')}) AS FLOAT) AS DOUBLE), 4) AS v FROM (SELECT unnest(range(0, (SELECT count(*) FROM supplier))) AS i) t, range(1, 9) u(j)",
)
def _(spark, sf):
    out = generated(spark, table(spark, sf, "supplier").count(), 8).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return out.select("vec_id", "pos", F.round(F.col("x").cast("double"), 4).alias("v"))


_NORMAL = "CAST(sqrt(-2.0 * ln(1.0 - {a})) * cos(2 * pi() * {b}) AS FLOAT)".format(a=_uniform("basea"), b=_uniform("baseb"))


@query(
    "src8_generated_truth",
    f"""WITH embeddings AS MATERIALIZED (SELECT CAST(i AS BIGINT) AS vec_id, list({_NORMAL} ORDER BY j) AS embedding FROM (SELECT unnest(range(0, (SELECT count(*) FROM supplier))) AS i) t, range(1, 17) u(j) GROUP BY i)
    SELECT query_id, rank, vec_id FROM ({exact_sql(10)})""",
)
def _(spark, sf):
    v = generated(spark, table(spark, sf, "supplier").count(), 16)  # as many rows as the table has
    return knn(v, v.withColumnRenamed("vec_id", "query_id"), 10).select("query_id", "rank", "vec_id")


@query("src9_prefix", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id < (SELECT count(*) // 3 FROM embeddings)")
def _(spark, sf):
    v = vectors(spark, sf)
    return prefix(v, v.count() // 3).select("vec_id", F.size("embedding").alias("dim"))


@query("src10_in_memory", exact_sql(3))
def _(spark, sf):
    """A numpy matrix as a table: any memory layout, since rows are copied by value."""
    import pyarrow as pa

    held = vectors(spark, sf).orderBy("vec_id").toArrow()
    x = np.asfortranarray(np.array(held["embedding"].to_pylist(), np.float32))
    v = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(np.ascontiguousarray(x)), pa.list_(pa.float32()))}))
    return knn(v, v.withColumnRenamed("vec_id", "query_id"), 3).withColumn("dist", F.round("dist", 6))


_SMALL = "SELECT 'builder' || (l_suppkey % 5) AS builder_type, CAST(l_linenumber AS INTEGER) AS k, CAST(l_discount AS DOUBLE) AS recall, CAST(l_extendedprice AS DOUBLE) AS qps FROM lineitem"


def _results(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("builder"), F.col("l_suppkey") % 5).alias("builder_type"), F.col("l_linenumber").cast("int").alias("k"), F.col("l_discount").cast("double").alias("recall"), F.col("l_extendedprice").cast("double").alias("qps"))


@query("snk1_result_files", _SMALL)
def _(spark, sf):
    path = shared_dir(spark, "results")
    write_results(_results(spark, sf), path, "dataset=lineitem\nmetric=price")
    return read_results(spark, path, "builder_type string, k int, recall double, qps double")


@query("snk1_nan_check", f"SELECT coalesce(bool_or(recall IS NULL OR isnan(recall)), false) AS recall_nan, coalesce(bool_or(qps IS NULL OR isnan(qps)), false) AS qps_nan FROM ({_SMALL})")
def _(spark, sf):
    return has_nan(_results(spark, sf))


@query("rel2_reduced_truth", f"WITH {knn_cte(8)} SELECT src AS query_id, CAST(slot + 1 AS INTEGER) AS rank, dst AS vec_id FROM knn WHERE slot < 3")
def _(spark, sf):
    truth = near(spark, sf, 8).select(F.col("src").alias("query_id"), (F.col("slot") + 1).cast("int").alias("rank"), F.col("dst").alias("vec_id"))
    return reduced_truth(truth, 3)
