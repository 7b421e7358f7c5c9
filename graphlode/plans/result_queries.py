"""Queries on result tables. The rows are those of lineitem under the names of a result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results
from ..registry import query
from .tables import rounded, table

_R = """r AS (SELECT 'builder' || (l_suppkey % 5) AS builder_type, CASE WHEN l_returnflag = 'A' THEN '3M' WHEN l_returnflag = 'N' THEN '10M' ELSE 'sift' END AS data_set,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 1 END AS INTEGER) AS k, CAST(1 AS INTEGER) AS higher_level_max_heap_size,
  CAST(CASE WHEN l_linestatus = 'O' THEN 50 ELSE 100 END AS INTEGER) AS max_heap_size, CAST(l_quantity AS INTEGER) % 6 + 1 AS layer_count,
  CAST(l_extendedprice AS DOUBLE) AS qps, CAST(l_discount AS DOUBLE) * 1000 AS recall, CAST(l_tax AS DOUBLE) AS elapsed_time,
  CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS seq, 'degree=' || (l_partkey % 50) AS params FROM lineitem)"""
_DS = "CASE WHEN data_set IN ('300K', '3M', '10M', '100M') THEN 'LAION-' || data_set ELSE data_set END"
_PLOT = f"""p AS (SELECT builder_type, {_DS} AS dataset, k, higher_level_max_heap_size AS hlmhs, max_heap_size AS mhs, layer_count AS layer,
  avg(qps) AS qps, avg(recall) AS recall, arg_min(elapsed_time, row(seq, elapsed_time)) AS build_time_raw FROM r GROUP BY ALL)"""


def _rows(spark, sf, higher=None):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("builder"), F.col("l_suppkey") % 5).alias("builder_type"), F.when(F.col("l_returnflag") == "A", "3M").when(F.col("l_returnflag") == "N", "10M").otherwise("sift").alias("data_set"),
        F.when(F.col("l_linenumber") % 2 == 0, 10).otherwise(1).alias("k"), (F.lit(1) if higher is None else higher).alias("higher_level_max_heap_size"), F.when(F.col("l_linestatus") == "O", 50).otherwise(100).alias("max_heap_size"),
        (F.col("l_quantity").cast("int") % 6 + 1).alias("layer_count"), F.col("l_extendedprice").cast("double").alias("qps"), (F.col("l_discount").cast("double") * 1000).alias("recall"),
        F.col("l_tax").cast("double").alias("elapsed_time"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("degree="), F.col("l_partkey") % 50).alias("params"),
    )


@query(
    "rel3_heap_sizes",
    """SELECT k, CAST(unnest(CASE k WHEN 1 THEN [10, 30, 50, 100, 200] WHEN 5 THEN [10, 30, 50, 100, 200] WHEN 10 THEN [10, 30, 50, 100, 150, 200] WHEN 20 THEN [20, 30, 40, 60, 100, 150, 200] WHEN 30 THEN [30, 40, 60, 100, 150, 200]
      WHEN 50 THEN [50, 75, 100, 150, 250] ELSE [k] END) AS INTEGER) AS max_heap_size FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS k FROM lineitem)""",
)
def _(spark, sf):
    return results.with_heap_sizes(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("k")).distinct())


@query("rel4_plot_rows", f"WITH {_R}, {_PLOT} SELECT builder_type, dataset, k, hlmhs, mhs, layer, round(qps, 6) AS qps, round(recall, 6) AS recall, build_time_raw FROM p")
def _(spark, sf):
    return rounded(results.plot_rows(_rows(spark, sf)), "qps", "recall")


@query(
    "rel4_top_layer",
    f"WITH {_R}, {_PLOT} SELECT builder_type, dataset, k, hlmhs, mhs, layer, round(qps, 6) AS qps, round(recall, 6) AS recall, build_time_raw FROM p WHERE builder_type <> 'builder3' QUALIFY layer = max(layer) OVER (PARTITION BY builder_type, dataset, k, hlmhs, mhs)",
)
def _(spark, sf):
    return rounded(results.plot_rows(_rows(spark, sf), True, {"builder_type": ("builder3",)}), "qps", "recall")


@query(
    "rel5_gains",
    f"""WITH {_R}, {_PLOT}, g AS (SELECT builder_type, dataset, k, hlmhs, mhs, arg_max(qps, layer) AS qt, arg_min(qps, layer) AS qb, arg_max(recall, layer) AS rt, arg_min(recall, layer) AS rb FROM p WHERE layer IN (1, 4, 5, 6) GROUP BY ALL)
    SELECT builder_type, dataset, k, hlmhs, mhs, round((qt - qb) / nullif(qb, 0) * 100, 6) AS qps_diff_percentage, round(qt - qb, 6) AS qps_diff, round((rt - rb) / nullif(rb, 0) * 100, 6) AS recall_diff_percentage,
    round(rt - rb, 6) AS recall_diff, round(rb, 6) AS recall_bottom, round(qb, 6) AS qps_bottom FROM g""",
)
def _(spark, sf):
    g = results.gains(results.plot_rows(_rows(spark, sf)))
    return rounded(g, *[c for c in g.columns if c.startswith(("qps", "recall"))])


@query("rel6_renamed", f"WITH {_R} SELECT builder_type, {_DS} AS dataset, seq FROM r")
def _(spark, sf):
    return results.renamed(_rows(spark, sf)).select("builder_type", "dataset", "seq")


@query("rel7_first_params", f"WITH {_R} SELECT builder_type, arg_min(params, row(seq, params)) AS params FROM r GROUP BY builder_type")
def _(spark, sf):
    return results.first_params(_rows(spark, sf))


@query("rel8_as_strings", f"WITH {_R} SELECT seq, CAST(k AS VARCHAR) AS k, CAST(layer_count AS VARCHAR) AS layer_count FROM r")
def _(spark, sf):
    return _rows(spark, sf).select("seq", F.col("k").cast("string").alias("k"), F.col("layer_count").cast("string").alias("layer_count"))


@query("rel9_union", f"WITH {_R} SELECT builder_type, seq FROM r UNION ALL SELECT builder_type, seq FROM r WHERE k = 10")
def _(spark, sf):
    rows = _rows(spark, sf)
    return results.union_results(rows, rows.where("k = 10")).select("builder_type", "seq")


@query("rel10_distinct_masked", f"WITH {_R} SELECT DISTINCT builder_type, data_set, max(layer_count) OVER (PARTITION BY builder_type) AS top FROM r WHERE k = 1 AND recall > 20")
def _(spark, sf):
    kept = _rows(spark, sf).where("k = 1 and recall > 20")
    return kept.groupBy("builder_type", "data_set").agg(F.max("layer_count").alias("t")).selectExpr("builder_type", "data_set", "max(t) over (partition by builder_type) as top")


@query("rel11_build_times", f"WITH {_R} SELECT builder_type, {_DS} AS dataset, round(avg(elapsed_time), 6) AS build_time FROM r GROUP BY ALL")
def _(spark, sf):
    return rounded(results.renamed(_rows(spark, sf)).groupBy("builder_type", "dataset").agg(F.avg("elapsed_time").alias("build_time")), "build_time")


@query(
    "rel11_level_compare",
    f"WITH {_R}, {_PLOT}, c AS (SELECT *, max(layer) OVER (PARTITION BY builder_type) AS top FROM p WHERE k = 10 AND hlmhs = 1) SELECT builder_type, dataset, mhs, layer, round(qps, 6) AS qps, round(recall, 6) AS recall FROM c WHERE layer IN (1, top)",
)
def _(spark, sf):
    return rounded(results.compare_levels(results.plot_rows(_rows(spark, sf)), 10, 1, True).select("builder_type", "dataset", "mhs", "layer", "qps", "recall"), "qps", "recall")


@query(
    "rel11_ef_compare",
    f"""WITH {_R.replace("CAST(1 AS INTEGER) AS higher", "CAST(l_partkey % 3 + 1 AS INTEGER) AS higher")}, {_PLOT}, c AS (SELECT *, max(layer) OVER () AS top FROM p WHERE k = 1)
    SELECT builder_type, dataset, CAST(hlmhs AS VARCHAR) AS hlmhs, mhs, layer, round(qps, 6) AS qps, round(recall, 6) AS recall FROM c WHERE layer IN (1, top)""",
)
def _(spark, sf):
    rows = _rows(spark, sf, (F.col("l_partkey") % 3 + 1).cast("int"))
    return rounded(results.compare_ef_higher(results.plot_rows(rows), 1, True).select("builder_type", "dataset", "hlmhs", "mhs", "layer", "qps", "recall"), "qps", "recall")


@query(
    "rel12_level_sizes",
    """SELECT DISTINCT dataset, CAST(i AS INTEGER) AS level, CAST(s[i] AS BIGINT) AS size FROM (SELECT dataset, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT dataset, CASE dataset WHEN '3M' THEN [100000, 3300, 150, 30] WHEN '10M' THEN [350000, 12000, 500, 30] WHEN 'sift' THEN [25000, 600, 40] END AS s FROM (SELECT CASE l_returnflag WHEN 'A' THEN '3M' WHEN 'N' THEN '10M' ELSE 'sift' END AS dataset FROM lineitem)))""",
)
def _(spark, sf):
    return results.with_level_sizes(_rows(spark, sf).select(F.col("data_set").alias("dataset")).distinct())
