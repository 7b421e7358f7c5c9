import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlode.operators import beam, kernels
from graphlode.operators.knn import knn_graph
from graphlode.operators.sharded import index_from_edges, search
from graphlode.sources.synthetic import vectors as generated


@pytest.fixture(scope="module")
def table(spark):
    """Vectors, their 6-nearest edges, and both in memory."""
    v = generated(spark, 300, 8, "normal").cache()
    edges = knn_graph(v, 6).cache()
    x = np.array([r.embedding for r in sorted(v.collect())], np.float64)
    lists = [[] for _ in range(300)]
    for e in sorted(edges.collect(), key=lambda e: (e.src, e.slot)):
        lists[e.src].append(e.dst)
    return v, edges, x, lists


def asked(v, n=20):
    return v.where(F.col("vec_id") % (300 // n) == 0).withColumnRenamed("vec_id", "query_id")


def rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.dist, r.vec_id))
    return out


@pytest.mark.parametrize("how", [{"ef": 50}, {"ef": 1, "k": 1}, {"ef": 12, "max_frontier": 4}, {"ef": 300}, {"eps": 0.2}])
def test_equals_the_search_in_memory(table, how):
    v, edges, x, lists = table
    k = how.get("k", 10)
    got = rows(search(index_from_edges(v, edges, [0, 7]), asked(v), **{"k": k, **how}))
    for q, found in got.items():
        if "eps" in how:
            want = kernels.range_search(x, lists, x[q], [0, 7], k, how["eps"])
        else:
            want = kernels.greedy_search(x, lists, x[q], [0, 7], k, how["ef"], how.get("max_frontier"))
        assert found == want
    assert len(got) == 20


def test_what_is_fetched_ahead_changes_nothing(table):
    v, edges, _, _ = table
    queries = asked(v, 5).withColumn("entries", F.array(F.lit(3).cast("long")))
    assert rows(beam.walk(v, edges, queries, 5, 30, ahead=4)) == rows(beam.walk(v, edges, queries, 5, 30, ahead=100))


def test_levels_are_walked_down(table):
    v, edges, x, lists = table
    sub = v.where("vec_id % 5 = 0")
    upper = knn_graph(sub, 4).select("src", "dst", "slot")
    own = [[] for _ in range(60)]
    for e in sorted(upper.collect(), key=lambda e: (e.src, e.slot)):
        own[e.src // 5].append(e.dst // 5)
    index = beam.GraphIndex(v, [beam.GraphLevel(edges.select("src", "dst", "slot"), [0]), beam.GraphLevel(upper, [0])])
    got = rows(search(index, asked(v), 5, 20, ef_higher=3))
    for q, found in got.items():
        assert found == kernels.layered_search(x, [(np.arange(300), lists, np.arange(300)), (np.arange(0, 300, 5), own, np.arange(0, 300, 5))], x[q], 5, 20, 3)
    assert rows(search(index, asked(v), 5, 20, from_level=0)) == rows(search(index_from_edges(v, edges), asked(v), 5, 20))


def test_odd_tables(spark, table):
    v, edges, _, _ = table
    few = asked(v, 3)
    assert search(index_from_edges(v.limit(0), edges), few, 3).count() == 0
    assert search(index_from_edges(v, edges), few.limit(0), 3).count() == 0
    # entries without edges, edges to rows that are not there, repeated edges
    alone = search(index_from_edges(v, edges.where("src < 0"), [4]), few, 3)
    assert {(r.rank, r.vec_id) for r in alone.collect()} == {(1, 4)}
    astray = edges.select("src", "dst", "slot").unionByName(spark.createDataFrame([(0, 9999, 0), (0, 9999, 1)], "src long, dst long, slot int")).unionByName(edges.select("src", "dst", "slot"))
    assert rows(search(index_from_edges(v, astray), few, 5, 300)) == rows(search(index_from_edges(v, edges), few, 5, 300))
