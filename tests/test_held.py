import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlode import registry
from graphlode.model import BruteforceKNNParams
from graphlode.operators import beam, evaluate, graphs, sharded
from graphlode.operators.hierarchy import build_hierarchy
from graphlode.operators.knn import knn, knn_graph
from graphlode.operators.nssg import connect
from graphlode.operators.sharded import index_from_edges
from graphlode.plans import search_queries
from graphlode.sources.synthetic import vectors as generated


@pytest.fixture(scope="module")
def copies(spark):
    """Thirty vectors four times, ids with gaps: a 3-nearest graph is thirty groups without an edge between them."""
    v = generated(spark, 30, 6)
    return v.crossJoin(spark.range(4)).select((3 * (F.col("vec_id") + 30 * F.col("id"))).alias("vec_id"), "embedding").cache()


def both(monkeypatch, made):
    """What is made with the ends of all edges held, and by joins."""
    one = made()
    monkeypatch.setattr(graphs, "HELD", 0)
    return one, made()


def test_edges_are_added_the_same_by_joins_and_held(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids = [3 * i for i in range(24)]
    edges = spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(3 * rng.integers(0, 20, (22, 2)))], "src long, dst long, slot int").cache()
    nodes = spark.createDataFrame([(i,) for i in ids], "vec_id long").cache()
    one, two = both(monkeypatch, lambda: connect(edges, nodes, 0, 2))
    assert sorted(map(tuple, one.edges.collect())) == sorted(map(tuple, two.edges.collect()))
    assert (one.added, one.beyond) == (two.added, two.beyond) and one.added


def test_reach_is_the_same_by_joins_and_held(copies, monkeypatch):
    index = lambda: index_from_edges(copies, knn_graph(copies, 3), [0, 9])
    led = lambda: (sorted(r.vec_id for r in beam.scanned(index(), 1).collect()), beam._led_to(index(), [0, 9], back=True)[1])
    one, two = both(monkeypatch, led)
    assert one == two and len(one[0]) == 8


def test_searches_that_see_the_same_rows_are_one_scan(spark, monkeypatch):
    """a scan for all subsets of levels, not one for each."""
    asked = []

    def counted(*args, **how):
        asked.append(args[2])
        return knn(*args, **how)

    monkeypatch.setattr(evaluate, "knn", counted)
    monkeypatch.setattr(beam, "knn", counted)
    rows = registry.queries()["agg12_level_subsets"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 4 and all(r.recall == 100.0 for r in rows) and asked == [10]


def test_a_graph_in_parts_shares_no_scan_with_a_whole_one(copies):
    """From above the bottom is entered elsewhere, so the levels of a graph in parts have rows of their own."""
    h = build_hierarchy(copies, [lambda v: knn_graph(v, 3)], [lambda nodes, edges, size: nodes.orderBy("vec_id").limit(size)], search_queries.HierarchyParams(higher_max_degree=4, min_n_vertices_layer=10))
    q = copies.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    truth = knn(copies, q, 4).select("query_id", "rank", "vec_id").cache()
    got = evaluate.level_wise(h, copies, q, truth, 4, 120).collect()
    assert [r.layer_count for r in got] == list(range(len(h.sizes), 0, -1)) and got[-1].recall < 100


@pytest.mark.parametrize("how", [{"ef": 20}, {"ef": 12, "max_frontier": 4}, {"eps": 0.2}])
def test_walks_are_the_same_in_rounds_and_held(spark, copies, monkeypatch, how):
    """Entries and ends that are no rows, repeated ends, ids with gaps."""
    edges = knn_graph(copies, 8).select("src", "dst", "slot")
    edges = edges.unionByName(spark.createDataFrame([(0, 1, 0), (0, 9, 8), (0, 9, 9), (7, 3, 0)], "src long, dst long, slot int")).cache()
    asked = copies.where("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.array(F.lit(0), F.lit(45), F.lit(1)).cast("array<long>").alias("entries"))
    rows = lambda: sorted(map(tuple, beam.walk(copies, edges, asked, 6, how.get("ef", 6), how.get("max_frontier"), how.get("eps")).collect()))
    one = rows()
    monkeypatch.setattr(beam, "HELD_MB", 0)
    assert one == rows() and len(one) == 36


def test_a_shard_takes_a_bounded_share_of_the_queries(spark, monkeypatch):
    """all queries of all shards were in one task each, however many."""
    v = generated(spark, 200, 5).cache()
    index, asked = sharded.build_index(v, BruteforceKNNParams(30), shard_rows=50), v.withColumnRenamed("vec_id", "query_id")
    rows = lambda: sorted(map(tuple, sharded.search(index, asked, 5, 200).collect()))
    want = rows()
    dealt = []
    monkeypatch.setattr(sharded, "QUERIES", 40)
    monkeypatch.setattr(sharded.F, "lit", lambda value, lit=F.lit: dealt.append(value) or lit(value))
    assert rows() == want and 5 in dealt  # parts of 40 of 200 queries
