import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphlode.model import DEGParams, HNSWParams
from graphlode.operators import beam, kernels
from graphlode.operators.knn import knn, knn_graph
from graphlode.operators.nssg import connect_both_ways
from graphlode.operators.sharded import build_index, index_from_edges, search
from graphlode.plans.search_queries import _whole
from graphlode.sources.synthetic import vectors as generated


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.dist) for r in df.collect())


@pytest.fixture(scope="module")
def copies(spark):
    """Forty vectors five times: a 4-nearest graph is forty groups without an edge between them."""
    v = generated(spark, 40, 6).cache()
    return v.crossJoin(spark.range(5)).select((F.col("vec_id") + 40 * F.col("id")).alias("vec_id"), "embedding").cache()


def asked(v):
    return v.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")


@pytest.fixture
def no_walk(monkeypatch):
    def walked(*_, **__):
        raise AssertionError("every query would hold a state of all rows")

    monkeypatch.setattr(beam, "walk", walked)
    monkeypatch.setattr(kernels, "greedy_search", walked)


def test_a_graph_of_copies_is_searched_whole(copies, no_walk):
    edges = knn_graph(copies, 4)
    got = search(_whole(copies, edges, 6), asked(copies), 7, 200)
    assert rows(got) == rows(knn(copies, asked(copies), 7))
    assert search(index_from_edges(copies, edges), asked(copies), 7, 200).where("vec_id % 40 <> 0").count() == 0  # without the added edges: one group


def test_every_row_leads_to_every_row(copies):
    edges = connect_both_ways(knn_graph(copies, 4), copies, 0, 6).edges.cache()
    assert edges.groupBy("src", "slot").count().where("count > 1").count() == 0
    lists = [[] for _ in range(200)]
    for e in edges.collect():
        lists[e.src].append(e.dst)
    assert kernels.led_to(lists, [0]).all() and kernels.led_to(kernels.reversed_lists(lists), [0]).all()


def test_levels_above_change_nothing_where_all_is_one_part(copies, no_walk):
    bottom = connect_both_ways(knn_graph(copies, 4), copies, 0, 6).edges
    upper = beam.GraphLevel(knn_graph(copies.where("vec_id < 40"), 4), [3])
    index = beam.GraphIndex(copies, [beam.GraphLevel(bottom, [0]), upper])
    assert rows(search(index, asked(copies), 7, 200)) == rows(knn(copies, asked(copies), 7))


@pytest.mark.parametrize(("params", "how"), [(DEGParams(edges_per_vertex=6), {"ef": 300}), (DEGParams(edges_per_vertex=6), {"eps": 1e9}), (DEGParams(edges_per_vertex=6), {"eps": 0.1}), (HNSWParams(), {"ef": 300})])
def test_shards_are_scanned_as_they_are_searched(spark, monkeypatch, params, how):
    v = generated(spark, 300, 6).cache()
    index = build_index(v, params)
    got = rows(search(index, asked(v), 10, **how))
    monkeypatch.setattr("graphlode.operators.sharded._never_stops", lambda *_: False)
    assert got == rows(search(index, asked(v), 10, **how))


def test_searches_without_sql_ask_every_fiftieth_row(spark):
    found = entry.queries()["srch3_hill_climb"](spark, "/root/testdata/sf0.001")
    assert sorted(r.query_id for r in found.select("query_id").distinct().collect()) == list(range(0, 500, 50))
    assert "srch3_hill_climb" not in entry.oracle_sql()
