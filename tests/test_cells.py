import numpy as np
import pytest

from graphlode.model import BruteforceKNNParams, DEGParams, EfannaParams, HierarchyParams, RNNParams
from graphlode.operators.cells import cell_edges, cell_graph, degree_of
from graphlode.operators.experiments import Level, Select
from graphlode.operators.graphs import reachable
from graphlode.operators.hierarchy import build_hierarchy, to_index
from graphlode.operators.knn import knn
from graphlode.operators.sharded import search
from graphlode.sources.synthetic import vectors as generated


@pytest.mark.parametrize("params", [DEGParams(edges_per_vertex=6, max_build_heap_size=12), EfannaParams(k=6, l=12, iter=3, s=6, r=12)])
def test_one_graph_of_many_cells(spark, params):
    v = generated(spark, 240, 5, "normal").cache()
    g = cell_graph(v, params, cell_rows=60)
    assert reachable(g.edges, 0).count() == 240
    over = sum(max(r["count"] - degree_of(params), 0) for r in g.edges.groupBy("src").count().collect())
    assert over <= g.beyond and g.edges.groupBy("src", "dst").count().where("count > 1").isEmpty()


def test_rows_that_are_equal_share_cells_of_bounded_size(spark):
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(i % 7), float(i % 11)]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    edges = cell_edges(v, BruteforceKNNParams(4), cell_rows=20)
    assert edges.groupBy("src").count().count() == 150
    assert reachable(cell_graph(v, RNNParams(6, 4, 2, 2), cell_rows=20).edges, 0).count() == 150


def test_hierarchies_of_cells_keep_ids_in_their_level(spark):
    v = generated(spark, 300, 6, "normal").cache()
    levels = [Level(BruteforceKNNParams(8), Select("random"), cell_rows=100)]
    h = build_hierarchy(v, [x.builder() for x in levels], [x.selector for x in levels], HierarchyParams(higher_max_degree=5, min_n_vertices_layer=10, create_artificial_hub_nodes=3))
    assert len(h.sizes) >= 3
    nodes = h.nodes.select("level", "global_id")
    for end in ("src", "dst"):
        assert h.edges.join(nodes.withColumnRenamed("global_id", end), ["level", end], "left_anti").isEmpty()
    queries = v.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    found, want = (sorted((r.query_id, r.vec_id) for r in df.collect()) for df in (search(to_index(h, v), queries, 5, 300), knn(v, queries, 5)))
    assert found == want


def test_levels_of_exact_neighbours_are_no_single_task(spark, monkeypatch):
    """Beyond a shard the level's graph comes from tables, with the edges of one shard."""
    from graphlode.operators import sharded

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    edges = lambda: {tuple(r) for r in Level(BruteforceKNNParams(5)).builder()(v).select("src", "dst", "slot").collect()}
    one = edges()
    monkeypatch.setattr(sharded, "SHARD_ROWS", 20)
    monkeypatch.setattr(sharded, "local_builder", lambda *_: lambda x: pytest.fail("all rows in one task"))
    assert edges() == one and len(one) == 300
