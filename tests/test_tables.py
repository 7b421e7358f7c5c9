import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlode.functions.distance import cos_at, occludes
from graphlode.model import LID, RESULT_COLUMNS, BruteforceKNNParams, DEGParams, EfannaParams, HierarchyParams, HNSWParams, KeepEdges, NSSGParams, RNGGParams
from graphlode.operators import graphs, selectors, stats
from graphlode.operators import knn as blocks
from graphlode.operators import sharded
from graphlode.operators.experiments import Experiment, Level, Select, describe_levels, preset, run_experiments
from graphlode.operators.hierarchy import build_hierarchy, layer_ids, level_plan, merge_under_hnsw, next_layer_ids, to_index, top_entries, up_to_level
from graphlode.operators.knn import knn, knn_graph
from graphlode.operators.nndescent import nn_descent
from graphlode.operators.results import gains, has_nan, latex_table, plot_rows, read_results, write_results
from graphlode.operators.sharded import build_index, index_edges, index_from_edges, index_nodes, neighbours_of, search
from graphlode.sources.datasets import Dataset
from graphlode.sources.synthetic import vectors as generated


@pytest.fixture(scope="module")
def vectors(spark):
    return generated(spark, 150, 6).cache()


@pytest.fixture(scope="module")
def near(vectors):
    return knn_graph(vectors, 8).cache()


def as_sets(df, a, b):
    out = {}
    for r in df.collect():
        out.setdefault(r[a], set()).add(r[b])
    return out


def test_knn_by_brute_force(vectors):
    rows = sorted(vectors.collect())
    x = np.array([r.embedding for r in rows], float)
    got = as_sets(knn(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 5), "query_id", "vec_id")
    grid = as_sets(knn(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 5, broadcast_mb=0, cell_rows=40), "query_id", "vec_id")
    for i in range(len(x)):
        assert got[i] == grid[i] == set(np.argsort(((x - x[i]) ** 2).sum(1))[:5].tolist())


def test_blocks_of_neighbours_are_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 64)
    rng = np.random.default_rng(2)
    for offset, copies in ((0.0, 1), (1e6, 1), (0.0, 50)):
        x = np.tile(offset + rng.normal(size=(600 // copies, 6)), (copies, 1))
        ids = rng.permutation(len(x))
        for skip in (False, True):
            found = list(blocks.tops(ids, x, ids, x, 5, skip))
            assert max(len(f[0]) for f in found) <= 5 * blocks.QUERIES < len(x) * 5
            owner, near, _ = map(np.concatenate, zip(*found, strict=True))
            for i in (0, 300, 599):
                d = ((x - x[i]) ** 2).sum(1)
                order = [int(j) for j in ids[np.lexsort((ids, d))] if not skip or j != ids[i]]
                assert near[owner == ids[i]].tolist() == order[:5]


@pytest.mark.parametrize("params", [BruteforceKNNParams(5), *(RNGGParams(5, prune_extend_degree=12, prune=m) for m in KeepEdges)])
def test_beyond_one_shard_a_graph_on_tables_is_the_same(vectors, monkeypatch, params):
    odd = vectors.select((F.col("vec_id") * 3 + 7).alias("vec_id"), "embedding")  # ids with gaps
    one = build_index(odd, params)
    monkeypatch.setattr(sharded, "SHARD_ROWS", 40)
    many = build_index(odd, params)
    assert sorted(index_edges(many).collect()) == sorted(index_edges(one).collect())
    assert sorted(index_nodes(many).collect()) == sorted(index_nodes(one).collect())
    assert sorted(neighbours_of(many, 0, 10).collect()) == sorted(neighbours_of(one, 0, 10).collect())


def test_grid_cells_grow_with_the_table():
    assert blocks.cells_of(150, 40) == 4
    assert blocks.cells_of(100_000, 200) == blocks.GRID
    assert blocks.cells_of(6_000_000, 200) == 6_000_000 // blocks.GRID_ROWS


def test_knn_of_few_and_equal_rows(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in knn(v, v.withColumnRenamed("vec_id", "query_id").where("query_id = 2"), 9).orderBy("rank").collect()] == [(2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]
    assert knn_graph(v, 9).groupBy("src").count().where("count != 3").count() == 0
    assert knn(v.limit(0), v.withColumnRenamed("vec_id", "query_id"), 2).count() == 0


def test_undefined_angle_hides_nothing(spark):
    row = spark.range(1).select(cos_at(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("c"), occludes(F.lit(0.0), F.lit(1.0), F.lit(1.0), 0.5).alias("o")).head()
    assert row.c is None and row.o is False


@pytest.mark.parametrize("mode", list(KeepEdges))
def test_pruning_modes(vectors, mode):
    wide = graphs.rng_graph(vectors, RNGGParams(degree=10, prune_extend_degree=20, prune=mode))
    counts = {r["count"] for r in wide.groupBy("src").count().collect()}
    assert counts == {10}
    with pytest.raises(ValueError):
        graphs.rng_graph(vectors, RNGGParams(degree=10, prune_extend_degree=5))


def star_and_chain(spark):
    star = spark.createDataFrame([(0, i, 0) for i in range(1, 6)], "src long, dst long, slot int")
    chain = spark.createDataFrame([(i, i + 1, 0) for i in range(5)], "src long, dst long, slot int")
    return star, chain, spark.createDataFrame([(i,) for i in range(6)], "vec_id long")


def test_reach_and_reachable(spark):
    star, chain, nodes = star_and_chain(spark)
    assert as_sets(graphs.reach(chain, nodes, 2), "start", "node")[1] == {1, 2, 3}
    assert {(r.node, r.hops) for r in graphs.reachable(chain, 2).collect()} == {(2, 0), (3, 1), (4, 2), (5, 3)}
    assert graphs.reachable(star, 3).count() == 1


def sequential_flood(edges, order, r):
    flooded, chosen = set(), []
    for v in order:
        if v in flooded:
            continue
        chosen.append(v)
        level = {v}
        for _ in range(r):
            level = {d for s, d in edges if s in level}
            flooded |= level
    return chosen


@pytest.mark.parametrize("r", [1, 2])
def test_flooding_equals_the_sequential_scan(spark, vectors, near, r):
    from graphlode.functions.seeded import shuffled

    order = [x.vec_id for x in vectors.where("vec_id != 0").orderBy(shuffled("flood", "vec_id")).collect()]
    edges = [(e.src, e.dst) for e in near.collect()]
    want = sequential_flood(edges, order, r)
    assert {x.vec_id for x in selectors.flooding(vectors, near, r).collect()} == {*want, 0}
    cut = selectors.flooding(vectors, near, r, 5)
    assert {x.vec_id for x in cut.collect()} == {*want[:4], 0}


@pytest.mark.parametrize("size", [None, 1, 40, 150, 151])
def test_selector_sizes(vectors, near, size):
    n = 150
    want = n // 2 if size is None or size >= n else size
    for df in (selectors.random_subset(vectors, size), selectors.hub_nodes(vectors, near, size, 20)):
        ids = [r.vec_id for r in df.collect()]
        assert len(ids) == len(set(ids)) == want and 0 in ids
    ids = [r.vec_id for r in selectors.flooding_repeat(vectors, near, 1, size).collect()]
    assert len(ids) == len(set(ids)) == min(size or 1, n) and 0 in ids


def test_level_plan():
    assert level_plan(500, HierarchyParams()) == [50]
    assert level_plan(2000, HierarchyParams()) == [60, 50]
    assert level_plan(10_000, HierarchyParams()) == [300, 50]
    assert level_plan(40, HierarchyParams(max_layers=1)) == []


def test_hierarchy(spark, vectors):
    params = HierarchyParams(higher_max_degree=4, min_n_vertices_layer=10, create_artificial_hub_nodes=2)
    h = build_hierarchy(vectors, [lambda v: knn_graph(v, 40)], [lambda nodes, edges, size: selectors.random_subset(nodes, size)], params)
    assert h.sizes[0] == 150 and len(h.sizes) >= 3 and sorted(h.sizes, reverse=True) == h.sizes
    assert h.nodes.where("level > 0").join(h.nodes.selectExpr("level + 1 as level", "local_id as parent_local_id", "global_id as below"), ["level", "parent_local_id"]).where("global_id != below").count() == 0
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    want = as_sets(knn(vectors, queries, 5), "query_id", "vec_id")
    assert as_sets(search(to_index(h, vectors), queries, 5, 150), "query_id", "vec_id") == want
    assert as_sets(search(to_index(up_to_level(h, 0), vectors), queries, 5, 150), "query_id", "vec_id") == want
    assert top_entries(h, 3) == [0, 1, 2]
    merged = merge_under_hnsw(vectors, knn_graph(vectors, 40), selectors.random_subset(vectors, 40), HNSWParams(4, 8))
    assert as_sets(search(to_index(merged, vectors), queries, 5, 150), "query_id", "vec_id") == want


@pytest.mark.parametrize("n", [1, 2, 50, 51])
def test_small_hierarchies(spark, n):
    v = generated(spark, n, 4)
    h = build_hierarchy(v, [lambda x: knn_graph(x, 10)], [lambda nodes, edges, size: selectors.random_subset(nodes, size)])
    assert h.sizes[0] == n and (n > 50 or h.edges.count() == n * (n - 1))


def test_shards_merge(vectors):
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    from graphlode.model import BruteforceKNNParams

    index = build_index(vectors, BruteforceKNNParams(20), shard_rows=40)
    assert index.select("shard").distinct().count() > 2
    assert as_sets(search(index, queries, 5, 150), "query_id", "vec_id") == as_sets(knn(vectors, queries, 5), "query_id", "vec_id")
    assert neighbours_of(index, 0, 3).count() == 20


def test_nn_descent_nears_the_truth(vectors):
    got = as_sets(nn_descent(vectors, EfannaParams(k=8, l=20, iter=5, s=8, r=20)), "src", "dst")
    want = as_sets(knn_graph(vectors, 8), "src", "dst")
    assert sum(len(got[i] & want[i]) for i in want) / (8 * len(want)) > 0.9


def test_statistics(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "vec_id long")
    edges = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 2, 1.0), (2, 9, 4.0)], "src long, dst long, dist double")
    s = stats.graph_stats(nodes, edges).head()
    assert (s.n_nodes, s.n_edges, s.max_degree, s.min_degree) == (4, 4, 3, 0)
    assert tuple(stats.edge_counts(edges).head()) == (4, 1)
    assert tuple(stats.edge_faults(edges, 4).head()) == (True, True)
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "query_id long, vec_id long")
    found = spark.createDataFrame([(0, 1), (0, 1), (1, 3), (1, 4)], "query_id long, vec_id long")
    assert stats.recall(truth, found, 2).head()[0] == 75.0


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "builder_type string, qps double")
    write_results(rows, str(tmp_path / "r"), "k=1")
    back = read_results(spark, str(tmp_path / "r"), "builder_type string, qps double")
    assert back.count() == 2 and has_nan(back, ("qps",)).head()[0]
    assert r"\begin{tabular}" in latex_table(rows.limit(1))


def test_queries_as_a_stream(spark, vectors, near, tmp_path):
    from graphlode.streaming.queries import answer_stream

    vectors.limit(20).withColumnRenamed("vec_id", "query_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, embedding array<float>").parquet(str(tmp_path / "in"))
    answer_stream(stream, index_from_edges(vectors, near), 3, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_rows_are_numbered_across_ranges(spark):
    ids = [7 * i % 1000 - 20 for i in range(300)]
    subset = spark.createDataFrame([(i,) for i in ids], "vec_id long").repartition(5)
    assert [tuple(r) for r in selectors.numbered(subset).orderBy("local_id").collect()] == list(enumerate(sorted(ids)))
    assert selectors.numbered(subset.limit(0)).count() == 0


def test_copies_of_a_shard_share_its_queries(vectors, near):
    index, asked = build_index(vectors, BruteforceKNNParams(20)), vectors.withColumnRenamed("vec_id", "query_id")
    rows = [sorted(map(tuple, search(index, asked, 5, 150, copies=c).collect())) for c in (1, 3, None)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 750
    by_range = search(index, asked, 5, eps=1e9, copies=2).select("query_id", "vec_id").collect()
    assert {tuple(r) for r in by_range} == {(q, v) for q, _, v, _ in rows[0]}


def test_searches_start_at_the_first_nodes_of_the_top(vectors):
    h = build_hierarchy(vectors, [lambda v: knn_graph(v, 8)], [lambda nodes, edges, size: selectors.random_subset(nodes, size)], HierarchyParams(higher_max_degree=5, min_n_vertices_layer=10))
    top = len(h.sizes) - 1
    for ef in (1, 3):
        first = {r.local_id: r.global_id for r in layer_ids(h, top).collect()}
        assert to_index(h, vectors, ef).levels[top].entries == [first[i] for i in top_entries(h, ef)]
    assert {tuple(r) for r in layer_ids(h, 0).collect()} == {(i, i) for i in range(150)}
    places = {r.local_id: r.next_local_id for r in next_layer_ids(h, 1).collect()}
    assert {r.local_id: r.global_id for r in layer_ids(h, 1).collect()} == places


def test_experiments_give_full_rows_and_outlive_a_failure(spark, vectors, tmp_path):
    asked = vectors.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    data = Dataset(vectors, asked, knn(vectors, asked, 10).select("query_id", "rank", "vec_id"))
    made = [Experiment("broken", [Level(NSSGParams(), Select("nothing"))]), Experiment("KNN", [Level(BruteforceKNNParams(40))], flat=True, ks=(1, 10), heap_sizes=[150])]
    rows = run_experiments(spark, data, "3M", made, str(tmp_path / "results")).orderBy("seq").collect()
    assert [(r.seq, r.builder_type, r.k, r.max_heap_size, r.layer_count, r.recall, r.n_vertices, r.n_edges, r.total_avg_out_degree, r.avg_out_degrees, r.min_max_out_degrees, r.params) for r in rows] == [
        (i, "KNN", k, 150, 1, 100.0, "[150]", "6000", "40.0", "[40.0]", "[(40, 40)]", "degree=40|batch_size=1000") for i, k in enumerate((10, 1))
    ]
    assert read_results(spark, str(tmp_path / "results")).count() == 2
    assert latex_table(gains(plot_rows(spark.createDataFrame(rows, "seq long, " + RESULT_COLUMNS))).select("builder_type", "k")).count("KNN") == 2


def test_presets():
    assert preset("DEG", "audio")[0] == DEGParams(lid=LID.LOW, edges_per_vertex=30, max_build_heap_size=40)
    assert preset("NSSG", "LAION-10M") == (NSSGParams(range=60, l=400), EfannaParams(150, 150, 3, 10, 100))
    assert preset("HNSW", "unheard of") == (HNSWParams(), None) and preset("RNN", "sift")[0].reduce_degree == 40
    with pytest.raises(ValueError, match="unknown builder"):
        preset("TREE", "sift")
    levels = describe_levels([Level(BruteforceKNNParams(5), Select("flooding", 2, True)), Level(RNGGParams())])
    assert levels.startswith("level0=KNN(degree=5|batch_size=1000)|flooding=2|repeat|level1=RNGG(degree=30|")
