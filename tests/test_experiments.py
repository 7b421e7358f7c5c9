import pytest
from pyspark.sql import functions as F

from graphlode.model import BruteforceKNNParams, HierarchyParams, NSSGParams, RNGGParams, RNNParams
from graphlode.operators.experiments import Experiment, Level, Select, run_experiments
from graphlode.operators.knn import knn
from graphlode.plans import search_queries
from graphlode.sources.datasets import Dataset
from graphlode.sources.synthetic import vectors as generated


@pytest.fixture(scope="module")
def data(spark):
    v = generated(spark, 90, 5).cache()
    asked = v.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    return Dataset(v, asked, knn(v, asked, 10).select("query_id", "rank", "vec_id").cache())


def test_a_failure_is_no_result_where_all_rows_are_asked_for(spark, data):
    made = [Experiment("broken", [Level(NSSGParams(), Select("nothing"))]), Experiment("KNN", [Level(BruteforceKNNParams(30))], flat=True, heap_sizes=[90])]
    with pytest.raises(ExceptionGroup, match="without rows") as told:
        run_experiments(spark, data, "3M", made, strict=True)
    assert len(told.value.exceptions) == 1 and "unknown selector" in str(told.value.exceptions[0])


def test_the_queries_ask_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr("graphlode.operators.experiments.run_one", lambda *_: 1 / 0)
    with pytest.raises(ExceptionGroup):
        search_queries._experiments(spark, "/root/testdata/sf0.001")


def test_levels_are_built_one_way_at_any_size(spark, monkeypatch):
    """No size sends a level to one task, or to another builder; ids need not be dense."""
    monkeypatch.setattr("graphlode.operators.sharded.local_builder", lambda *_: pytest.fail("a level in one task"))
    monkeypatch.setattr("graphlode.operators.cells.cell_graph", lambda *_: pytest.fail("cells"))
    v = generated(spark, 60, 4).withColumn("vec_id", F.col("vec_id") * 5 + 2).cache()
    for params in (RNNParams(6, 4, 1, 2), RNGGParams(4, prune_extend_degree=6)):
        ends = {i for e in Level(params).builder()(v).select("src", "dst").collect() for i in e}
        assert ends <= set(range(2, 302, 5)) and len(ends) == 60


def test_a_graph_of_copies_is_searched_whole(spark):
    v = generated(spark, 12, 5).crossJoin(spark.range(5)).select((F.col("vec_id") + 12 * F.col("id")).alias("vec_id"), "embedding").cache()
    asked = v.withColumnRenamed("vec_id", "query_id")
    data = Dataset(v, asked, knn(v, asked, 3).select("query_id", "rank", "vec_id").cache())
    made = [Experiment("KNN", [Level(BruteforceKNNParams(3))], flat=True, ks=(3,), heap_sizes=[60]), Experiment("Levels", [Level(BruteforceKNNParams(3))], HierarchyParams(higher_max_degree=4, min_n_vertices_layer=10), ks=(3,), heap_sizes=[60])]
    rows = run_experiments(spark, data, "3M", made, strict=True).collect()
    assert len(rows) > 2 and {r.recall for r in rows} == {100.0}
