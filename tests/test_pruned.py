import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlode.operators import knn as blocks
from graphlode.operators import pruned
from graphlode.operators.knn import knn
from graphlode.sources.synthetic import vectors as generated


def plain(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.dist, 9)) for r in df.collect())


@pytest.mark.parametrize("skip_self", [False, True])
def test_clusters_are_passed_over(spark, monkeypatch, skip_self):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(20, 6)) * 50)[np.arange(600) % 20] + rng.normal(size=(600, 6))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 25)  # several blocks a cell
    found, pairs = pruned.knn_pruned(v, q, 7, skip_self)
    assert plain(found) == plain(knn(v, q, 7, skip_self))
    assert pairs < 600 * 150 / 2  # 24 pivots drawn among 20 clusters: some clusters have none of their own


def test_data_without_structure_and_equal_rows(spark):
    v = generated(spark, 200, 12, "normal")
    q = v.where("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    assert plain(pruned.knn_pruned(v, q, 5)[0]) == plain(knn(v, q, 5))
    same = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = same.withColumnRenamed("vec_id", "query_id")
    assert plain(pruned.knn_pruned(same, asked, 4)[0]) == plain(knn(same, asked, 4))
    assert plain(pruned.knn_pruned(same.limit(3), asked.limit(2), 9)[0]) == plain(knn(same.limit(3), asked.limit(2), 9))
    assert pruned.knn_pruned(same.limit(0), asked, 4)[0].count() == 0
    assert pruned.knn_pruned(same, asked.limit(0), 4)[0].count() == 0


def test_a_query_goes_to_a_group_of_cells_once(spark):
    """Without structure no cell is ruled out; a query's vector must not be sent to each of them."""
    v = generated(spark, 900, 12, "normal")
    rows, cells = pruned._dealt(v, 0, "pivots")
    bounded = v.select(F.col("vec_id").alias("query_id"), "embedding", F.lit(float("inf")).alias("kth"))
    for size, most in ((900, 1), (300, 6)):
        group = cells.groups(size)
        held = np.bincount(group, weights=cells.size)
        assert len(held) <= most
        assert held.sum() == 900 and held.max() <= max(size, cells.size.max())
        visits, counts = pruned._left(bounded, cells, group)
        assert visits.count() == 900 * len(held) and len(cells.size) == 30
        assert counts.agg(F.sum("n"), F.sum("pairs")).head() == (900 * len(held), 900 * 900)


def test_first_visits_begin_at_the_nearest_pivot():
    cells = pruned._Cells(np.array([[0.0], [10.0], [11.0]]), np.array([100.0, 1.0, 1.0]), np.array([50, 5, 5]))
    assert cells.first(cells.apart(np.array([[10.9]])), 6).tolist() == [[False, True, True]]


def test_known_bounds_change_no_row():
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(3000, 9)).astype(np.float32).astype(float), rng.permutation(3000)
    base, q = blocks.Base(ids, x), x[:200]
    plain_rows = blocks.block_top(ids[:200], q, base, 6, True)
    kth = plain_rows[2].reshape(200, 6)[:, -1]
    for most in (kth, kth * 3, np.where(np.arange(200) % 2, np.inf, kth)):
        assert all(np.array_equal(a, b) for a, b in zip(plain_rows, blocks.block_top(ids[:200], q, base, 6, True, most), strict=True))
