import numpy as np
import pytest

from graphlode.functions.distance import cos_threshold
from graphlode.model import BruteforceKNNParams, NSSGParams
from graphlode.operators import kernels, nssg
from graphlode.operators.graphs import reachable
from graphlode.operators.knn import knn_graph
from graphlode.sources.synthetic import vectors as generated


def test_reverse_edges_equal_the_fold_in_memory(spark):
    """Everybody points to node 0 as well, which takes its offers in several turns."""
    v = generated(spark, 120, 5, "normal").cache()
    x = np.array([r.embedding for r in sorted(v.collect())], np.float64)
    lists = [sorted({int(j) for j in np.argsort(kernels.distances(x, np.arange(120), x[i]))[1:5]} | ({0} - {i})) for i in range(120)]
    rows = [(i, j, float(((x[i] - x[j]) ** 2).sum()), 0) for i, a in enumerate(lists) for j in a]
    got = {}
    edges = nssg.reverse_insert(spark.createDataFrame(rows, "src long, dst long, dist double, slot int"), v, 60.0, 6, chunk=20)
    for r in edges.orderBy("src", "slot").collect():
        got.setdefault(r.src, []).append(r.dst)
    t, kept = cos_threshold(60.0), [sorted((d, j) for i, j, d, _ in rows if i == u) for u in range(120)]
    for u in range(120):
        for d, w in sorted((d, i) for i, j, d, _ in rows if j == u):
            if all(w != z for _, z in kept[u]):
                kept[u] = [*kept[u], (d, w)] if len(kept[u]) < 6 else kernels.angle_keep(x, u, sorted([*kept[u], (d, w)]), t, 6)
    assert got == {u: [w for _, w in sorted(kept[u])] for u in range(120)}


@pytest.mark.parametrize(
    "edges,n,most,added,beyond",
    [
        ([(i + 1, i) for i in range(5)], 6, 3, 1, 0),  # a chain towards the root: one edge to its far end
        ([], 6, 2, 5, 0),  # nodes alone
        ([(0, 1), (1, 0), (2, 3), (3, 2)], 4, 1, 1, 1),  # nobody reached has room
        ([(0, 1), (2, 3), (3, 2), (2, 4), (5, 4)], 6, 2, 2, 0),
    ],
)
def test_connect(spark, edges, n, most, added, beyond):
    e = spark.createDataFrame([(a, b, [x for x in edges if x[0] == a].index((a, b))) for a, b in edges], "src long, dst long, slot int")
    got = nssg.connect(e, spark.range(n).withColumnRenamed("id", "vec_id"), 0, most)
    assert (got.added, got.beyond) == (added, beyond)
    assert reachable(got.edges, 0).count() == n
    degrees = {r.src: r["count"] for r in got.edges.groupBy("src").count().collect()}
    assert sum(max(d - most, 0) for d in degrees.values()) <= beyond
    assert got.edges.groupBy("src", "slot").count().where("count > 1").isEmpty()


def test_every_root_leads_to_all(spark):
    v = generated(spark, 90, 4, "normal").cache()
    g, roots = nssg.nssg_graph(v, NSSGParams(range=4, l=20, n_try=3), knn_graph(v, 3))
    assert len(roots) == 3 and all(reachable(g.edges, r).count() == 90 for r in roots)
    with pytest.raises(ValueError, match="other rows"):
        nssg.nssg_graph(v, NSSGParams(range=4), knn_graph(v, 3).where("src < 50"))
    small, _ = nssg.nssg_graph(v.where("vec_id < 5"), NSSGParams(), BruteforceKNNParams(3))
    assert small.edges.count() == 20
