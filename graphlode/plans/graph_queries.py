"""Queries on edge tables: distances, joins, random graphs, pruning, selectors, hierarchy parts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distance import cos_at, squared_l2, thresholds
from ..model import BruteforceKNNParams, HierarchyParams, KeepEdges, RNGGParams
from ..operators import graphs, selectors, stats
from ..operators.hierarchy import level_plan
from ..operators.knn import gather, knn, knn_graph, with_distances
from ..operators.nndescent import pool_insert
from ..operators.pruned import knn_pruned
from ..operators.results import described
from ..operators.sharded import build_index, index_edges
from ..registry import query
from .tables import dist, exact_sql, knn_cte, near, random_cte, rounded, table, vectors

# ---- distances ----


@query("dst1_squared_l2", f"SELECT a.vec_id AS src, b.vec_id AS dst, round({dist('a.embedding', 'b.embedding')}, 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    v = vectors(spark, sf)
    a, b = v.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"))
    return rounded(a.join(b, F.col("dst") == F.col("src") + 1).select("src", "dst", squared_l2("x", "y").alias("dist")), "dist")


@query(
    "dst2_edge_angles",
    f"""WITH {knn_cte(4)} SELECT a.src, a.dst AS d1, b.dst AS d2, round((a.dist + b.dist - {dist('x.embedding', 'y.embedding')}) / 2 / nullif(sqrt(a.dist * b.dist), 0), 6) AS cos_angle
    FROM knn a JOIN knn b ON a.src = b.src AND a.slot < b.slot JOIN embeddings x ON x.vec_id = a.dst JOIN embeddings y ON y.vec_id = b.dst""",
)
def _(spark, sf):
    e, v = near(spark, sf, 4), vectors(spark, sf)
    a = e.select("src", F.col("dst").alias("d1"), F.col("dist").alias("p"), F.col("slot").alias("s1"))
    b = e.select("src", F.col("dst").alias("d2"), F.col("dist").alias("r"), F.col("slot").alias("s2"))
    pairs = with_distances(a.join(b, "src").where("s1 < s2"), v, "d1", "d2", "apart")
    return rounded(pairs.select("src", "d1", "d2", cos_at(F.col("p"), F.col("r"), F.col("apart")).alias("cos_angle")), "cos_angle")


@query(
    "dst3_angle_thresholds",
    "SELECT DISTINCT CAST(p_size AS DOUBLE) AS angle, round(cos(radians(p_size)), 9) AS threshold, round(degrees(acos(p_size / (2.0 * p_size + 2))), 9) AS dim_angle FROM part",
)
def _(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("angle")).distinct()
    threshold, dim_angle = thresholds(F.col("angle"), F.col("angle") + 2)
    return sizes.select("angle", F.round(threshold, 9).alias("threshold"), F.round(dim_angle, 9).alias("dim_angle"))


# ---- exact neighbours ----


@query("knn1_exact", exact_sql(10))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn(v, v.withColumnRenamed("vec_id", "query_id"), 10), "dist")


@query("knn1_grid", exact_sql(10))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn(v, v.withColumnRenamed("vec_id", "query_id"), 10, broadcast_mb=0, cell_rows=200), "dist")


@query("knn1_pruned", exact_sql(10))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn_pruned(v, v.withColumnRenamed("vec_id", "query_id"), 10)[0], "dist")


@query("knn2_graph", f"WITH {knn_cte(10)} SELECT src, dst, round(dist, 6) AS dist, slot FROM knn")
def _(spark, sf):
    return rounded(knn_graph(vectors(spark, sf), BruteforceKNNParams(10).degree), "dist")


# ---- joins ----

_TWO_HOP = """th AS MATERIALIZED (SELECT src, dst, CAST(rn - 1 AS INTEGER) AS slot FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY s1, s2) AS rn FROM (
    SELECT src, dst, s1, s2, row_number() OVER (PARTITION BY src, dst ORDER BY s1, s2) AS seen FROM (
      SELECT a.src, b.dst, a.slot AS s1, b.slot AS s2 FROM knn a JOIN knn b ON a.dst = b.src WHERE a.src <> b.dst)) WHERE seen = 1) WHERE rn <= 20)"""


@query("jn1_two_hop", f"WITH {knn_cte(6)}, {_TWO_HOP} SELECT * FROM th")
def _(spark, sf):
    return graphs.two_hop(near(spark, sf, 6), 20)


@query(
    "jn2_local_join",
    f"""WITH {knn_cte(6)}, n AS (SELECT src AS centre, dst AS id FROM knn WHERE slot < 3), o AS (SELECT src AS centre, dst AS id FROM knn WHERE slot >= 3)
    SELECT x.id AS a, y.id AS b FROM n x JOIN n y USING (centre) WHERE x.id < y.id
    UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM n x JOIN o y USING (centre) WHERE x.id <> y.id""",
)
def _(spark, sf):
    e = near(spark, sf, 6).select(F.col("src").alias("centre"), F.col("dst").alias("id"), "slot")
    return graphs.local_join(e.where("slot < 3"), e.where("slot >= 3"))


@query(
    "jn3_bounded_reach",
    f"""WITH RECURSIVE {knn_cte(5)}, f(start, node, h) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION SELECT f.start, knn.dst, h + 1 FROM f JOIN knn ON f.node = knn.src WHERE h < 2)
    SELECT DISTINCT start, node FROM f""",
)
def _(spark, sf):
    return graphs.reach(near(spark, sf, 5), vectors(spark, sf), 2)


_RANDOM_SUBSET = "sub AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY CASE WHEN vec_id = 0 THEN '' ELSE md5('subset:' || vec_id) END, vec_id) AS rn FROM embeddings) WHERE rn <= (SELECT count(*) // 2 FROM embeddings))"


@query(
    "jn4_local_ids",
    f"""WITH {_RANDOM_SUBSET}, l1 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS local_id, vec_id AS global_id FROM sub),
    s2 AS (SELECT global_id, row_number() OVER (ORDER BY CASE WHEN global_id = 0 THEN '' ELSE md5('second:' || global_id) END, global_id) AS rn FROM l1),
    l2 AS (SELECT row_number() OVER (ORDER BY global_id) - 1 AS local_id, global_id FROM s2 WHERE rn <= (SELECT count(*) // 2 FROM l1))
    SELECT l2.local_id, l1.local_id AS parent_local_id, l2.global_id FROM l2 JOIN l1 USING (global_id)""",
)
def _(spark, sf):
    first = selectors.random_subset(vectors(spark, sf))
    return graphs.local_ids(selectors.numbered(selectors.random_subset(first, seed="second")), selectors.numbered(first))


@query(
    "jn5_reachable",
    f"""WITH RECURSIVE {knn_cte(10)}, f(node, h) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT knn.dst, h + 1 FROM f JOIN knn ON f.node = knn.src WHERE h < 12) SELECT node, min(h) AS hops FROM f GROUP BY node""",
)
def _(spark, sf):
    return graphs.reachable(near(spark, sf, 10), 0)


@query("prj1_gather", f"WITH {_RANDOM_SUBSET} SELECT e.vec_id, round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings e JOIN sub USING (vec_id)")
def _(spark, sf):
    v = vectors(spark, sf)
    got = gather(v, selectors.random_subset(v))
    return rounded(got.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")), "total")


@query(
    "prj3_params",
    """SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS degree, CAST(l_quantity AS INTEGER) AS prune_extend_degree, lower(l_returnflag) AS prune,
      'degree=' || CAST(l_linenumber AS INTEGER) || '|prune_extend_degree=' || CAST(l_quantity AS INTEGER) || '|prune=' || CASE WHEN l_returnflag = 'A' THEN 'None' ELSE lower(l_returnflag) END AS params FROM lineitem WHERE l_returnflag <> 'A'
    UNION SELECT DISTINCT CAST(l_linenumber AS INTEGER), CAST(l_quantity AS INTEGER), NULL, 'degree=' || CAST(l_linenumber AS INTEGER) || '|prune_extend_degree=' || CAST(l_quantity AS INTEGER) || '|prune=None' FROM lineitem WHERE l_returnflag = 'A'""",
)
def _(spark, sf):
    prune = F.when(F.col("l_returnflag") != "A", F.lower("l_returnflag")).alias("prune")
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("degree"), F.col("l_quantity").cast("int").alias("prune_extend_degree"), prune).distinct()
    return described(rows, "degree", "prune_extend_degree", "prune")


# ---- random graphs and pruning ----


@query("gr1_random_graph", f"WITH {random_cte(10, 'graph')} SELECT * FROM rg")
def _(spark, sf):
    return graphs.random_graph(vectors(spark, sf), 10)


def _rngg(mode: KeepEdges, where: str, order: str):
    sql = f"""WITH {random_cte(20, 'rngg')}, d AS (
      SELECT rg.*, {dist('a.embedding', 'b.embedding')} AS dist FROM rg JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM d)
    SELECT src, dst, round(dist, 6) AS dist, CAST({order} AS INTEGER) AS slot FROM r WHERE {where}"""

    def run(spark, sf):
        params = RNGGParams(degree=9, prune_extend_degree=20, prune=mode)
        return rounded(graphs.rng_graph(vectors(spark, sf), params), "dist").select("src", "dst", "dist", "slot")

    def in_index(spark, sf):
        params = RNGGParams(degree=9, prune_extend_degree=20, prune=mode)
        return index_edges(build_index(vectors(spark, sf), params)).select("src", "dst", "slot")

    query(f"rngg2_{mode.value}", sql)(run)
    query(f"rngg1_index_{mode.value}", f"SELECT src, dst, slot FROM ({sql})")(in_index)


_again = "row_number() OVER (PARTITION BY src ORDER BY r) - 1"
_rngg(KeepEdges.SHORT, "r < 9", _again)
_rngg(KeepEdges.LONG, "r >= n - 9", _again)
_rngg(KeepEdges.MIDDLE, "r >= 6 AND r < 14", _again)
_rngg(KeepEdges.SPECIAL, "r < 4 OR (r >= 9 AND r < 13)", _again)
_rngg(KeepEdges.NONE, "slot < 9", "slot")


@query(
    "ef2_pool_insert",
    f"""WITH {knn_cte(8)}, {random_cte(8, 'graph')}, o AS (SELECT src, dst, {dist('a.embedding', 'b.embedding')} AS dist FROM rg JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst),
    u AS (SELECT src, dst, min(dist) AS dist, bool_and(fresh) AS fresh FROM (SELECT src, dst, dist, false AS fresh FROM knn UNION ALL SELECT src, dst, dist, true FROM o) GROUP BY src, dst)
    SELECT src, dst, round(dist, 6) AS dist, fresh FROM u QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 12""",
)
def _(spark, sf):
    v = vectors(spark, sf)
    offers = with_distances(graphs.random_graph(v, 8).select("src", "dst"), v).withColumn("fresh", F.lit(True))
    pool = near(spark, sf, 8).select("src", "dst", "dist").withColumn("fresh", F.lit(False))
    return rounded(pool_insert(pool, offers, 12), "dist")


@query("nssg2_nearest_first", f"WITH {knn_cte(8)} SELECT src, dst, slot, round(dist, 6) AS dist FROM knn WHERE slot < 5")
def _(spark, sf):
    return rounded(graphs.nearest_first(near(spark, sf, 8), vectors(spark, sf), 5), "dist")


@query(
    "nssg4_angle_prune",
    f"""WITH RECURSIVE {knn_cte(6)}, {_TWO_HOP}, c AS (SELECT src, dst FROM th UNION SELECT src, dst FROM knn),
    p AS MATERIALIZED (SELECT src, dst, dist, vec, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM (
      SELECT c.src, c.dst, b.embedding AS vec, {dist('a.embedding', 'b.embedding')} AS dist FROM c JOIN embeddings a ON a.vec_id = c.src JOIN embeddings b ON b.vec_id = c.dst)),
    f(src, i, kept) AS (
      SELECT src, 1, [{{'dst': dst, 'd': dist, 'vec': vec}}] FROM p WHERE rn = 1
      UNION ALL
      SELECT f.src, f.i + 1, CASE WHEN len(kept) >= 8 OR len(list_filter(kept, lambda r: (p.dist + r.d - {dist('p.vec', 'r.vec').replace('lambda p:', 'lambda z:').replace('p[1]', 'z[1]').replace('p[2]', 'z[2]')}) / 2 / sqrt(p.dist * r.d) > cos(radians(60)))) > 0
        THEN kept ELSE list_append(kept, {{'dst': p.dst, 'd': p.dist, 'vec': p.vec}}) END
      FROM f JOIN p ON p.src = f.src AND p.rn = f.i + 1),
    l AS (SELECT src, arg_max(kept, i) AS kept FROM f GROUP BY src)
    SELECT src, kept[j].dst AS dst, round(kept[j].d, 6) AS dist, CAST(j - 1 AS INTEGER) AS slot FROM (SELECT src, kept, unnest(range(1, len(kept) + 1)) AS j FROM l)""",
)
def _(spark, sf):
    v, e = vectors(spark, sf), near(spark, sf, 6)
    pool = graphs.two_hop(e, 20).select("src", "dst").unionByName(e.select("src", "dst")).distinct()
    return rounded(graphs.angle_prune(with_distances(pool, v), v, 60.0, 8), "dist")


@query(
    "deg1_first_edges",
    """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings)
    SELECT a.vec_id AS src, b.vec_id AS dst FROM r a JOIN r b ON a.rn <= 9 AND b.rn <= 9 AND a.vec_id <> b.vec_id UNION ALL SELECT vec_id, vec_id FROM r, range(0, 8) WHERE rn > 9""",
)
def _(spark, sf):
    return graphs.regular_start(vectors(spark, sf), 8)


@query(
    "deg3_rng_violations",
    f"WITH {knn_cte(10)} SELECT DISTINCT e.src, e.dst FROM knn e JOIN knn u ON u.src = e.src JOIN knn w ON w.src = u.dst AND w.dst = e.dst WHERE e.dist > greatest(u.dist, w.dist)",
)
def _(spark, sf):
    return graphs.rng_violations(near(spark, sf, 10))


# ---- selectors ----


@query("sel1_random", f"WITH {_RANDOM_SUBSET} SELECT vec_id FROM sub")
def _(spark, sf):
    return selectors.random_subset(vectors(spark, sf))


@query(
    "sel2_hubs",
    f"""WITH {knn_cte(6)}, i AS (SELECT dst AS src, src AS dst FROM knn), d AS (SELECT vec_id, (SELECT count(*) FROM i WHERE i.src = vec_id) AS n FROM embeddings)
    SELECT vec_id FROM d QUALIFY row_number() OVER (ORDER BY CASE WHEN vec_id = 0 THEN 0 ELSE 1 END, n DESC, vec_id) <= (SELECT count(*) // 2 FROM embeddings)""",
)
def _(spark, sf):
    back = near(spark, sf, 6).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return selectors.hub_nodes(vectors(spark, sf), back)


def _flood(r: int) -> str:
    return f"""WITH RECURSIVE {knn_cte(8)},
    h AS (SELECT src, dst FROM knn{" UNION SELECT a.src, b.dst FROM knn a JOIN knn b ON a.dst = b.src" if r == 2 else ""}),
    o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('flood:' || vec_id)) AS i FROM embeddings WHERE vec_id <> 0),
    n AS MATERIALIZED (SELECT o.i, o.vec_id, list(h.dst) AS ends FROM o JOIN h ON h.src = o.vec_id GROUP BY o.i, o.vec_id),
    s(i, flooded, chosen) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
      UNION ALL
      SELECT n.i, CASE WHEN list_contains(flooded, n.vec_id) THEN flooded ELSE list_concat(flooded, n.ends) END, CASE WHEN list_contains(flooded, n.vec_id) THEN chosen ELSE list_append(chosen, n.vec_id) END
      FROM s JOIN n ON n.i = s.i + 1)
    SELECT unnest(list_append(arg_max(chosen, i), CAST(0 AS BIGINT))) AS vec_id FROM s"""


@query("sel3_flooding", _flood(1))
def _(spark, sf):
    return selectors.flooding(vectors(spark, sf), near(spark, sf, 8), 1)


@query("sel5_flooding_two_hops", _flood(2))
def _(spark, sf):
    return selectors.flooding(vectors(spark, sf), near(spark, sf, 8), 2)


#: The scan goes round the nodes until enough are chosen; at each new round only the chosen ones are flooded.
_REPEAT = f"""WITH RECURSIVE {knn_cte(8)},
    o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('flood:' || vec_id)) AS i FROM embeddings WHERE vec_id <> 0),
    n AS MATERIALIZED (SELECT o.i, o.vec_id, list(knn.dst) AS ends FROM o JOIN knn ON knn.src = o.vec_id GROUP BY o.i, o.vec_id),
    c AS MATERIALIZED (SELECT count(*) AS most, (count(*) + 1) // 2 AS size FROM n),
    s(step, i, flooded, chosen) AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([0] AS BIGINT[]), CAST([0] AS BIGINT[])
      UNION ALL
      SELECT step + 1, n.i, CASE WHEN list_contains(f, n.vec_id) THEN f ELSE list_concat(f, list_append(n.ends, n.vec_id)) END, CASE WHEN list_contains(f, n.vec_id) THEN chosen ELSE list_append(chosen, n.vec_id) END
      FROM (SELECT step, s.i, chosen, CASE WHEN s.i = most THEN chosen ELSE flooded END AS f, most, size FROM s, c) s JOIN n ON n.i = s.i % most + 1 WHERE len(chosen) < size)
    SELECT unnest(arg_max(chosen, step)) AS vec_id FROM s"""


@query("sel4_flooding_repeat", _REPEAT)
def _(spark, sf):
    v = vectors(spark, sf)
    return selectors.flooding_repeat(v, near(spark, sf, 8), 1, v.count() // 2)


# ---- hierarchy parts ----


@query(
    "hier1_level_plan",
    """WITH n AS (SELECT count(*) AS n FROM lineitem UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM embeddings),
    l AS (SELECT n, greatest(least(CAST(floor(ln(n) / ln(40) + 1e-6) AS INT) + 1, 6), 1) AS layers FROM n),
    s AS (SELECT n, unnest(range(1, layers)) AS level FROM l), z AS (SELECT n, level, greatest(CAST(floor(1.2 * n / pow(40, level) + 1e-6) AS BIGINT), 50) AS size FROM s)
    SELECT DISTINCT n, CAST(level AS INTEGER) AS level, size FROM z WHERE level <= coalesce((SELECT min(y.level) FROM z y WHERE y.n = z.n AND y.size = 50), level)""",
)
def _(spark, sf):
    sizes = [table(spark, sf, t).count() for t in ("lineitem", "orders", "embeddings")]
    return spark.createDataFrame([(n, i + 1, s) for n in dict.fromkeys(sizes) for i, s in enumerate(level_plan(n, HierarchyParams()))], "n long, level int, size long")


@query("hier4_small_complete", "SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst, CAST(row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) - 1 AS INTEGER) AS slot FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey")
def _(spark, sf):
    return graphs.complete_graph(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("vec_id")))


@query(
    "hier5_artificial_hubs",
    f"""WITH {knn_cte(5)}, {_RANDOM_SUBSET}, {random_cte(4, 'hubs')}
    SELECT src, dst, slot FROM knn UNION ALL SELECT rg.src, rg.dst, CAST(5 + rg.slot AS INTEGER) FROM rg JOIN sub ON sub.vec_id = rg.src WHERE NOT EXISTS (SELECT 1 FROM knn WHERE knn.src = rg.src AND knn.dst = rg.dst)""",
)
def _(spark, sf):
    v = vectors(spark, sf)
    return graphs.add_hubs(near(spark, sf, 5), selectors.random_subset(v), selectors.numbered(v), 4)


@query(
    "hier5_upper_level",
    f"""WITH {_RANDOM_SUBSET}, l1 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS local_id, vec_id AS global_id, embedding FROM embeddings JOIN sub USING (vec_id)),
    s2 AS (SELECT global_id, row_number() OVER (ORDER BY CASE WHEN global_id = 0 THEN '' ELSE md5('second:' || global_id) END, global_id) AS rn FROM l1),
    h AS (SELECT l1.* FROM s2 JOIN l1 USING (global_id) WHERE rn <= (SELECT count(*) // 2 FROM l1)),
    k AS MATERIALIZED (SELECT src, dst, CAST(rn - 1 AS INTEGER) AS slot FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rn FROM (
      SELECT a.global_id AS src, b.global_id AS dst, {dist("a.embedding", "b.embedding")} AS d FROM l1 a JOIN l1 b ON a.global_id <> b.global_id)) WHERE rn <= 5),
    t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY min(t)) - 1 AS slot FROM (
      SELECT local_id AS a, t, CAST('0x' || substr(md5('hubs:' || local_id || ':' || t), 1, 12) AS BIGINT) % (SELECT count(*) FROM l1) AS b FROM h, range(0, 28) r(t)) WHERE a <> b GROUP BY a, b)
    SELECT src, dst, slot FROM k UNION ALL
    SELECT x.global_id, y.global_id, CAST(5 + slot AS INTEGER) FROM t JOIN l1 x ON x.local_id = a JOIN l1 y ON y.local_id = b WHERE slot < 4 AND NOT EXISTS (SELECT 1 FROM k WHERE k.src = x.global_id AND k.dst = y.global_id)""",
)
def _(spark, sf):
    v = vectors(spark, sf)
    sub = selectors.random_subset(v)
    at = gather(v, sub)
    return graphs.add_hubs(knn_graph(at, 5), selectors.random_subset(sub, seed="second"), selectors.numbered(sub), 4)


# ---- statistics ----

#: A graph with faults: k-NN edges, a loop and a repeated edge at node 1, an edge out of the table, no edges at node 0.
_FAULTY = f"""WITH {knn_cte(7)}, e AS (SELECT src, dst, dist FROM knn WHERE src <> 0 UNION ALL SELECT 1, 1, 0.0 UNION ALL SELECT src, dst, dist FROM knn WHERE src = 1 AND slot = 0 UNION ALL SELECT 2, (SELECT count(*) FROM embeddings), 1.0)"""


def _faulty(spark, sf):
    e = near(spark, sf, 7)
    n = vectors(spark, sf).count()
    extra = spark.createDataFrame([(1, 1, 0.0), (2, n, 1.0)], "src long, dst long, dist double")
    return e.where("src != 0").select("src", "dst", "dist").unionByName(extra).unionByName(e.where("src = 1 and slot = 0").select("src", "dst", "dist")), n


@query(
    "agg1_graph_stats",
    f"""{_FAULTY}, d AS (SELECT vec_id, (SELECT count(*) FROM e WHERE e.src = vec_id) AS degree FROM embeddings)
    SELECT count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS n_edges, max(degree) AS max_degree, min(degree) AS min_degree, round(avg(degree), 6) AS avg_degree, round(stddev_pop(degree), 6) AS std_degree FROM d""",
)
def _(spark, sf):
    e, _n = _faulty(spark, sf)
    return rounded(stats.graph_stats(vectors(spark, sf), e), "avg_degree", "std_degree")


@query("agg2_edge_counts", f"{_FAULTY} SELECT count(*) AS n_edges, count(*) - count(DISTINCT (src, dst)) AS n_duplicates FROM e")
def _(spark, sf):
    return stats.edge_counts(_faulty(spark, sf)[0])


_LEVELS = f"""WITH {knn_cte(7)}, {_RANDOM_SUBSET}, nodes AS (SELECT 0 AS level, vec_id FROM embeddings UNION ALL SELECT 1, vec_id FROM sub),
e AS (SELECT 0 AS level, src, dst, dist FROM knn UNION ALL SELECT 1, src, dst, dist FROM knn JOIN sub a ON a.vec_id = src JOIN sub b ON b.vec_id = dst),
d AS (SELECT level, vec_id, (SELECT count(*) FROM e WHERE e.level = nodes.level AND e.src = nodes.vec_id) AS degree FROM nodes)"""


def _levels(spark, sf):
    v, e = vectors(spark, sf), near(spark, sf, 7)
    sub = selectors.random_subset(v)
    upper = e.join(sub.withColumnRenamed("vec_id", "src"), "src", "left_semi").join(sub.withColumnRenamed("vec_id", "dst"), "dst", "left_semi")
    nodes = v.select(F.lit(0).alias("level"), "vec_id").unionByName(sub.select(F.lit(1).alias("level"), "vec_id"))
    cols = ("src", "dst", "dist")
    return nodes, e.select(F.lit(0).alias("level"), *cols).unionByName(upper.select(F.lit(1).alias("level"), *cols))


@query(
    "agg3_level_degrees",
    f"{_LEVELS} SELECT level, count(*) AS n_vertices, CAST(sum(degree) AS BIGINT) AS n_edges, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree FROM d GROUP BY level",
)
def _(spark, sf):
    return rounded(stats.level_degrees(*_levels(spark, sf)), "avg_degree")


@query("agg3_total_degree", f"{_LEVELS} SELECT round(avg(a), 6) AS total_avg_out_degree FROM (SELECT avg(degree) AS a FROM d GROUP BY level)")
def _(spark, sf):
    return rounded(stats.total_degree(stats.level_degrees(*_levels(spark, sf))), "total_avg_out_degree")


@query("agg4_edge_lengths", f"{_LEVELS} SELECT level, round(avg(dist), 6) AS avg_edge_dist, round(min(dist), 6) AS min_edge_dist, round(max(dist), 6) AS max_edge_dist FROM e GROUP BY level")
def _(spark, sf):
    return rounded(stats.edge_lengths(_levels(spark, sf)[1], ("level",)), "avg_edge_dist", "min_edge_dist", "max_edge_dist")


@query("agg5_min_max_lengths", f"{_FAULTY} SELECT round(avg(dist), 6) AS avg_edge_dist, round(min(dist), 6) AS min_edge_dist, round(max(dist), 6) AS max_edge_dist FROM e")
def _(spark, sf):
    return rounded(stats.edge_lengths(_faulty(spark, sf)[0]), "avg_edge_dist", "min_edge_dist", "max_edge_dist")


@query("agg6_duplicates", f"{_LEVELS} SELECT level, count(*) - count(DISTINCT (src, dst)) AS n_duplicates FROM e GROUP BY level")
def _(spark, sf):
    e = _levels(spark, sf)[1]
    per = e.groupBy("level", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("level").agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


@query("agg7_edge_faults", f"{_FAULTY} SELECT bool_or(src = dst) AS has_loops, bool_or(dst >= (SELECT count(*) FROM embeddings)) AS has_escaping_edges FROM e")
def _(spark, sf):
    return stats.edge_faults(*_faulty(spark, sf))


@query(
    "agg8_recall",
    f"""WITH {knn_cte(10)}, {random_cte(30, 'graph')}, hits AS (SELECT count(*) AS h FROM knn JOIN rg ON knn.src = rg.src AND knn.dst = rg.dst)
    SELECT round(h / ((SELECT count(*) FROM embeddings) * 10.0) * 100, 6) AS recall FROM hits""",
)
def _(spark, sf):
    truth = near(spark, sf, 10).select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"))
    found = graphs.random_graph(vectors(spark, sf), 30).select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"))
    return rounded(stats.recall(truth, found, 10), "recall")
