"""Edge-table operators: random graphs, pruning modes, expansions, occlusion, joins by id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import cos_threshold, occludes, squared_l2
from ..functions.seeded import shuffled
from ..model import KeepEdges, RNGGParams
from ..storage import staged
from .knn import with_distances


#: The most edges, and rows, of which the ends alone are held in one place: 32 MB of each.
HELD = 1 << 21


def held(edges: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, ...] | None:
    """The columns of edges (src, dst, ...) and the ids of nodes (vec_id) as arrays, if there are at most HELD of either: counted first. For what takes a join a hop over tables, with the same result."""
    if edges.count() > HELD or nodes.count() > HELD:
        return None
    columns, ids = edges.toArrow(), nodes.select("vec_id").toArrow()
    return *(c.to_numpy().astype(np.int64) for c in columns.columns), ids["vec_id"].to_numpy()


def _ranked(df: DataFrame, by, *order) -> DataFrame:
    return df.withColumn("slot", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def random_graph(vectors: DataFrame, out_degree: int, seed: str = "graph", n: int | None = None) -> DataFrame:
    """Each row gets `out_degree` distinct others, drawn by hash: about twice as many draws as needed, repeats dropped.

    Ends are ids below n, by default the number of rows; rows must have dense ids from 0. Draw t of row i is a number from md5(seed:i:t); nothing is joined all against all. Where over half
    of all rows are asked for, each row's others are ranked by md5(seed:i:j) instead.
    """
    n = vectors.count() if n is None else n
    degree = min(out_degree, max(n - 1, 0))
    if not degree:
        return vectors.sparkSession.createDataFrame([], "src long, dst long, slot int")
    most = degree * 2 > n
    draws = vectors.select(F.col("vec_id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1 if most else degree * 2 + 19))).alias("t"))
    if most:
        ranked = draws.select("src", F.col("t").cast("long").alias("dst"), shuffled(seed, "src", "t").alias("k")).where("src != dst")
        return _ranked(ranked, ["src"], "k", "dst").where(F.col("slot") < degree).select("src", "dst", "slot")
    draws = draws.withColumn("dst", (F.conv(F.substring(shuffled(seed, "src", "t"), 1, 12), 16, 10).cast("long") % F.lit(n))).where("src != dst")
    first = draws.groupBy("src", "dst").agg(F.min("t").alias("t"))
    return _ranked(first, ["src"], "t").where(F.col("slot") < degree).select("src", "dst", "slot")


def rng_graph(vectors: DataFrame, params: RNGGParams, seed: str = "rngg") -> DataFrame:
    """A random graph of prune_extend_degree edges, pruned to `degree` by the given mode."""
    if params.prune_extend_degree < params.degree:
        raise ValueError("prune_extend_degree must not be below degree")
    wide = with_distances(random_graph(vectors, params.prune_extend_degree, seed), vectors)
    return prune(wide, params)


def prune(edges: DataFrame, params: RNGGParams) -> DataFrame:
    """edges (src, dst, dist, slot) cut to `degree` for each src: nearest, middle, farthest, two bands, or first slots."""
    degree, extend = params.degree, params.prune_extend_degree
    m = min(degree, extend)
    by_dist = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy("src"))
    ranked = edges.withColumn("by_dist", by_dist).withColumn("total", total)
    r = F.col("by_dist")
    wanted = {
        KeepEdges.SHORT: r < m,
        KeepEdges.LONG: r >= F.col("total") - m,
        KeepEdges.MIDDLE: (r >= extend // 2 - m // 2) & (r < extend // 2 + m // 2),
        KeepEdges.SPECIAL: (r < degree // 2) | ((r >= degree) & (r < degree + degree // 2)),
        KeepEdges.NONE: F.col("slot") < m,
    }[params.prune]
    order = ["slot"] if params.prune is KeepEdges.NONE else ["by_dist"]
    return _ranked(ranked.where(wanted).drop("slot"), ["src"], *order) if order != ["slot"] else ranked.where(wanted).select("src", "dst", "dist", "slot")


def complete_graph(vectors: DataFrame, limit: int = 64) -> DataFrame:
    """All ordered pairs of a table of at most `limit` rows (the small-data fallback): both directions."""
    if vectors.limit(limit + 1).count() > limit:
        raise ValueError(f"a complete graph is for at most {limit} rows")
    ids = vectors.select("vec_id")
    pairs = ids.withColumnRenamed("vec_id", "src").join(ids.withColumnRenamed("vec_id", "dst"), F.col("src") != F.col("dst"))
    return _ranked(pairs, ["src"], "dst").select("src", "dst", "slot")


def two_hop(edges: DataFrame, most: int) -> DataFrame:
    """For each src the first `most` ends of two-edge paths, in order of both slots, without src and repeats."""
    a = edges.select("src", F.col("dst").alias("via"), F.col("slot").alias("s1"))
    b = edges.select(F.col("src").alias("via"), "dst", F.col("slot").alias("s2"))
    ends = a.join(b, "via").where("src != dst").groupBy("src", "dst").agg(F.min(F.struct("s1", "s2")).alias("seen"))
    return _ranked(ends, ["src"], "seen").where(F.col("slot") < most).select("src", "dst", "slot")


def local_join(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a centre: new with new (a < b), and new with old. Both tables: centre, id."""
    x = new.select("centre", F.col("id").alias("a"))
    nn = x.join(new.select("centre", F.col("id").alias("b")), "centre").where("a < b").select("a", "b")
    no = x.join(old.select("centre", F.col("id").alias("b")), "centre").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return nn.unionByName(no).distinct()


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node): what each start (vec_id) reaches in at most `hops` edges, itself included."""
    found = starts.select(F.col("vec_id").alias("start"), F.col("vec_id").alias("node"))
    steps = edges.select(F.col("src").alias("node"), "dst")
    for _ in range(hops):
        found = found.unionByName(found.join(steps, "node").select("start", F.col("dst").alias("node"))).distinct()
    return found


def reachable(edges: DataFrame, root: int) -> DataFrame:
    """(node, hops) for every node that paths from root lead to; a frontier join for each hop."""
    spark = edges.sparkSession
    steps = edges.select("src", "dst").distinct()
    seen = staged(spark.createDataFrame([(root, 0)], "node long, hops int"), "reached")
    frontier, hop = seen, 0
    while True:
        hop += 1
        ends = frontier.join(steps, frontier.node == steps.src).select(F.col("dst").alias("node")).distinct()
        frontier = staged(ends.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = staged(seen.unionByName(frontier), "reached")


def local_ids(subset: DataFrame, previous: DataFrame) -> DataFrame:
    """Places in the level below: subset (local_id, global_id) joined by global id with previous (local_id, global_id)."""
    below = previous.select("global_id", F.col("local_id").alias("parent_local_id"))
    return subset.join(below, "global_id").select("local_id", "parent_local_id", "global_id")


def nearest_first(edges: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """The first `most` slots of each node with distances computed anew."""
    return with_distances(edges.where(F.col("slot") < most).select("src", "dst", "slot"), vectors)


def angle_prune(candidates: DataFrame, vectors: DataFrame, angle: float, most: int) -> DataFrame:
    """Keeps candidates (src, dst, dist) nearest first unless one kept before is seen under less than `angle` degrees.

    An ordered fold over each node's candidates, in SQL functions: the array of kept ones is the state.
    """
    t = cos_threshold(angle)
    with_vec = candidates.where("src != dst").dropDuplicates(["src", "dst"]).join(vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("vec")), "dst")
    pools = with_vec.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "vec"))).alias("pool"))
    empty = F.slice("pool", 1, 0)

    def step(kept, p):
        hidden = F.exists(kept, lambda r: occludes(p["dist"], r["dist"], squared_l2(p["vec"], r["vec"]), t))
        return F.when((F.size(kept) >= most) | hidden, kept).otherwise(F.concat(kept, F.array(p)))

    kept = pools.select("src", F.posexplode(F.aggregate("pool", empty, step)).alias("slot", "e"))
    return kept.select("src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"), F.col("slot").cast("int").alias("slot"))


def rng_violations(edges: DataFrame) -> DataFrame:
    """Edges v-t for which a neighbour u of v has an edge to t and both are shorter: src, dst."""
    e = edges.select("src", "dst", "dist")
    u = edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), F.col("dist").alias("d_vu"))
    w = edges.select(F.col("src").alias("u2"), F.col("dst").alias("t"), F.col("dist").alias("d_ut"))
    tri = e.join(u, F.col("src") == F.col("v")).join(w, (F.col("u") == F.col("u2")) & (F.col("dst") == F.col("t")))
    return tri.where("dist > greatest(d_vu, d_ut)").select("src", "dst").distinct()


def add_hubs(edges: DataFrame, hubs: DataFrame, numbers: DataFrame, most: int, seed: str = "hubs") -> DataFrame:
    """Gives each hub (vec_id) up to `most` random new ends that it has no edge to; new slots follow the old ones.

    numbers: local_id, global_id of all rows of the level, local ids dense from 0. Ends are drawn among these, for hubs alone.
    """
    numbers = staged(numbers, "level-numbers")
    ids = lambda a, b: numbers.select(F.col("local_id").alias(a), F.col("global_id").alias(b))
    own = hubs.join(ids("local", "vec_id"), "vec_id").select(F.col("local").alias("vec_id"))
    drawn = random_graph(own, most, seed, numbers.count()).withColumnsRenamed({"src": "a", "dst": "b"})
    extra = drawn.join(ids("a", "src"), "a").join(ids("b", "dst"), "b").select("src", "dst", "slot")
    extra = extra.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    offset = edges.groupBy("src").agg((F.max("slot") + 1).alias("base"))
    extra = extra.join(offset, "src", "left").select("src", "dst", (F.coalesce("base", F.lit(0)) + F.col("slot")).cast("int").alias("slot"))
    return edges.select("src", "dst", "slot").unionByName(extra)


def regular_start(vectors: DataFrame, degree: int) -> DataFrame:
    """What an even-regular graph starts from: the first degree + 1 rows (by id) all linked, `degree` loops at every other."""
    first = vectors.select("vec_id").orderBy("vec_id").limit(degree + 1)
    linked = first.withColumnRenamed("vec_id", "src").join(F.broadcast(first.withColumnRenamed("vec_id", "dst")), F.col("src") != F.col("dst"))  # degree + 1 rows
    others = vectors.select("vec_id").join(F.broadcast(first), "vec_id", "left_anti")
    loops = others.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst"), F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("i")).drop("i")
    return linked.select("src", "dst").unionByName(loops)
