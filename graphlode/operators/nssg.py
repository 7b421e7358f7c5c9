"""Navigating graphs with angles kept wide (NSSG), on tables: two-hop pools, angle pruning, reverse edges, repairs. No task holds a graph.

* `reverse_insert`: every kept edge u -> v offers u to v. v takes offers in order of distance: it appends while there is room, and beyond that prunes its list anew. The
  fold runs over bucketed nodes; a node takes at most CHUNK offers a round, so one that a third of all rows point to takes several rounds and no more memory.
* `connect`: nodes that a root does not reach get the smallest id that reaches them as their label, all at once. Edges to all nodes that are their own label
  would be enough; those that a node of larger label leads to are left out, as they have others upstream. Hosts are reached nodes with room, one new edge each; without any room they take one beyond the limit, which is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import angle_from_dim, cos_threshold
from ..functions.seeded import shuffled
from ..model import BruteforceKNNParams, EfannaParams, NSSGParams, RNGGParams
from ..storage import staged
from . import kernels
from .graphs import angle_prune, complete_graph, held, nearest_first, random_graph, reachable, rng_graph, two_hop
from .knn import knn_graph, matrix, with_distances
from .nndescent import SMALL, nn_descent
from .selectors import numbered

#: Offers that a node takes in a round, and nodes that share a task's group.
CHUNK, BUCKET = 1024, 128
_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())])


def _fold(u: int, kept: list[tuple[float, int]], offers: list[tuple[float, int]], vectors: dict[int, np.ndarray], t: float, most: int) -> list[tuple[float, int]]:
    """kept after the offers, in order of their distance; an id that is in the list already changes nothing."""
    ids = sorted(vectors)
    place, x = {v: i for i, v in enumerate(ids)}, np.stack([vectors[v] for v in ids])
    own = [(d, place[v]) for d, v in kept]
    for d, v in sorted((d, place[v]) for d, v in offers):
        if any(w == v for _, w in own):
            continue
        own = [*own, (d, v)] if len(own) < most else kernels.angle_keep(x, -1, sorted([*own, (d, v)]), t, most)
    return [(d, ids[v]) for d, v in own]


def reverse_insert(edges: DataFrame, vectors: DataFrame, angle: float, most: int, chunk: int = CHUNK) -> DataFrame:
    """src, dst, dist, slot (by distance): edges with what their reverses add, at most `most` a node."""
    t = cos_threshold(angle)
    vec = vectors.select(F.col("vec_id").alias("v"), "embedding")
    buckets = max(1, -(-vectors.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket")
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("dist", "src"))
    offers = edges.select("src", "dst", "dist", F.floor((rank - 1) / F.lit(chunk)).alias("turn"))
    offers = staged(offers.select(F.col("dst").alias("node"), F.col("src").alias("v"), F.col("dist").alias("d"), "turn"), "offers")
    lists = edges.select(F.col("src").alias("node"), F.col("dst").alias("v"), F.col("dist").alias("d"))
    turns = offers.agg(F.max("turn")).head()[0]

    def run(rows: pa.Table) -> pa.Table:
        out = []
        rows = rows.sort_by([("node", "ascending"), ("offer", "ascending"), ("d", "ascending"), ("v", "ascending")])
        x, nodes = matrix(rows["embedding"]), rows["node"].to_numpy()
        vs, ds, is_offer = rows["v"].to_pylist(), rows["d"].to_pylist(), rows["offer"].to_pylist()
        cuts = np.flatnonzero(np.diff(nodes, prepend=nodes[0] - 1)).tolist() + [len(nodes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = [(ds[i], vs[i]) for i in range(a, b) if not is_offer[i]]
            new = [(ds[i], vs[i]) for i in range(a, b) if is_offer[i]]
            out += [(int(nodes[a]), v, d) for d, v in _fold(int(nodes[a]), mine, new, dict(zip(vs[a:b], x[a:b], strict=True)), t, most)]
        return pa.table([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), _EDGES.types, strict=True)], schema=_EDGES) if out else _EDGES.empty_table()

    for turn in range(0 if turns is None else turns + 1):
        now = offers.where(F.col("turn") == turn).drop("turn")
        touched = now.select("node").distinct()
        both = lists.join(touched, "node", "left_semi").withColumn("offer", F.lit(False)).unionByName(now.withColumn("offer", F.lit(True)))
        folded = both.join(vec, "v").select(bucket, "node", "v", "d", "offer", "embedding").groupBy("bucket").applyInArrow(run, "src long, dst long, dist double")
        lists = staged(lists.join(touched, "node", "left_anti").unionByName(folded.selectExpr("src as node", "dst as v", "dist as d")), "reverse-lists")
    slot = F.row_number().over(Window.partitionBy("node").orderBy("d", "v")) - 1
    return lists.select(F.col("node").alias("src"), F.col("v").alias("dst"), F.col("d").alias("dist"), slot.cast("int").alias("slot"))


def reach_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the smallest of the nodes (vec_id) that lead to a node by edges between them, itself included."""
    own = nodes.select(F.col("vec_id").alias("node"))
    inner = edges.select("src", "dst").distinct().join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    inner = staged(inner, "inner-edges")
    labels = staged(own.withColumn("label", F.col("node")), "labels")
    moved = labels
    while True:
        offers = moved.join(inner, moved.node == inner.src).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        moved = staged(offers.join(labels, "node").where("offer < label").select("node", F.col("offer").alias("label")), "moved-labels")
        if moved.isEmpty():
            return labels
        labels = staged(labels.join(moved.withColumnRenamed("label", "less"), "node", "left").select("node", F.coalesce("less", "label").alias("label")), "labels")


def _flooded(edges: DataFrame, seen: DataFrame, frontier: DataFrame) -> DataFrame:
    """seen (node) and all that the frontier leads to."""
    steps = edges.select("src", "dst")
    while True:
        ends = frontier.join(steps, frontier.node == steps.src).select(F.col("dst").alias("node")).distinct()
        frontier = staged(ends.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = staged(seen.unionByName(frontier), "reached")


@dataclass(frozen=True)
class Connected:
    edges: DataFrame  # src, dst, slot
    added: int
    beyond: int  # of the added, those above the degree limit


def _links(src: np.ndarray, dst: np.ndarray, slot: np.ndarray, nodes: np.ndarray, root: int, most: int) -> tuple[pa.Table, int, int]:
    """What connect adds (src, dst, slot), how many and how many of them beyond most, found on arrays."""
    ids = np.unique(np.concatenate([src, dst, nodes, [root]]))
    a, b, wanted, seen = np.searchsorted(ids, src), np.searchsorted(ids, dst), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    wanted[np.searchsorted(ids, nodes)] = True
    degree, following = np.bincount(a, minlength=len(ids)), np.zeros(len(ids), np.int64)
    np.maximum.at(following, a, slot + 1)
    fresh, parts, added, beyond = np.searchsorted(ids, [root]), [], 0, 0
    while True:
        steps = kernels.Steps(a, b, len(ids))
        steps.flood(seen, fresh)
        left = np.flatnonzero(wanted & ~seen)
        if not len(left):
            made = [np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*parts, strict=True) if parts else ((), (), ()))]
            return pa.table(dict(zip(("src", "dst", "slot"), made, strict=True))), added, beyond
        label, feeder = steps.least(left), np.full(len(ids), -1, np.int64)
        np.maximum.at(feeder, b, label[a])
        heads = left[(label[left] == left) & (feeder[left] <= left)]
        hosts = np.flatnonzero(seen)
        free = hosts[degree[hosts] < most]
        n = min(len(heads), len(free) or len(hosts))
        at, fresh = (free if len(free) else hosts)[:n], heads[:n]
        parts.append((ids[at], ids[fresh], following[at]))
        added, beyond = added + n, beyond + (0 if len(free) else n)
        degree[at] += 1
        following[at] += 1
        a, b = np.concatenate([a, at]), np.concatenate([b, fresh])


def connect(edges: DataFrame, nodes: DataFrame, root: int, most: int) -> Connected:
    """Adds edges until root leads to all nodes (vec_id). A host keeps within `most` edges while any reached node has room.

    The ends of graphs of up to HELD edges are held while it is found out what is to be added; larger ones take joins. The edges are the same.
    """
    spark = edges.sparkSession
    edges = staged(edges.select("src", "dst", "slot"), "graph")
    if root is not None and (arrays := held(edges, nodes)) is not None:
        links, added, beyond = _links(*arrays, root, most)
        return Connected(staged(edges.unionByName(spark.createDataFrame(links).withColumn("slot", F.col("slot").cast("int"))), "connected") if added else edges, added, beyond)
    seen = staged(spark.createDataFrame([(root,)], "node long"), "reached")
    seen, added, beyond = _flooded(edges, seen, seen), 0, 0
    while True:
        left = staged(nodes.select("vec_id").join(seen.withColumnRenamed("node", "vec_id"), "vec_id", "left_anti"), "unreached")
        if left.isEmpty():
            return Connected(edges, added, beyond)
        labels = staged(reach_labels(edges, left), "labels")
        upstream = edges.join(labels, edges.src == labels.node).groupBy("dst").agg(F.max("label").alias("feeder")).withColumnRenamed("dst", "node")
        heads = labels.where("node = label").join(upstream, "node", "left").where("feeder is null or feeder <= node").select(F.col("node").alias("vec_id"))
        degrees = edges.groupBy(F.col("src").alias("node")).agg((F.max("slot") + 1).alias("next"), F.count(F.lit(1)).alias("degree"))
        hosts = staged(seen.join(degrees, "node", "left").na.fill(0, ["next", "degree"]), "hosts")
        free = hosts.where(F.col("degree") < most)
        full = free.isEmpty()
        pairs = numbered((hosts if full else free).select(F.col("node").alias("vec_id"))).select("local_id", F.col("global_id").alias("src"))
        links = pairs.join(numbered(heads).select("local_id", F.col("global_id").alias("dst")), "local_id")
        links = staged(links.join(hosts.select(F.col("node").alias("src"), F.col("next").cast("int").alias("slot")), "src").select("src", "dst", "slot"), "links")
        n = links.count()
        added, beyond = added + n, beyond + (n if full else 0)
        edges = staged(edges.unionByName(links), "connected")
        new = links.select(F.col("dst").alias("node"))
        seen = _flooded(edges, staged(seen.unionByName(new), "reached"), new)


def connect_both_ways(edges: DataFrame, nodes: DataFrame, root: int, most: int) -> Connected:
    """As connect, and edges are added until all nodes lead to root as well: a search may enter anywhere and can go on to all nodes. The latter edges follow a node's others, beyond its limit if need be."""
    out = connect(edges, nodes, root, most)
    back = out.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    back = staged(back.withColumn("slot", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("int")), "reversed")
    again = connect(back, nodes, root, 1 << 30)
    new = again.edges.join(back, ["src", "dst"], "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    degrees = out.edges.groupBy("src").agg((F.max("slot") + 1).alias("next"), F.count(F.lit(1)).alias("degree"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    new = staged(new.withColumn("at", place).join(degrees, "src", "left").na.fill(0, ["next", "degree"]).select("src", "dst", (F.col("next") + F.col("at")).cast("int").alias("slot"), (F.col("degree") + F.col("at")).alias("degree")), "links-back")
    over = new.where(F.col("degree") >= most).count()
    return Connected(staged(out.edges.unionByName(new.drop("degree")), "connected"), out.added + again.added, out.beyond + over)


def connect_all(edges: DataFrame, nodes: DataFrame, roots: list[int], most: int) -> Connected:
    """As connect, until each of the roots leads to all nodes: the first is led to all, then every root to the first."""
    done = connect(edges, nodes, roots[0], most)
    back = reachable(done.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots[0]).select("node")
    reaching = {r.node for r in back.where(F.col("node").isin(roots)).collect()}  # roots alone
    edges, added, beyond = done.edges, done.added, done.beyond
    for root in roots:
        if root in reaching:
            continue
        mine = reachable(edges, root).select("node")
        degrees = edges.groupBy(F.col("src").alias("node")).agg((F.max("slot") + 1).alias("next"), F.count(F.lit(1)).alias("degree"))
        host = mine.join(degrees, "node", "left").na.fill(0, ["next", "degree"]).orderBy(F.col("degree") >= most, "node").limit(1).head()
        link = edges.sparkSession.createDataFrame([(host.node, roots[0], int(host.next))], "src long, dst long, slot int")
        edges, added, beyond = staged(edges.unionByName(link), "connected"), added + 1, beyond + (host.degree >= most)
        reaching.add(root)
    return Connected(edges, added, int(beyond))


def start_graph(vectors: DataFrame, start, seed: str = "start") -> DataFrame:
    """The graph that is refined, nearest first: an edge table over the same rows, or what the parameters of a builder give."""
    if isinstance(start, DataFrame):
        ids = vectors.select(F.col("vec_id").alias("src"))
        if not start.select("src").join(ids, "src", "left_anti").isEmpty() or start.select("src").distinct().count() != ids.count():
            raise ValueError("the start graph has other rows")
        return start.select("src", "dst", "slot")
    match start:
        case EfannaParams():
            return nn_descent(vectors, start, seed)
        case BruteforceKNNParams():
            return knn_graph(vectors, start.degree)
        case RNGGParams():
            return rng_graph(vectors, start, seed)
        case int():
            return random_graph(vectors, start, seed)
    raise ValueError(f"no start graph for {start}")


def nssg_graph(vectors: DataFrame, params: NSSGParams, start=None, seed: str = "nssg") -> tuple[Connected, list[int]]:
    """The graph and its entry points. start: as for start_graph, by default neighbour descent with k = l = range."""
    n = vectors.count()
    roots = [r.vec_id for r in vectors.select("vec_id").orderBy(shuffled(seed, "vec_id")).limit(min(params.n_try, n)).collect()]  # n_try rows
    if n <= SMALL:
        return Connected(complete_graph(vectors).select("src", "dst", "slot"), 0, 0), roots
    most, pool_size = min(params.range, n - 1), min(params.l, n)
    angle = angle_from_dim(vectors.select(F.size("embedding")).head()[0]) if params.derive_angle_from_dim else params.angle
    given = start_graph(vectors, EfannaParams(k=params.range, l=params.range) if start is None else start)
    first = staged(nearest_first(given, vectors, most), "nssg-start")
    pool = two_hop(first, pool_size).select("src", "dst").unionByName(first.select("src", "dst")).distinct()
    kept = staged(angle_prune(with_distances(pool, vectors), vectors, angle, most), "nssg-kept")
    linked = staged(reverse_insert(kept, vectors, angle, most), "nssg-linked")
    return connect_all(linked, vectors, roots, most), roots
