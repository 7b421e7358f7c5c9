"""Graph indexes as tables: built shard by shard, searched shard by shard, merged by a window.

Builders that insert points one after another have no distributed form. A table is dealt into shards of at
most `shard_rows` rows (by default SHARD_ROWS) by hash of the id, each shard's graph is built in one task, and a query goes to every shard; the k best of
all shards are exact with respect to what the shards return. One shard gives the plain single-graph index.
An index is a table: shard, level, local_id, vec_id, embedding, neighbours (local ids), parent. Nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BruteforceKNNParams, DEGParams, EfannaParams, HNSWParams, NSSGParams, RNGGParams, RNNParams
from ..storage import staged
from . import kernels
from .beam import GraphIndex, GraphLevel, search_graph
from .graphs import rng_graph
from .knn import knn_graph, matrix, merged, tops
from .selectors import numbered

INDEX = "shard long, level int, local_id long, vec_id long, embedding array<float>, neighbours array<long>, parent long, entry boolean"
_FIELDS = pa.schema(
    [("shard", pa.int64()), ("level", pa.int32()), ("local_id", pa.int64()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("neighbours", pa.list_(pa.int64())), ("parent", pa.int64()), ("entry", pa.bool_())]
)
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())])


#: Rows of a shard by default.
SHARD_ROWS = 50_000
#: Queries that a shard's task takes, about.
QUERIES = 20_000
#: Parameters that the in-memory builders do not read: only their defaults are taken.
UNREAD = {
    DEGParams: ("improve_eps", "max_path_length"),
    HNSWParams: ("n_rounds", "finetune_rnn", "finetune_sen", "post_prune_heuristic", "n_parallel_burnin", "insert_minibatch_size"),
    RNGGParams: ("degree_short_edges",),
    RNNParams: ("concurrent_batch_size",),
    BruteforceKNNParams: ("batch_size",),
}


def local_builder(params, start=None, seed: int = 0) -> Callable[[np.ndarray], tuple[list, list[int]]]:
    """x -> (levels, entry points) for the parameters of a builder; start: an NSSG's input graph, as parameters of its builder (neighbour descent if none) or as lists of rows."""
    for name in UNREAD.get(type(params), ()):
        if getattr(params, name) != getattr(type(params)(), name):
            raise ValueError(f"{type(params).__name__}.{name} is not implemented in the in-memory builder")

    def flat(adjacency, n, entries=(0,)):
        ids = np.arange(n)
        return [(ids, adjacency, ids)], list(entries)

    def build(x: np.ndarray):
        n = len(x)
        if n <= 2:
            return flat([[j for j in range(n) if j != i] for i in range(n)], n)
        match params:
            case DEGParams():
                return flat(kernels.build_deg(x, params, seed), n)
            case RNNParams():
                return flat(kernels.build_rnn_descent(x, params, seed), n)
            case HNSWParams():
                return kernels.build_hnsw(x, params, seed), [0]
            case NSSGParams():
                given = start if isinstance(start, list) else local_builder(start or EfannaParams(k=params.range, l=params.range), None, seed)(x)[0][0][1]
                if len(given) != n:
                    raise ValueError("the start graph has other rows")
                adjacency, roots = kernels.build_nssg(x, given, params, seed)
                return flat(adjacency, n, roots)
            case RNGGParams():
                return flat(kernels.build_rngg(x, params, f"rngg{seed or ''}"), n)
            case EfannaParams():
                return flat(kernels.build_efanna(x, params, seed), n)
            case BruteforceKNNParams():
                return flat(kernels.nearest_lists(x, params.degree), n)
        raise ValueError(f"no builder for {params}")

    return build


def _table_edges(vectors: DataFrame, params: BruteforceKNNParams | RNGGParams, seed: int) -> DataFrame:
    """src, dst, slot of the graph that a single shard would have: rows are numbered in order of vec_id, and ends are drawn among these numbers."""
    if isinstance(params, BruteforceKNNParams):
        return knn_graph(vectors, params.degree).select("src", "dst", "slot")
    numbers = staged(numbered(vectors.select("vec_id")), "index-numbers")
    rows = vectors.join(numbers, vectors.vec_id == numbers.global_id).select(F.col("local_id").alias("vec_id"), "embedding")
    edges = rng_graph(rows, params, f"rngg{seed or ''}")
    named = lambda a, b: numbers.select(F.col("local_id").alias(a), F.col("global_id").alias(b))
    return edges.withColumnsRenamed({"src": "a", "dst": "b"}).join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst", "slot")


def build_index(vectors: DataFrame, params, start=None, shard_rows: int | None = None, seed: int = 0) -> DataFrame | GraphIndex:
    """The index table of vectors (vec_id, embedding); a shard's rows are numbered in order of vec_id.

    Random and exact neighbour graphs have a form on tables: beyond one shard they are one graph over all rows, unless shard_rows asks for shards.
    """
    n = vectors.count()
    if shard_rows is None and n > SHARD_ROWS and isinstance(params, BruteforceKNNParams | RNGGParams):
        local_builder(params)  # what it does not take
        return index_from_edges(vectors, staged(_table_edges(vectors, params, seed), "index-edges"))
    shards = max(1, math.ceil(n / (shard_rows or SHARD_ROWS)))
    dealt = vectors.select("vec_id", "embedding").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    build = local_builder(params, start, seed)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x, ids, shard = matrix(table["embedding"]), table["vec_id"].to_numpy(), table["shard"][0].as_py()
        levels, entries = build(x)
        parts = []
        for number, (rows, adjacency, parent) in enumerate(levels):
            m = len(rows)
            chosen = set(entries) if number == len(levels) - 1 else ()
            parts.append(
                pa.table(
                    [
                        pa.array(np.full(m, shard)), pa.array(np.full(m, number, np.int32)), pa.array(np.arange(m)), pa.array(ids[rows]), table["embedding"].take(pa.array(rows)).combine_chunks().cast(pa.list_(pa.float32())),
                        pa.array([list(map(int, a)) for a in adjacency], pa.list_(pa.int64())), pa.array(np.asarray(parent, np.int64)), pa.array([i in chosen for i in range(m)]),
                    ],
                    schema=_FIELDS,
                )
            )
        return pa.concat_tables(parts)

    return staged(dealt.groupBy("shard").applyInArrow(run, INDEX), "index")


def _never_stops(n: int, k: int, ef: int, max_frontier: int | None, eps: float | None) -> bool:
    """Whether a search may go on to all that its entries lead to: its heap and frontier hold all n rows (by range that is found out later)."""
    return eps is not None or (max(ef, k) >= n and (max_frontier is None or max_frontier >= n))


def _same_reach(adjacency: list, starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows that the first query's entries lead to, and for each query whether its own lead to just these."""
    met = kernels.led_to(adjacency, starts[0])
    if all(s == starts[0] for s in starts):
        return met, np.ones(len(starts), bool)
    back = kernels.led_to(kernels.reversed_lists(adjacency), starts[0][:1])
    whole = met & back  # lead to the first entry, and so to what it leads to
    met = kernels.led_to(adjacency, starts[0][:1])
    return met, np.array([any(whole[i] for i in s) and all(met[i] for i in s) for s in starts])


def _radius_holds(found: list[tuple[int, int, float]], qs: np.ndarray, x: np.ndarray, k: int, eps: float) -> np.ndarray:
    """Whether the radius of a search by range never shuts out a row: even that of the final k-th best spans all rows."""
    held, kth = np.bincount([i for i, _, _ in found], minlength=len(qs)), np.zeros(len(qs))
    for i, _, d in found:
        kth[i] = max(kth[i], d)
    middle = x.mean(axis=0)
    most = (np.sqrt(((qs - middle) ** 2).sum(1)) + np.sqrt(((x - middle) ** 2).sum(1).max())) ** 2
    return (held < k) | (kth * (1 + eps) > most * (1 + 1e-9))


def search(
    index: DataFrame | GraphIndex, queries: DataFrame, k: int, ef: int | None = None, ef_higher: int = 1, max_frontier: int | None = None, from_level: int | None = None, eps: float | None = None, copies: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, dist. ef defaults to 2k. from_level leaves out the levels above it. eps: the bottom is searched by range.

    A graph over edge tables is walked in rounds (`beam`). Of an index of shards, a query goes to every shard, so work grows with the number of shards; with fewer shards than cores
    each shard is sent to several tasks (`copies`) that share its queries, and so it is where there are more than QUERIES, of which a task holds what was found. A search whose heap holds all rows sees all that its entries lead to, so it is a scan of these.
    """
    if isinstance(index, GraphIndex):
        return search_graph(index, queries, k, ef, ef_higher, max_frontier, from_level, eps)
    ef = ef or 2 * k
    if from_level is not None:
        index = index.where(F.col("level") <= from_level)
    last = index.agg(F.max("shard")).head()[0] or 0
    if copies is None:
        n = queries.count()
        copies = max(1, min(index.sparkSession.sparkContext.defaultParallelism // (last + 1), n // 32), math.ceil(n / QUERIES))
    asked = queries.select("query_id", F.col("embedding").alias("wanted"), F.explode(F.expr(f"sequence(0L, {last}L)")).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int").alias("copy"))
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def run(rows: pa.Table, asked_: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked_.num_rows:
            return _FOUND.empty_table()
        rows = rows.sort_by([("level", "ascending"), ("local_id", "ascending")])
        level = rows["level"].to_numpy()
        bottom = rows.slice(0, int((level == 0).sum()))
        x, ids = matrix(bottom["embedding"]), bottom["vec_id"].to_numpy()
        place = {v: i for i, v in enumerate(ids.tolist())}
        levels = []
        for number in range(int(level.max()) + 1):
            part = rows.slice(int((level < number).sum()), int((level == number).sum()))
            levels.append((np.array([place[v] for v in part["vec_id"].to_pylist()]), part["neighbours"].to_pylist(), part["parent"].to_numpy()))
        entries = [i for i, e in enumerate(rows.slice(int((level < level.max()).sum()))["entry"].to_pylist()) if e] or [0]
        q_ids, qs, out = asked_["query_id"].to_numpy(), matrix(asked_["wanted"]), []
        starts, scanned = None, np.zeros(len(q_ids), bool)
        if len(x) and len(levels[0][0]) == len(x) and _never_stops(len(x), k, ef, max_frontier, None if len(levels) > 1 else eps):
            if len(levels) > 1:
                starts = [kernels.descend(x, levels, q, ef_higher, max_frontier, entries) for q in qs]
            met, scanned = _same_reach(levels[0][1], [entries] * len(qs) if starts is None else starts)
            for i, v, d in tops(np.flatnonzero(scanned), qs[scanned], ids[met], x[met], k, False):
                out += zip(i.tolist(), v.tolist(), d.tolist(), strict=True)
            if eps is not None and len(levels) == 1:
                scanned &= _radius_holds(out, qs, x, k, eps)
                out = [o for o in out if scanned[o[0]]]
            out = [(int(q_ids[i]), v, d) for i, v, d in out]
        for at in np.flatnonzero(~scanned).tolist():
            query_id, q = int(q_ids[at]), qs[at]
            if eps is not None and len(levels) == 1:
                got = kernels.range_search(x, levels[0][1], q, entries, k, eps)
            elif len(levels) == 1:
                got = kernels.greedy_search(x, levels[0][1], q, entries, k, max(ef, k), max_frontier)
            else:
                got = kernels.layered_search(x, levels, q, k, ef, ef_higher, max_frontier, entries)
            out += [(query_id, int(ids[i]), d) for d, i in got]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND) if out else _FOUND.empty_table()

    found = index.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInArrow(run, "query_id long, vec_id long, dist double")
    return merged(found, k)


def one_shard(vectors: DataFrame, most: int) -> DataFrame:
    """vectors, if a task can hold them as one shard."""
    if (n := vectors.count()) > most:
        raise ValueError(f"{n} rows are too many for one shard of {most}; build_index deals them to shards")
    return vectors


def index_from_edges(vectors: DataFrame, edges: DataFrame, roots: list[int] | None = None) -> GraphIndex:
    """A graph of one level from an edge table; roots are the entry points, by default the row with the least id."""
    if roots is None:
        least = vectors.agg(F.min("vec_id")).head()[0]
        roots = [] if least is None else [least]
    return GraphIndex(vectors.select("vec_id", "embedding"), [GraphLevel(edges.select("src", "dst", "slot"), roots)])


def index_nodes(index: DataFrame | GraphIndex) -> DataFrame:
    """level, vec_id of an index that build_index made."""
    return index.vectors.select(F.lit(0).alias("level"), "vec_id") if isinstance(index, GraphIndex) else index.select("level", "vec_id")


def index_edges(index: DataFrame | GraphIndex) -> DataFrame:
    """level, src, dst, slot in ids of vectors."""
    if isinstance(index, GraphIndex):
        out = [level.edges.select(F.lit(i).alias("level"), "src", "dst", "slot") for i, level in enumerate(index.levels)]
        return reduce(DataFrame.unionByName, out)
    flat = index.select("shard", "level", F.col("vec_id").alias("src"), F.posexplode("neighbours").alias("slot", "local"))
    ends = index.select(F.col("shard").alias("s"), F.col("level").alias("l"), F.col("local_id").alias("i"), F.col("vec_id").alias("dst"))
    return flat.join(ends, (F.col("shard") == F.col("s")) & (F.col("level") == F.col("l")) & (F.col("local") == F.col("i"))).select("level", "src", "dst", "slot")


def neighbours_of(index: DataFrame | GraphIndex, level: int, vec_id: int) -> DataFrame:
    return index_edges(index).where((F.col("level") == level) & (F.col("src") == vec_id)).select("dst", "slot")
