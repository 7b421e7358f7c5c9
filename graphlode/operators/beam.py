"""Search of graphs of any size: every query walks the edge table in rounds, and no task holds a graph of more than HELD_MB.

A query's state is what it has seen so far: distances of nodes, and neighbour lists of those it asked for. In a round

1. the nodes that queries ask for are joined with the neighbour lists (one row a node),
2. the neighbours that a query has not seen are joined with the vector table,
3. each query takes both in and searches again over what it has, by the same best-first search as in memory (`kernels`), until that needs a list which it does not
   have. Then it asks for that node and, ahead of need, for its nearest other ones.

So a round brings a query many steps further, and the result is that of the search in memory, row for row: what was fetched too much is never looked at. A query
whose search ends leaves the rounds. Queries share a task in buckets of bounded count; a query's state grows with what it meets, not with the graph.
A node that many queries ask for at once makes a large key on the side of the asking rows only, which Spark's skew join splits.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import exact_distances
from ..storage import staged
from . import kernels
from .graphs import held
from .knn import knn, matrix, merged

#: Queries that share a task's group, and the fewest nodes that a query asks for in a round.
BUCKET, AHEAD = 32, 24
#: MB of vectors and neighbour lists (8 bytes a number) up to which each task holds a graph, with the queries that it was dealt.
HELD_MB = 192

_STATE = pa.schema(
    [("bucket", pa.int64()), ("query_id", pa.int64()), ("q", pa.list_(pa.float32()))]
    + [(c, pa.list_(pa.float64() if "dists" in c else pa.int64())) for c in ("entries", "asked", "seen", "dists", "nodes", "sizes", "ends", "found", "found_dists")]
)
_STATE_DDL = "bucket long, query_id long, q array<float>, entries array<long>, asked array<long>, seen array<long>, dists array<double>, nodes array<long>, sizes array<long>, ends array<long>, found array<long>, found_dists array<double>"


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())])


@dataclass(frozen=True)
class GraphLevel:
    """edges: src, dst, slot in ids of the vector table; entries: where a search that begins here starts."""

    edges: DataFrame
    entries: list[int]
    known: dict = field(default_factory=dict, compare=False, repr=False)  # what was found out about its reach


@dataclass(frozen=True)
class GraphIndex:
    """A stack of graphs over rows of one vector table, from the bottom; ids are those of the table everywhere."""

    vectors: DataFrame
    levels: list[GraphLevel]

    def only(self, levels: list[int]) -> GraphIndex:
        """Some of the levels, the bottom among them. A row has one id on all levels, so what a level finds is where any lower one is entered."""
        if 0 not in levels:
            raise ValueError("the bottom cannot be left out")
        return GraphIndex(self.vectors, [self.levels[i] for i in sorted(levels)])


class _Unfetched(Exception):
    def __init__(self, node: int):
        self.node = node


class _Lists(dict):
    def __missing__(self, node):
        raise _Unfetched(node)


def _lists(column: pa.ChunkedArray) -> list[list]:
    """The lists of a column, nulls as empty ones."""
    held = column.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)).tolist()
    values = held.flatten().to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _column(lists: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(lists)), kind))


def _advance(known: dict, fetched: dict, entries: list, q: np.ndarray, k: int, ef: int, max_frontier: int | None, eps: float | None, ahead: int) -> tuple[list, list | None]:
    """Searches over known (node -> distance) and fetched (node -> list): (asked, found), one of which is to be looked at."""
    measured = lambda rows: np.array([known[r] for r in rows])
    # entries and neighbours that no vector has are in no table
    real = _Lists((i, [j for j in a if j in known]) for i, a in fetched.items())
    entries = [e for e in entries if e in known]
    if not entries:
        return [], []
    try:
        if eps is not None:
            return [], kernels.range_search(measured, real, q, entries, k, eps)
        return [], kernels.greedy_search(measured, real, q, entries, k, max(ef, k), max_frontier)
    except _Unfetched as stopped:
        nearest = [i for _, i in heapq.nsmallest(ahead, ((d, i) for i, d in known.items() if i not in fetched))]
        return nearest if stopped.node in nearest else [stopped.node, *nearest[: ahead - 1]], None


def _round(k: int, ef: int, max_frontier: int | None, eps: float | None, ahead: int):
    """Takes in what has come for the queries of a bucket and searches on: sets `found`, or `asked` anew."""

    def run(states: pa.Table, lists: pa.Table, vectors: pa.Table) -> pa.Table:
        place = {i: at for at, i in enumerate(states["query_id"].to_pylist())}
        came: list[list[int]] = [[] for _ in place]  # rows of vectors
        for row, i in enumerate(vectors["query_id"].to_pylist()):
            came[place[i]].append(row)
        nodes, sizes, ends, seen, dists = (_lists(states[c]) for c in ("nodes", "sizes", "ends", "seen", "dists"))
        for i, node, own in zip(lists["query_id"].to_pylist(), lists["node"].to_pylist(), _lists(lists["ends"]) if lists.num_rows else (), strict=True):
            at = place[i]
            nodes[at].append(node)
            sizes[at].append(len(own))
            ends[at] += own
        q, all_entries = matrix(states["q"]), _lists(states["entries"])
        x, x_ids = (matrix(vectors["embedding"]), vectors["node"].to_pylist()) if vectors.num_rows else (None, [])
        asked, found = [], []
        for at in range(len(place)):
            known = dict(zip(seen[at], dists[at], strict=True))
            if came[at]:
                d = exact_distances(x[came[at]], np.broadcast_to(q[at], (len(came[at]), x.shape[1])))
                known.update(zip((x_ids[row] for row in came[at]), d.tolist(), strict=True))
            seen[at], dists[at] = list(known), list(known.values())
            stops = np.cumsum(sizes[at]).tolist()
            fetched = {n: ends[at][a:b] for n, a, b in zip(nodes[at], [0, *stops], stops, strict=False)}
            more, got = _advance(known, fetched, all_entries[at], q[at], k, ef, max_frontier, eps, ahead)
            asked.append(more)
            found.append(got)
        made = {
            "asked": _column(asked, pa.int64()), "seen": _column(seen, pa.int64()), "dists": _column(dists, pa.float64()), "nodes": _column(nodes, pa.int64()), "sizes": _column(sizes, pa.int64()), "ends": _column(ends, pa.int64()),
            "found": pa.array([None if f is None else [i for _, i in f] for f in found], pa.list_(pa.int64())), "found_dists": pa.array([None if f is None else [d for d, _ in f] for f in found], pa.list_(pa.float64())),
        }
        return pa.Table.from_arrays([made[c] if c in made else states[c].combine_chunks() for c in _STATE.names], names=_STATE.names).cast(_STATE)

    return run


def _apply(states: DataFrame, lists: DataFrame, vectors: DataFrame, step) -> DataFrame:
    """One round: states, lists (query_id, node, ends) and vectors (query_id, node, embedding) of a bucket meet."""
    kinds = lists.select("bucket", "query_id", "node", "ends", F.lit(None).cast("array<float>").alias("embedding"), F.lit(False).alias("vector"))
    both = kinds.unionByName(vectors.select("bucket", "query_id", "node", F.lit(None).cast("array<long>").alias("ends"), "embedding", F.lit(True).alias("vector")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _STATE.empty_table()
        right = right.sort_by([("query_id", "ascending"), ("node", "ascending")])
        return step(left.select(_STATE.names), right.filter(pc.invert(right["vector"])), right.filter(right["vector"]))

    return states.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(run, _STATE_DDL)


def _held_walk(vectors: DataFrame, ends: DataFrame, queries: DataFrame, k: int, ef: int, max_frontier: int | None, eps: float | None) -> DataFrame | None:
    """The result of walk where tasks can hold the graph, which is counted first: no rounds, and no state leaves a task. None where it is too large."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).head()
    if (size.n * ((size.d or 0) + 1) + (ends.agg(F.sum(F.size("ends"))).head()[0] or 0)) * 8 > HELD_MB << 20:
        return None
    copies = max(1, min(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(queries.count() / BUCKET)))
    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("q"), F.col("entries").cast("array<long>").alias("entries"), F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int").alias("copy"))
    # a row a node, sent once to each task
    graph = staged(vectors.join(ends, "node", "left").select("node", "embedding", "ends"), "walk-graph").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def run(rows: pa.Table, asked_: pa.Table) -> pa.Table:
        if not asked_.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        rows = rows.sort_by("node")
        ids, x, own = rows["node"].to_numpy(), matrix(rows["embedding"]), rows["ends"].combine_chunks()
        b = own.flatten().to_numpy(zero_copy_only=False)
        real = np.isin(b, ids)  # ends that no vector has are in no table
        a = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))[real]
        lists = _Places(np.searchsorted(a, np.arange(len(ids) + 1)), np.searchsorted(ids, b[real]))
        qs, out = matrix(asked_["q"]), []
        for q, query_id, entries in zip(qs, asked_["query_id"].to_pylist(), _lists(asked_["entries"]), strict=True):
            entries = [int(p) for p, e in zip(np.searchsorted(ids, entries), entries, strict=True) if p < len(ids) and ids[p] == e]
            if not entries:
                continue
            got = kernels.range_search(x, lists, q, entries, k, eps) if eps is not None else kernels.greedy_search(x, lists, q, entries, k, max(ef, k), max_frontier)
            out += [(query_id, int(ids[i]), float(d)) for d, i in got]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND) if out else _FOUND.empty_table()

    found = graph.groupBy("copy").cogroup(asked.groupBy("copy")).applyInArrow(run, "query_id long, vec_id long, dist double")
    return merged(found, k)


class _Places:
    """Neighbour lists as slices of one array."""

    def __init__(self, at: np.ndarray, ends: np.ndarray):
        self.at, self.ends, self.made = at, ends, {}

    def __getitem__(self, i: int) -> list[int]:
        if i not in self.made:
            self.made[i] = self.ends[self.at[i] : self.at[i + 1]].tolist()
        return self.made[i]


def walk(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, ef: int, max_frontier: int | None = None, eps: float | None = None, ahead: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, dist of a best-first search from each query's own entries.

    edges: src, dst, slot; queries: query_id (all different), embedding, entries (array of vec_id). With eps it is a search by range. ahead: nodes that a query asks for at a time (by
    default half of ef, at least AHEAD). Entries and ends that are no rows of vectors are passed over. Where HELD_MB allows, each task holds the graph instead.
    """
    ahead = ahead or max(AHEAD, -(-ef // 2))
    ends = edges.groupBy(F.col("src").alias("node")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("slot", "dst"))), lambda e: e["dst"])).alias("ends"))
    ends = staged(ends, "neighbour-lists")  # as long as a node's degree
    vectors = vectors.select(F.col("vec_id").alias("node"), "embedding")
    if (result := _held_walk(vectors, ends, queries, k, ef, max_frontier, eps)) is not None:
        return result
    buckets = max(1, math.ceil(queries.count() / BUCKET))
    none = F.array().cast("array<long>")
    states = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(buckets)).alias("bucket"), "query_id", F.col("embedding").cast("array<float>").alias("q"), F.col("entries").cast("array<long>").alias("entries"), F.col("entries").cast("array<long>").alias("asked"),
        none.alias("seen"), F.array().cast("array<double>").alias("dists"), none.alias("nodes"), none.alias("sizes"), none.alias("ends"), F.lit(None).cast("array<long>").alias("found"), F.lit(None).cast("array<double>").alias("found_dists"),
    )
    states = staged(states, "walk")
    done, step = [], _round(k, ef, max_frontier, eps, ahead)
    while not states.isEmpty():
        wanted = states.select("bucket", "query_id", F.explode(F.array_distinct("asked")).alias("node"))
        # a node without edges has an empty list, so that nobody asks for it again
        lists = staged(wanted.join(ends, "node", "left").select("bucket", "query_id", "node", F.coalesce("ends", none).alias("ends")), "walk-lists")
        near = lists.groupBy("query_id").agg(F.flatten(F.collect_list("ends")).alias("ends"))
        new = F.array_except(F.concat(F.coalesce("ends", none), "entries"), "seen")
        unseen = states.select("bucket", "query_id", "seen", "entries").join(near, "query_id", "left").select("bucket", "query_id", F.explode(new).alias("node"))
        states = staged(_apply(states, lists, unseen.join(vectors, "node"), step), "walk")
        done.append(states.where("found is not null").select("query_id", "found", "found_dists"))
        states = states.where("found is null")
    if not done:
        return merged(queries.sparkSession.createDataFrame([], "query_id long, vec_id long, dist double"), k)
    results = done[0]
    for d in done[1:]:
        results = results.unionByName(d)
    pairs = results.select("query_id", F.explode(F.arrays_zip("found", "found_dists")).alias("p")).select("query_id", F.col("p.found").alias("vec_id"), F.col("p.found_dists").alias("dist"))
    return merged(pairs, k)


def _led_to(index: GraphIndex, starts: list[int], back: bool = False) -> tuple[DataFrame, bool]:
    """vec_id of the rows that paths over the bottom's edges lead to from starts, or that lead to these, and whether these are all; ends that are no rows lead nowhere. Up to HELD edges are held for it."""
    ids, known = index.vectors.select("vec_id"), index.levels[0].known
    if "held" not in known:
        known["held"] = held(index.levels[0].edges.select("src", "dst"), ids)
    if known["held"] is not None:
        src, dst, rows = known["held"]
        rows = np.unique(rows)
        real = np.isin(src, rows) & np.isin(dst, rows)
        a, b = np.searchsorted(rows, src[real]), np.searchsorted(rows, dst[real])
        met = np.zeros(len(rows), bool)
        kernels.Steps(*((b, a) if back else (a, b)), len(rows)).flood(met, np.flatnonzero(np.isin(rows, starts)))
        if met.all():
            return ids, True
        return index.vectors.sparkSession.createDataFrame(pa.table({"vec_id": rows[met]})), False
    a, b = ("dst", "src") if back else ("src", "dst")
    steps = staged(index.levels[0].edges.select(F.col(a).alias("vec_id"), F.col(b).alias("to")).distinct(), "steps")
    frontier = staged(ids.where(F.col("vec_id").isin(starts)), "reached")
    seen = frontier
    while not frontier.isEmpty():
        ends = frontier.join(steps, "vec_id").select(F.col("to").alias("vec_id")).distinct().join(ids, "vec_id", "left_semi")
        frontier = staged(ends.join(seen, "vec_id", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    seen = staged(seen, "reached")
    return seen, seen.count() == ids.count()


def scanned(index: GraphIndex, depth: int) -> DataFrame | None:
    """The rows that a search sees which begins at level depth - 1 and never stops early, if these are the same for every query: what the entries of a single level lead to, or
    all rows, where each leads to each other, wherever the levels above enter. All rows are the index's own table."""
    bottom, entries = index.levels[0], index.levels[depth - 1].entries
    if depth == 1:
        if "reached" not in bottom.known:
            seen, whole = _led_to(index, entries)
            bottom.known["reached"] = index.vectors if whole else index.vectors.join(seen, "vec_id", "left_semi")
        return bottom.known["reached"]
    if "strong" not in bottom.known:
        first = index.vectors.agg(F.min("vec_id")).head()[0]
        bottom.known["strong"] = first is not None and _led_to(index, [first])[1] and _led_to(index, [first], back=True)[1]
    entered = bottom.known["strong"] and not index.vectors.where(F.col("vec_id").isin(entries)).isEmpty()
    return index.vectors if entered else None


def full_scan(index: GraphIndex, k: int, ef: int | None = None, max_frontier: int | None = None, from_level: int | None = None, eps: float | None = None) -> DataFrame | None:
    """The rows whose scan is the result of a search with these settings, if it is one: its heap and frontier hold all rows, and `scanned` tells which it sees."""
    depth = len(index.levels) if from_level is None else min(from_level + 1, len(index.levels))
    if (eps is not None and depth == 1) or max(ef or 2 * k, k) < (n := index.vectors.count()) or (max_frontier is not None and max_frontier < n):
        return None
    return scanned(index, depth)


def _ids(ids: list[int]) -> Column:
    return F.array(*(F.lit(i).cast("long") for i in ids)) if ids else F.array().cast("array<long>")


def search_graph(
    index: GraphIndex, queries: DataFrame, k: int, ef: int | None = None, ef_higher: int = 1, max_frontier: int | None = None, from_level: int | None = None, eps: float | None = None
) -> DataFrame:
    """query_id, rank, vec_id, dist. ef defaults to 2k. from_level leaves out the levels above it; eps: a graph of one level is searched by range.

    With a heap and a frontier that hold all rows a search sees all that its entries lead to. Its result is then that of a scan of these rows, which needs no state of all rows for each query.
    """
    ef = ef or 2 * k
    levels = index.levels if from_level is None else index.levels[: from_level + 1]
    if (rows := full_scan(index, k, ef, max_frontier, from_level, eps)) is not None:
        return knn(rows, queries.withColumn("embedding", F.col("embedding").cast("array<float>")), k)
    entering = queries.select("query_id", "embedding", _ids(levels[-1].entries).alias("entries"))
    for level in reversed(levels[1:]):
        found = walk(index.vectors, level.edges, entering, ef_higher, ef_higher, max_frontier)
        # a row has the same id on the level below
        down = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("entries"))
        entering = staged(queries.select("query_id", "embedding").join(down, "query_id"), "entering")
    return walk(index.vectors, levels[0].edges, entering, k, max(ef, k), max_frontier, eps if len(levels) == 1 else None)
