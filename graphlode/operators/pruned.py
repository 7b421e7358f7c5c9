"""Exact nearest neighbours with cells that need no visit.

Rows go to the cell of their nearest pivot (a bounded number of rows, drawn by hash), and a cell's radius is the distance of its farthest row. By the triangle inequality no row of a cell
is nearer to a query than the pivot's distance less the radius. A query first visits the cells of its nearest pivots until they hold k rows; the k-th distance found there
rules out every cell whose bound exceeds it. On clustered data few are left; on data without structure all are, and the work is that of `knn`.

Cells that lie together form groups of BLOCK_ROWS rows, and a query is sent once to each group that holds a cell for it, however many do, so no more is shuffled than for the grid of `knn`. In a task
queries of the same region go together, and what none of them needs is passed over. Large cells are cut into blocks by a hash of the id, and so are the queries that meet in one group, so no task's group grows with the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import block_distances
from ..functions.seeded import shuffled
from ..storage import staged
from .knn import _batch, _PART, Base, block_top, GRID, local_top, matrix, merged, QUERIES

#: The most pivots, rows of a block or group of cells, and what distances may be off by in relation.
MOST_PIVOTS, BLOCK_ROWS, SLACK = 4096, 20_000, 1e-9
#: Rows of a group of cells in a small table.
SMALL_ROWS = 4096


@dataclass(frozen=True)
class _Cells:
    """Pivots (at most MOST_PIVOTS rows), their cells' radii and sizes."""

    x: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def apart(self, q: np.ndarray) -> np.ndarray:
        """Distances (not squared) of rows of q from the pivots."""
        return np.sqrt(block_distances(q, self.x))

    def needed(self, apart: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Whether a cell may hold a row that is no farther from a row of q than `kth` (squared)."""
        bounds = np.maximum(0.0, apart * (1 - SLACK) - self.radius - 1e-6)
        return (self.size > 0) & (bounds**2 <= (kth * (1 + SLACK) + SLACK)[:, None])

    def first(self, apart: np.ndarray, k: int) -> np.ndarray:
        """Whether a cell is among those of the nearest pivots that hold k rows together."""
        order = np.argsort(apart, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(apart.shape, bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return out & (self.size > 0)

    def only(self, some: np.ndarray) -> _Cells:
        return _Cells(self.x[some], self.radius[some], self.size[some])

    def groups(self, rows: int) -> np.ndarray:
        """A group for each cell: runs of cells of at most `rows` rows, or one larger cell, those nearest to the same few pivots together."""
        few = self.x[: math.isqrt(len(self.x))]
        out, group, held = np.zeros(len(self.x), np.int32), 0, 0
        for cell in np.argsort(block_distances(self.x, few).argmin(1), kind="stable").tolist():
            if held and held + self.size[cell] > rows:
                group, held = group + 1, 0
            out[cell] = group
            held += self.size[cell]
        return out


def _dealt(base: DataFrame, pivots: int, seed: str) -> tuple[DataFrame, _Cells]:
    n = base.count()
    m = max(1, min(pivots or math.isqrt(n), MOST_PIVOTS, n))
    held = base.orderBy(shuffled(seed, "vec_id"), "vec_id").limit(m).toArrow()  # at most MOST_PIVOTS rows
    x = matrix(held["embedding"])

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = block_distances(matrix(b.column(1)), x)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(cell)), cell]))], names=["vec_id", "embedding", "cell", "d"])

    cells = staged(base.mapInArrow(assign, "vec_id long, embedding array<float>, cell int, d double"), "pruned-cells")
    radius, size = np.zeros(len(x)), np.zeros(len(x), np.int64)
    for r in cells.groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        radius[r.cell], size[r.cell] = r.r, r.n
    return cells, _Cells(x, radius, size)


def _first(queries: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """query_id, embedding, cell of the first visits."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                some = b.slice(at, QUERIES)
                rows, cols = np.nonzero(cells.first(cells.apart(matrix(some.column(1))), k))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), some.column(1).take(pa.array(rows)), pa.array(cols.astype(np.int32))], names=["query_id", "embedding", "cell"])

    return queries.mapInArrow(run, "query_id long, embedding array<float>, cell int")


def _left(bounded: DataFrame, cells: _Cells, group: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The groups that hold a cell that kth does not rule out: query_id, embedding, kth, cell (the group) for each query; cell, n queries and their pairs for each group and batch."""
    count = int(group.max()) + 1
    member = np.zeros((len(group), count), np.float32)
    member[np.arange(len(group)), group] = 1
    sizes = member * cells.size[:, None]

    def needs(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                some = b.slice(at, QUERIES)
                yield some, cells.needed(cells.apart(matrix(some.column(1))), some.column(2).to_numpy(zero_copy_only=False)).astype(np.float32)

    def visits(batches):
        for some, need in needs(batches):
            rows, cols = np.nonzero(need @ member)
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in some.columns), pa.array(cols.astype(np.int32))], names=["query_id", "embedding", "kth", "cell"])

    def counts(batches):
        n, pairs = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for _, need in needs(batches):
            n += ((need @ member) > 0).sum(0)
            pairs += (need.sum(0, dtype=np.float64) @ sizes.astype(np.float64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(n), pa.array(pairs)], names=["cell", "n", "pairs"])

    return bounded.mapInArrow(visits, "query_id long, embedding array<float>, kth double, cell int"), bounded.mapInArrow(counts, "cell int, n long, pairs long")


def _search(rows: DataFrame, visits: DataFrame, sizes: dict[int, int], asked: dict[int, int], top) -> DataFrame:
    """What `top` finds of the visits (cell, query_id, ...) of each cell or group in its rows (cell, vec_id, ...). sizes, asked: rows and visits of each."""
    plan = [(c, -(-int(n) // BLOCK_ROWS), -(-int(asked[c]) // BLOCK_ROWS)) for c, n in sizes.items() if n and asked.get(c)]
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "cell int, blocks int, parts int"))  # at most MOST_PIVOTS rows
    left = rows.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    right = visits.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))

    def pair(b: pa.Table, q: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(p) for p in top(b, q)] if b.num_rows and q.num_rows else [], schema=_PART)

    keys = ("cell", "block", "part")
    left, right = left.drop("blocks", "parts"), right.drop("blocks", "parts")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, "query_id long, vec_id long, dist double")


def _top_of_groups(cells: _Cells, k: int, skip_self: bool):
    """The k nearest rows of a group for each query, among the cells that its kth does not rule out: a block of queries, sorted by their nearest pivot, meets the cells that any of them needs."""

    def top(b: pa.Table, q: pa.Table):
        own = b["own"].to_numpy()
        ids, x = b["vec_id"].to_numpy(), matrix(b["embedding"])
        present, place = np.unique(own, return_inverse=True)
        mine = cells.only(present)
        q_ids, qs, kth = q["query_id"].to_numpy(), matrix(q["embedding"]), q["kth"].to_numpy()
        nearest = np.concatenate([mine.apart(qs[i : i + QUERIES]).argmin(1) for i in range(0, len(qs), QUERIES)])
        order = np.argsort(nearest, kind="stable")
        whole = Base(ids, x)
        for at in range(0, len(order), QUERIES):
            some = order[at : at + QUERIES]
            near = mine.needed(mine.apart(qs[some]), kth[some]).any(0)[place]
            if near.any():
                base = whole if near.mean() > 0.7 else Base(ids[near], x[near])
                yield block_top(q_ids[some], qs[some], base, k, skip_self, kth[some])

    return top


def knn_pruned(base: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, pivots: int = 0, seed: str = "pivots") -> tuple[DataFrame, int]:
    """query_id, rank, vec_id, dist as knn gives them, and the number of pairs that were not ruled out. pivots: by default the root of the number of rows."""
    spark = base.sparkSession
    base, queries = base.select("vec_id", "embedding"), queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    if base.isEmpty():
        return merged(spark.createDataFrame([], "query_id long, vec_id long, dist double"), k), 0
    rows, cells = _dealt(base, pivots, seed)
    rows = rows.drop("d")

    def top(b, q):
        yield local_top(q["query_id"].to_numpy(), matrix(q["embedding"]), b["vec_id"].to_numpy(), matrix(b["embedding"]), k, skip_self)

    one = staged(_first(queries, cells, k + skip_self), "first-visits")
    asked = {r.cell: r["count"] for r in one.groupBy("cell").count().collect()}  # a row for each pivot
    found = merged(_search(rows, one, dict(enumerate(cells.size)), asked, top), k)
    kth = found.where(F.col("rank") == k).select("query_id", F.col("dist").alias("kth"))
    bounded = staged(queries.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf")))), "kth")

    group = cells.groups(min(BLOCK_ROWS, max(SMALL_ROWS, -(-int(cells.size.sum()) // GRID))))
    visits, counts = _left(bounded, cells, group)
    plan = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).collect()  # a row for each group, of which there are at most as many as pivots
    number = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "own int, cell int"))
    grouped = rows.withColumnRenamed("cell", "own").join(number, "own")
    sizes = dict(enumerate(np.bincount(group, weights=cells.size).astype(np.int64).tolist()))
    more = _search(grouped, visits, sizes, {r.cell: r.n for r in plan}, _top_of_groups(cells, k, skip_self))
    pairs = sum(int(cells.size[c]) * n for c, n in asked.items()) + sum(r.pairs for r in plan)
    return merged(more, k), int(pairs)
