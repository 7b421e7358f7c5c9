"""Exact nearest neighbours.

Queries whose vectors fit in `broadcast_mb` go to every task of the base table; beyond that, base and queries are
dealt to a grid of cells and each pair of cells is one group; cells have `cell_rows` rows, and grow up to GRID_ROWS where
there would be more than GRID of them. Either way a task keeps the k best of what it has
seen and one window merges them, so what is shuffled is k rows a query and task, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import block_distances, exact_distances, squared_l2
from ..model import KNN_RESULT

#: Queries and rows that a block of distances spans, and the pairs that a block of queries may hold as near.
QUERIES, BLOCK, MOST_NEAR = 256, 4096, 1 << 17
#: Cells of the grid along each side beyond which cells grow, and the rows that a cell may grow to.
GRID, GRID_ROWS = 16, 20_000

_PART = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Base:
    """Rows that many blocks of queries meet: what the Gram form needs of them is made once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, np.asarray(x, np.float64)
        self.middle = self.x.mean(axis=0)
        moved = self.x - self.middle
        squares = np.einsum("ij,ij->i", moved, moved)
        self.most = squares.max()
        # a last column of squares, so that the product with (-2 q, 1) is the squared distance less that of q
        self.wide = np.concatenate([moved, squares[:, None]], axis=1).astype(np.float32) if self.most <= 1e30 else None
        self.room = np.empty(QUERIES * min(BLOCK, len(self.x)), np.float32)


def _gram_near(q_ids, q, base: Base, k: int, skip_self: bool, most=None) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and columns of all pairs that may be among the k nearest of each q, by the Gram form in single precision, a block of the base at a time; None where that tells too little.

    A pair is left out only if it lies farther than the k-th best so far, or than what is known of it, by more than the form can err. Distances here are less the square of q.
    """
    q = q - base.middle
    qq = np.einsum("ij,ij->i", q, q)
    if base.wide is None or not np.isfinite(reach := qq.max() + base.most) or reach > 1e30:
        return None
    err = 2.0**-23 * (q.shape[1] + 8) * (qq + base.most)  # no less than what a sum of so many products can be off
    wide = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1).astype(np.float32)
    bar = np.full(len(q), np.inf) if most is None else most * (1 + 1e-9) - qq + 2 * err
    rows, cols, dists = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(base.wide), BLOCK):
        some = base.wide[at : at + BLOCK]
        d = np.matmul(wide, some.T, out=base.room[: len(wide) * len(some)].reshape(len(wide), len(some)))
        take = k + skip_self
        if not at and take <= d.shape[1] and not np.isfinite(bar).all():
            bar = np.minimum(bar, np.partition(d, take - 1, axis=1)[:, take - 1] + 2 * err)
        found = np.flatnonzero(d <= np.nextafter(bar.astype(np.float32), np.float32(np.inf))[:, None])
        new = d.ravel()[found].astype(np.float64)
        r, c = np.divmod(found, d.shape[1])
        if skip_self:
            other = q_ids[r] != base.ids[at + c]
            r, c, new = r[other], c[other], new[other]
        rows, cols, dists = np.concatenate([rows, r]), np.concatenate([cols, at + c]), np.concatenate([dists, new])
        order = np.lexsort((dists, rows))
        rows, cols, dists = rows[order], cols[order], dists[order]
        first, held = np.searchsorted(rows, np.arange(len(q))), np.bincount(rows, minlength=len(q))
        full = held >= k
        bar[full] = np.minimum(bar[full], dists[first[full] + k - 1] + 2 * err[full])
        near = dists <= bar[rows]
        rows, cols, dists = rows[near], cols[near], dists[near]
        if len(rows) > MOST_NEAR:
            return None
    return rows, cols


def _direct_near(q_ids, q, b_ids, b, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same in double precision."""
    d = block_distances(q, b)
    if skip_self:
        d[q_ids[:, None] == b_ids[None, :]] = np.inf
    take = min(k, len(b))
    bar = np.partition(d, take - 1, axis=1)[:, take - 1]
    return np.nonzero((d <= (bar + 1e-9 * (1.0 + bar))[:, None]) & np.isfinite(d))


def tops(q_ids, q, b_ids, b, k: int, skip_self: bool):
    """The k nearest rows of b for each q, ties by id, QUERIES of q at a time: found by the Gram form, decided by the direct sum."""
    if not len(q) or not len(b) or k <= 0:
        return
    base = Base(b_ids, b)
    for at in range(0, len(q), QUERIES):
        yield block_top(q_ids[at : at + QUERIES], np.asarray(q[at : at + QUERIES], np.float64), base, k, skip_self)


def block_top(q_ids, q, base: Base, k: int, skip_self: bool, most=None):
    """The same for at most QUERIES of q. most: squared distances beyond which nothing is asked for; not all beyond need be left out."""
    near = _gram_near(q_ids, q, base, k, skip_self, most)
    rows, cols = _direct_near(q_ids, q, base.ids, base.x, k, skip_self) if near is None else near
    exact = np.concatenate([exact_distances(q[rows[i : i + MOST_NEAR]], base.x[cols[i : i + MOST_NEAR]]) for i in range(0, len(rows), MOST_NEAR)] or [np.empty(0)])
    order = np.lexsort((base.ids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - first[rows] < k
    return q_ids[rows[keep]], base.ids[cols[keep]], exact[keep]


def local_top(q_ids, q, b_ids, b, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `tops` gives, in one piece."""
    out = list(tops(q_ids, q, b_ids, b, k, skip_self))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _batch(parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], schema=_PART)


def merged(parts: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "dist").to(_schema(parts))


def _schema(df: DataFrame):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(KNN_RESULT)


def knn(base: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, broadcast_mb: int = 64, cell_rows: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, dist. A query that is a row of base finds itself unless skip_self."""
    base, queries = base.select("vec_id", "embedding"), queries.select("query_id", "embedding")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).head()
    if size.n * (size.d or 0) * 8 <= broadcast_mb << 20:
        held = queries.toArrow()  # within broadcast_mb, as just counted
        q_ids, q = held["query_id"].to_numpy(), matrix(held["embedding"])
        q = q.astype(np.float32) if held.schema.field("embedding").type.value_type == pa.float32() else q

        def scan(batches):
            for b in batches:
                if b.num_rows and len(q_ids):
                    for found in tops(q_ids, q, b.column(0).to_numpy(), matrix(b.column(1)), k, skip_self):
                        yield _batch(found)

        return merged(base.repartition(max(1, base.sparkSession.sparkContext.defaultParallelism), "vec_id").mapInArrow(scan, "query_id long, vec_id long, dist double"), k)
    return merged(_grid(base, queries, k, skip_self, size.n, cell_rows), k)


def cells_of(n: int, cell_rows: int) -> int:
    """Cells that n rows are dealt to: a row is sent to every cell of the other table, so cells grow with the tables as far as a task can hold them."""
    return max(1, math.ceil(n / max(cell_rows, min(GRID_ROWS, -(-n // GRID)))))


def _grid(base, queries, k, skip_self, n_queries, cell_rows) -> DataFrame:
    cells, q_cells = cells_of(base.count(), cell_rows), cells_of(n_queries, cell_rows)
    left = base.withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(cells))).withColumn("q_cell", F.explode(F.sequence(F.lit(0), F.lit(q_cells - 1))))
    right = queries.withColumn("q_cell", F.pmod(F.xxhash64("query_id"), F.lit(q_cells)).cast("int")).withColumn("cell", F.explode(F.expr(f"sequence(0L, {cells - 1}L)")))

    def pair(b: pa.Table, q: pa.Table) -> pa.Table:
        if not b.num_rows or not q.num_rows:
            return _PART.empty_table()
        parts = local_top(q["query_id"].to_numpy(), matrix(q["embedding"]), b["vec_id"].to_numpy(), matrix(b["embedding"]), k, skip_self)
        return pa.Table.from_batches([_batch(parts)])

    return left.groupBy("cell", "q_cell").cogroup(right.groupBy("cell", "q_cell")).applyInArrow(pair, "query_id long, vec_id long, dist double")


def knn_graph(vectors: DataFrame, degree: int, **how) -> DataFrame:
    """Edges to the `degree` nearest others, slots in order of distance; at most n - 1 of them."""
    found = knn(vectors, vectors.withColumnRenamed("vec_id", "query_id"), degree, skip_self=True, **how)
    return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist", (F.col("rank") - 1).cast("int").alias("slot"))


def with_distances(pairs: DataFrame, vectors: DataFrame, a: str = "src", b: str = "dst", name: str = "dist") -> DataFrame:
    """pairs with the squared distance of the rows they name; both vectors come by joins on the id."""
    left = vectors.select(F.col("vec_id").alias("_a"), F.col("embedding").alias("_va"))
    right = vectors.select(F.col("vec_id").alias("_b"), F.col("embedding").alias("_vb"))
    joined = pairs.join(left, pairs[a] == F.col("_a")).join(right, pairs[b] == F.col("_b")).select(*pairs.columns, "_va", "_vb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = exact_distances(matrix(batch.column("_va")), matrix(batch.column("_vb")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(d)], names=[*batch.schema.names[:-2], name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return joined.mapInArrow(run, f"{fields}, `{name}` double")


def gather(vectors: DataFrame, subset: DataFrame) -> DataFrame:
    """The rows whose ids are in subset (vec_id)."""
    return vectors.join(subset.select("vec_id"), "vec_id", "left_semi")
