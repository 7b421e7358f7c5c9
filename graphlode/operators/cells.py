"""One connected graph over more rows than a task holds, by any builder: overlapping cells.

Sampled pivots stand for cells, and each row goes to the cells of its `copies` nearest pivots, so neighbouring cells share rows. A cell builds its graph in one task (one that came
out too large is dealt into parts by a hash of the id). The edges of all cells are united, each node's are pruned to the builder's own degree, and what
the first node does not lead to is linked. The result is one graph for one search: nothing depends on where cells end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import exact_distances
from ..functions.seeded import shuffled
from ..model import BruteforceKNNParams, DEGParams, EfannaParams, HNSWParams, NSSGParams, RNGGParams, RNNParams
from ..storage import staged
from .graphs import angle_prune
from .knn import knn, matrix
from .nssg import Connected, connect
from .sharded import local_builder

_FOUND = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())])


def degree_of(params) -> int:
    """The most edges that a builder leaves a node."""
    match params:
        case DEGParams():
            return params.edges_per_vertex + params.edges_per_vertex % 2
        case EfannaParams():
            return params.k
        case NSSGParams():
            return params.range
        case RNGGParams() | BruteforceKNNParams():
            return params.degree
        case RNNParams():
            return params.reduce_degree
        case HNSWParams():
            return params.lowest_max_degree
    raise ValueError(f"no builder for {params}")


def nearest_cells(vectors: DataFrame, pivots: int, copies: int, seed: str = "cells") -> DataFrame:
    """cell (the pivot's vec_id), rank, vec_id: each row's `copies` nearest pivots, which are the first rows of an order by hash."""
    chosen = staged(vectors.orderBy(shuffled(seed, "vec_id"), "vec_id").limit(pivots).select("vec_id", "embedding"), "pivots")
    found = knn(chosen, vectors.withColumnRenamed("vec_id", "query_id"), copies)
    return found.select(F.col("vec_id").alias("cell"), "rank", F.col("query_id").alias("vec_id"))


def cell_edges(vectors: DataFrame, params, cell_rows: int, copies: int = 2, start=None, seed: int = 0) -> DataFrame:
    """src, dst, dist: the distinct edges of all cells' graphs."""
    n = vectors.count()
    cells = staged(nearest_cells(vectors, max(1, math.ceil(2 * n * copies / cell_rows)), copies), "cells")
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).alias("parts"))  # a row for each pivot
    dealt = cells.join(parts, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id")
    build = local_builder(params, start, seed)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        x, ids = matrix(table["embedding"]), table["vec_id"].to_numpy()
        adjacency = build(x)[0][0][1]
        src = np.repeat(np.arange(len(ids)), [len(a) for a in adjacency])
        dst = np.fromiter((j for a in adjacency for j in a), np.int64, len(src))
        return pa.table([pa.array(ids[src]), pa.array(ids[dst]), pa.array(exact_distances(x[src], x[dst]))], schema=_FOUND)

    found = dealt.join(vectors.select("vec_id", "embedding"), "vec_id").groupBy("cell", "part").applyInArrow(run, "src long, dst long, dist double")
    return staged(found.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist")), "cell-edges")


def cut(edges: DataFrame, vectors: DataFrame, most: int, spread: bool) -> DataFrame:
    """src, dst, dist, slot: `most` edges a node, nearest first; with spread those that no nearer one hides under 60 degrees come before all others."""
    if spread:
        shown = angle_prune(edges, vectors, 60.0, most).select("src", "dst", F.lit(0).alias("hidden"))
        edges = edges.join(shown, ["src", "dst"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(1)))
    else:
        edges = edges.withColumn("hidden", F.lit(0))
    slot = F.row_number().over(Window.partitionBy("src").orderBy("hidden", "dist", "dst")) - 1
    return edges.withColumn("slot", slot.cast("int")).where(F.col("slot") < most).select("src", "dst", "dist", "slot")


def cell_graph(vectors: DataFrame, params, cell_rows: int = 1_000_000, copies: int = 2, start=None, seed: int = 0) -> Connected:
    """One graph over all rows, all of which the row with the least id leads to."""
    most = degree_of(params)
    spread = not isinstance(params, BruteforceKNNParams | EfannaParams)
    edges = staged(cut(cell_edges(vectors, params, cell_rows, copies, start, seed), vectors, most, spread), "cut-edges")
    return connect(edges, vectors, vectors.agg(F.min("vec_id")).head()[0], most)
