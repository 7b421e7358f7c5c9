"""Connected components by hooking and pointer jumping.

In each round every node points to the smallest of itself and its neighbours. Pointers are then followed to
their ends by doubling (a node takes its pointer's pointer until none changes), so a chain of n edges takes
log2(n) steps and not n. Edges are redrawn between those ends, and each round leaves at most half of the nodes. The
smallest node of a component always points to itself, so when no edge is left it names the component. Each
step is written to the shared folder, so the lineage stays short.

Defined results: an edge of a node to itself, repeated edges and edges both ways change nothing; null ends are
left out; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _ends(points: DataFrame) -> DataFrame:
    """(node, p) with each pointer followed to its end."""
    while True:
        # ends point to themselves: only what still moves is looked up, so a large component's end is no hot key
        moves = points.where("node != p").select(F.col("node").alias("at"), F.col("p").alias("next"))
        further = points.join(moves, points.p == moves.at, "left").select("node", F.coalesce("next", "p").alias("p"), F.col("next").isNotNull().alias("moved"))
        points = staged(further, "points")
        if points.where("moved").isEmpty():
            return points.select("node", "p")
        points = points.select("node", "p")


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, component) for every node with an edge to another; component: its smallest node."""
    edges = staged(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points = _ends(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p")))
        p = points.select(F.col("node").alias("at"), F.col("p").alias("to"))
        if labels is None:
            labels = points.select("node", F.col("p").alias("component"))
        else:
            labels = staged(labels.join(p, labels.component == p["at"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        first = edges.join(p, edges.u == p["at"]).select(F.col("to").alias("pu"), "v")
        redrawn = first.join(p, first.v == p["at"]).select("pu", F.col("to").alias("pv")).where("pu != pv")
        edges = staged(redrawn.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    return labels
