"""Subsets of a graph's nodes: random, hubs, and flooding in rounds.

The first `size` rows of an order are found by selection, not by a sort: rows have a text key of fixed order, its prefixes are counted, the one prefix in which row
`size` lies is looked into further, and all rows up to the key found are kept by a filter. No task holds or merges `size` rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import shuffled
from ..storage import staged
from .graphs import reach


def default_size(n: int, size: int | None) -> int:
    return n // 2 if size is None or size >= n else size


#: Characters by which a prefix grows in a round of selection, and keys that are put in order at the end.
STRIDE, EXACT = 3, 4096


def as_key(number: str | Column) -> Column:
    """A long as text that sorts as the number does."""
    n = F.col(number) if isinstance(number, str) else number
    return F.lpad((n.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")


def nth_key(keys: DataFrame, n: int, exact: int = EXACT) -> str | None:
    """The n-th smallest (from 1) of distinct keys (k); the last if there are fewer, None if there are none."""
    prefix = ""
    while True:
        span = keys.agg(F.count(F.lit(1)).alias("count"), F.min("k").alias("first"), F.max("k").alias("last")).head()
        if not span["count"] or n < 1:
            return None
        if n >= span["count"]:
            return span["last"]
        if span["count"] <= exact:
            return keys.orderBy("k").limit(n).agg(F.max("k")).head()[0]
        width = max(len(os.path.commonprefix([span["first"], span["last"]])), len(prefix)) + STRIDE
        # at most as many prefixes as STRIDE characters of the key's alphabet have
        for prefix, count in sorted(map(tuple, keys.groupBy(F.substring("k", 1, width)).count().collect())):  # noqa: B020
            if n <= count:
                break
            n -= count
        keys = keys.where(F.col("k").startswith(prefix))


def first_rows(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the smallest keys, which must differ."""
    keyed = staged(rows.withColumn("k", key), "keyed")
    last = nth_key(keyed.select("k"), n)
    return keyed.where(F.lit(False) if last is None else F.col("k") <= last).drop("k")


def random_subset(nodes: DataFrame, size: int | None = None, seed: str = "subset", ensure_zero: bool = True) -> DataFrame:
    """`size` nodes (vec_id) in order of their hash; node 0 takes the first place if it is not among them."""
    size = default_size(nodes.count(), size)
    key = F.concat(shuffled(seed, "vec_id"), as_key("vec_id"))
    return first_rows(nodes.select("vec_id"), F.when(F.col("vec_id") == 0, F.lit("")).otherwise(key) if ensure_zero else key, size)


def hub_nodes(nodes: DataFrame, edges: DataFrame, size: int | None = None, percent: float = 0.0, seed: str = "hubs", ensure_zero: bool = True, legacy_order: bool = False) -> DataFrame:
    """Nodes of highest out-degree, with `percent` of them drawn from the other end; legacy_order takes the lowest first."""
    n = nodes.count()
    size = default_size(n, size)
    other = int(size * min(max(percent if percent <= 100 else 0.0, 0.0), 100.0) / 100)
    degree = nodes.join(edges.groupBy(F.col("src").alias("vec_id")).count(), "vec_id", "left").select("vec_id", F.coalesce("count", F.lit(0)).alias("degree"))
    degree = staged(degree, "degrees")
    front = F.col("degree") if legacy_order else -F.col("degree")
    key = F.concat(as_key(front), as_key("vec_id"))
    head = first_rows(degree, F.when(F.col("vec_id") == 0, F.lit("")).otherwise(key) if ensure_zero else key, size - other)
    tail = first_rows(degree.join(head, "vec_id", "left_anti"), F.concat(as_key(-front), as_key("vec_id")), other)
    return head.unionByName(tail).select("vec_id")


def flooding(nodes: DataFrame, edges: DataFrame, r: int = 1, size: int | None = None, seed: str = "flood", ensure_zero: bool = True) -> DataFrame:
    """Nodes in random order; each one not yet flooded is selected and floods what it reaches in r hops.

    The sequential scan equals this in rounds: a node is out once a selected earlier node reaches it, and selected once all earlier
    nodes that reach it are out. Few rounds are needed for a random order. Node 0 counts as flooded from the start and is
    appended (without flooding). `size` cuts in order of selection.
    """
    order = nodes.select("vec_id", shuffled(seed, "vec_id").alias("k")).where(F.col("vec_id") != 0 if ensure_zero else F.lit(True))
    reached = reach(edges, order, r).where("start != node")
    o = order.select(F.col("vec_id").alias("start"), F.col("k").alias("k_start"))
    p = order.select(F.col("vec_id").alias("node"), F.col("k").alias("k_node"))
    earlier = staged(reached.join(o, "start").join(p, "node").where("k_start < k_node").select("start", "node"), "flood-edges")
    state = staged(order.select("vec_id", F.lit(None).cast("boolean").alias("chosen")), "flood-state")
    while not state.where("chosen is null").isEmpty():
        s = state.select(F.col("vec_id").alias("start"), F.col("chosen").alias("s_chosen"))
        said = earlier.join(s, "start").groupBy("node").agg(F.max(F.coalesce("s_chosen", F.lit(False))).alias("hit"), F.max(F.col("s_chosen").isNull()).alias("open"))
        joined = state.join(said, state.vec_id == said.node, "left")
        now = F.when(F.col("chosen").isNotNull(), F.col("chosen")).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = staged(joined.select("vec_id", now.alias("chosen")), "flood-state")
    chosen = state.where("chosen").join(order, "vec_id")
    if size is not None:
        chosen = first_rows(chosen.select("vec_id"), F.concat(shuffled(seed, "vec_id"), as_key("vec_id")), max(size - (1 if ensure_zero else 0), 0))
    chosen = chosen.select("vec_id")
    return chosen.unionByName(nodes.where("vec_id = 0").select("vec_id")) if ensure_zero else chosen


def flooding_repeat(nodes: DataFrame, edges: DataFrame, r: int = 1, size: int | None = None, seed: str = "flood") -> DataFrame:
    """Floods again over what is left until `size` nodes (1 if none is given, at most all) are selected; node 0 is among them."""
    size = min(size or 1, nodes.count())
    picked = staged(flooding(nodes, edges, r, size, seed), "flood-picked")
    while (have := picked.count()) < size:
        left = nodes.join(picked, "vec_id", "left_anti")
        inner = edges.join(left.select(F.col("vec_id").alias("src")), "src", "left_semi").join(left.select(F.col("vec_id").alias("dst")), "dst", "left_semi")
        more = flooding(left, inner, r, size - have, seed, ensure_zero=False)
        picked = staged(picked.unionByName(more), "flood-picked")
    return picked


def numbered(subset: DataFrame) -> DataFrame:
    """(local_id, global_id): the subset's rows numbered from 0 in order of vec_id.

    Each range of ids is numbered in its own task; the driver adds up a count for each range.
    """
    ranges = subset.select("vec_id").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    placed = staged(ranges.withColumn("at", F.monotonically_increasing_id()), "places").select("vec_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("inside"))
    counts, starts, start = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect()), [], 0
    for part, n in counts:
        starts.append((part, start))
        start += n
    of_part = subset.sparkSession.createDataFrame(starts, "part long, start long")  # a row for each range
    return placed.join(F.broadcast(of_part), "part").select((F.col("start") + F.col("inside")).alias("local_id"), F.col("vec_id").alias("global_id"))
