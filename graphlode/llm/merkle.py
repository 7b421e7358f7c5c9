"""A Merkle tree over a dataset, in a node store on disk, with proofs read from the store.

Every row is a leaf. The rows of a group (its `tree`) form a binary tree in order of their key; the groups' roots, in order of their names,
form one more, whose root stands for the dataset. A node is the SHA-256, in lowercase hex, of its children's digests in hex; a last node without a
partner is hashed alone while its level has more than one.

* Leaves are sorted by range into runs and numbered: coordinates are (tree, level, idx), idx from 0.
* The store is built a block at a time: nodes whose idx agree but for the last `STEP` bits are a block, and a pass reads the level where the last one
  ended, in order, and writes the STEP levels above it as Parquet partitioned by level. No task holds more than a block, and n leaves take log2(n) / STEP passes. A hot group is many blocks.
* Proofs come from the top down: each block gets the path above it, and a merge of its nodes, leaves and path by coordinate gives every leaf its siblings.

A path is written as text: entries from below, joined by a comma, 'L' or 'R' and the sibling on that side, or '-' for a node that is hashed alone.

Defined results: a null column is '-' in its leaf; null groups come first; null keys come first in their group; rows that repeat a key are in order of
their leaf; equal leaves share the order that they are read in, which changes no digest; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_batches
from .common import shared_dir, staged

#: Levels that a pass builds; a block has 2^STEP nodes at most.
STEP = 10
#: The one tree over the groups' roots.
TOP = ""
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string())])
_PATH = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.string())])


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """SHA-256 of the columns, each '-' if null, else its length in bytes, a colon and its value."""

    def part(c: Column) -> Column:
        v = c.cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))

    return F.sha2(F.concat(*map(part, columns)), 256)


def levels_of(hashes: list[str], alone: bool, step: int) -> list[list[str]]:
    """The levels of a block from the given one: `step` more, or up to a single node if the block is the whole level."""
    levels = [hashes]
    while len(levels) <= step and not (alone and len(levels[-1]) == 1):
        h = levels[-1]
        levels.append([digest("".join(h[i : i + 2])) for i in range(0, len(h), 2)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """Path entries of node i of the lowest level up to the block's end."""
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append("-" if j >= len(nodes) else ("L" if i & 1 else "R") + nodes[j])
        i >>= 1
    return out


def proof_of(path: str) -> str:
    """SHA-256 of the siblings of a path."""
    return digest("".join(e[1:] for e in path.split(",")))


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for e in path.split(",") if path else ():
        leaf = digest(leaf if e == "-" else e[1:] + leaf if e[0] == "L" else leaf + e[1:])
    return leaf


def _joined(*paths: str) -> str:
    return ",".join(p for p in paths if p)


def numbered_runs(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with idx (from 0) and n (rows) of their tree, sorted by (tree, *by) in runs by range."""
    # equal rows may be a third of all: their place in the input lets ranges cut between them
    placed = staged(rows.withColumn("place", F.monotonically_increasing_id()), f"{name}-rows")
    order = ["tree", *by, "place"]
    runs = staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), f"{name}-runs")
    runs = runs.withColumn("run", F.shiftright("at", 33))
    counts = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))  # a row for each run of a tree
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "run", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return staged(runs.join(starts, ["tree", "run"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "place", "run", "shift"), name)


@dataclass(frozen=True)
class Forest:
    """Trees in the store: leaves (tree, idx, n, hash, ...) and nodes (tree, level, idx, hash) from level 1."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame  # tree, hash
    step: int


def build(leaves: DataFrame, path: str, step: int = STEP) -> Forest:
    """Builds the trees of leaves (tree, idx, n, hash) into the store at `path`."""
    spark = leaves.sparkSession

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, block, level, count = (table[c][0].as_py() for c in ("tree", "block", "level", "count"))
        rows = [(tree, level + j, (block << step - j) + i, h) for j, nodes in enumerate(levels_of(table["hash"].to_pylist(), count <= 1 << step, step)) if j for i, h in enumerate(nodes)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODE.types, strict=True)], schema=_NODE) if rows else _NODE.empty_table()

    def count_at(level: int) -> Column:
        return F.shiftright(F.col("n") + F.lit((1 << level) - 1), level)

    level, at = 0, leaves.select("tree", "idx", "n", "hash")
    most = leaves.agg(F.max("n")).head()[0] or 0
    sizes = leaves.where("idx = 0").select("tree", "n")
    nodes = spark.createDataFrame([], "tree string, idx long, hash string, level int")
    found = None
    while level == 0 or -(-most >> level) > 1:
        blocks = at.select("tree", "idx", "hash", F.shiftright("idx", step).alias("block"), F.lit(level).alias("level"), count_at(level).cast("long").alias("count"))
        built = blocks.groupBy("tree", "block").applyInArrow(run, "tree string, level int, idx long, hash string")
        built.write.mode("append").partitionBy("level").parquet(path)
        level += step
        found = spark.read.schema("tree string, idx long, hash string, level int").parquet(path)
        at = found.where(F.col("level") == level).join(sizes, "tree").where(count_at(level) > 1)
    nodes = found if found is not None else nodes
    # a tree's root is its only node of the level where its count comes to one
    height = F.ceil(F.log2(F.col("n").cast("double"))).cast("int")
    above = sizes.withColumn("level", height).join(nodes, ["tree", "level"]).where("idx = 0").select("tree", "hash")
    roots = staged(above.unionByName(leaves.where("n = 1").select("tree", "hash")), "roots")
    return Forest(leaves, nodes.select("tree", "level", "idx", "hash"), roots, step)


def _prover(run):
    """Merges the nodes of a block, sorted by coordinate, with the rows of its lowest level: their paths, or what run(rows, paths) makes of these."""

    def prove(rows: pa.Table, store: pa.Table) -> pa.Table:
        if not rows.num_rows or not store.num_rows:
            return run(rows.slice(0, 0), []) if run else _PATH.empty_table()
        rows, store = rows.sort_by("idx"), store.sort_by([("level", "ascending"), ("idx", "ascending")])
        nodes: list[list[str]] = [rows["hash"].to_pylist()]
        for level, h in zip(store["level"].to_pylist()[1:], store["hash"].to_pylist()[1:], strict=True):
            if level == len(nodes):
                nodes.append([])
            nodes[level].append(h)
        high = store["path"][0].as_py()  # the block's mark comes first
        found = [_joined(*siblings(nodes, i), high) for i in range(rows.num_rows)]
        return run(rows, found) if run else pa.table([rows["tree"], rows["idx"], pa.array(found, pa.string())], schema=_PATH)

    return prove


def paths(forest: Forest, above: DataFrame, give: tuple[str, ...] = (), run=None, ddl: str | None = None) -> DataFrame:
    """For every leaf the path to the root of its tree and on by above (tree, path): tree, idx, path; or what run(rows, paths) makes of a block's leaves."""
    step, spark = forest.step, above.sparkSession
    sizes = forest.leaves.where("idx = 0").select("tree", "n")
    most = forest.leaves.agg(F.max("n")).head()[0] or 0
    levels = [0]
    while -(-most >> levels[-1]) > 1 << step:
        levels.append(levels[-1] + step)
    over = None  # paths of the blocks of the level below
    for level in reversed(levels):
        top = sizes.where((F.col("n") > (1 << level if level else 0)) & (F.col("n") <= 1 << level + step))  # trees that end in this block
        known = top.join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path")
        if over is not None:
            known = known.unionByName(over.select("tree", F.col("idx").alias("block"), "path"))
        if level:
            lowest = forest.nodes.where(F.col("level") == level).select("tree", "idx", "hash")
        else:
            lowest = forest.leaves.select("tree", "idx", "hash", *give)
        lowest = lowest.withColumn("block", F.shiftright("idx", step))
        inner = forest.nodes.where((F.col("level") > level) & (F.col("level") <= level + step)).select(
            F.col("tree").alias("tree"), F.expr(f"shiftright(idx, {step} - (level - {level}))").alias("block"), (F.col("level") - level).alias("level"), F.col("idx").alias("idx"), F.col("hash").alias("hash"), F.lit(None).cast("string").alias("path")
        )
        marks = known.select("tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("hash"), "path")

        out = ddl if not level and run else "tree string, idx long, path string"
        over = lowest.groupBy("tree", "block").cogroup(inner.unionByName(marks).groupBy("tree", "block")).applyInArrow(_prover(None if level else run), out)
        if level:
            over = staged(over, "paths")
    return over if over is not None else spark.createDataFrame([], "tree string, idx long, path string")


@dataclass(frozen=True)
class Manifest:
    """A dataset's trees: `forest` over its rows by group, `top` over the groups, `above`: tree, subroot, root, path (from the group's root up)."""

    forest: Forest
    top: Forest
    above: DataFrame


def manifest(rows: DataFrame, by: list[str], path: str | None = None, step: int = STEP) -> Manifest:
    """rows: tree (null for none), hash (of the leaf) and what else is carried. Leaves are in order of (*by, hash) in their tree."""
    spark = rows.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark, "merkle-nodes")
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("1"), F.col("tree")), F.lit("0")))
    forest = build(numbered_runs(keyed, [*by, "hash"], "merkle-leaves"), f"{path}/rows", step)
    heads = numbered_runs(forest.roots.select(F.lit(TOP).alias("tree"), "hash", F.col("tree").alias("group")), ["group"], "merkle-heads")
    top = build(heads, f"{path}/groups", step)
    root = top.roots.select(F.col("tree").alias("top"), F.col("hash").alias("root"))
    up = paths(top, spark.createDataFrame([(TOP, "")], "tree string, path string"))
    up = up.join(heads.select("idx", F.col("group"), F.col("hash").alias("subroot"), F.lit(TOP).alias("top")), "idx").join(root, "top")
    return Manifest(forest, top, staged(up.select(F.col("group").alias("tree"), "subroot", "root", "path"), "merkle-groups"))


_AUDIT = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]


def audit(m: Manifest, id_col: str, claim_col: str) -> DataFrame:
    """Every leaf with its proof, checked: claim_col of the leaves holds the digest that a holder of the row comes to; verified says whether it leads to the root.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    # the roots travel with the path, at its end
    above = m.above.select("tree", F.concat_ws("|", "path", "subroot", "root").alias("path"))

    def check(rows: pa.Table, found: list[str]) -> pa.Table:
        out = []
        for doc_id, leaf, claim, text in zip(rows[id_col].to_pylist(), rows["hash"].to_pylist(), rows[claim_col].to_pylist(), found, strict=True):
            path, subroot, root = text.split("|")
            path = path.rstrip(",")
            folded = fold(claim, path)
            out.append((doc_id, leaf, subroot, root, proof_of(path), folded, folded == root))
        return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [()] * len(_AUDIT), _AUDIT, strict=True)], schema=pa.schema(_AUDIT))

    return paths(m.forest, above, (id_col, claim_col), check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """tree, doc_id, hash, claim of documents: claim is the leaf with n_chars one higher where modulus divides the CRC-32 of the decimal doc_id."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    tampered = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False))
    claim = F.when(tampered & n_chars.isNotNull(), leaf_of(doc_id, source, lang, n_chars + 1, text))
    return docs.select(lang.cast("string").alias("tree"), doc_id.cast("long").alias("doc_id"), leaf_of(doc_id, source, lang, n_chars, text).alias("hash"), claim.alias("claim")).withColumn("claim", F.coalesce("claim", "hash"))
