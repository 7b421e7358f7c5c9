"""Experiments: build hierarchies or single graphs, search them over all settings, and keep a full result row for each."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LID, RESULT_COLUMNS, BruteforceKNNParams, DEGParams, EfannaParams, HierarchyParams, HNSWParams, NSSGParams, RNGGParams, RNNParams
from ..sources.datasets import Dataset, reduced_truth
from ..storage import staged
from . import selectors
from .cells import cell_graph, degree_of
from .evaluate import Scans, evaluate, level_wise
from .hierarchy import build_hierarchy, to_index
from .knn import knn_graph
from .nndescent import nn_descent
from .nssg import connect, connect_both_ways, nssg_graph
from .graphs import rng_graph
from .results import max_heap_sizes, write_results
from .rnn import rnn_graph
from .selectors import numbered
from .sharded import UNREAD, index_from_edges

#: Parameters that suit the known data sets, by builder. DEG: dimensionality, edges, heap.
DEG = {
    "audio": ("low", 30, 40), "enron": ("high", 30, 60), "deep1m": ("high", 50, 70), "glove-100": ("high", 30, 30), "sift": ("low", 30, 60), "normaldata": ("high", 40, 60),
    "300k": ("high", 35, 60), "3m": ("high", 35, 60), "10m": ("high", 40, 70), "100m": ("high", 40, 70),
}
#: K, l, iter, s, r.
EFANNA = {
    "audio": (80, 120, 8, 30, 100), "enron": (130, 150, 6, 20, 300), "deep1m": (140, 200, 4, 15, 100), "glove-100": (400, 420, 12, 15, 200), "sift": (80, 140, 12, 10, 100),
    "normaldata": (150, 150, 3, 10, 100), "300k": (100, 150, 3, 10, 100), "3m": (150, 150, 3, 10, 100), "10m": (100, 150, 3, 10, 100), "100m": (100, 180, 4, 12, 100),
}
#: Largest degree above and at the bottom, heap.
HNSW = {
    "audio": (20, 40, 60), "enron": (50, 80, 200), "deep1m": (40, 55, 200), "glove-100": (60, 80, 300), "sift": (35, 45, 200), "normaldata": (30, 50, 100),
    "300k": (30, 45, 100), "3m": (30, 55, 100), "10m": (30, 60, 200), "100m": (50, 80, 400),
}
#: Range, l, and k, l, iter, s, r of the start graph.
NSSG = {
    "audio": (30, 150, (80, 120, 8, 30, 100)), "enron": (50, 300, (130, 150, 6, 20, 300)), "deep1m": (60, 350, (140, 200, 4, 15, 100)), "glove-100": (50, 500, (400, 420, 12, 15, 200)),
    "sift": (50, 100, (80, 140, 12, 10, 100)), "normaldata": (50, 250, (150, 150, 3, 10, 100)), "300k": (50, 250, (150, 150, 3, 10, 100)), "3m": (60, 400, (150, 150, 3, 10, 100)),
    "10m": (60, 400, (150, 150, 3, 10, 100)), "100m": (50, 400, (180, 180, 4, 12, 100)),
}
#: Final degree, from 96 at the start in 4 outer and 15 inner loops.
RNN = {"audio": 30, "enron": 30, "deep1m": 40, "glove-100": 50, "sift": 40, "normaldata": 30, "300k": 30, "3m": 40, "10m": 40, "100m": 40}

NAMES = {DEGParams: "DEG", EfannaParams: "EFANNA", NSSGParams: "NSSG", RNNParams: "RNN", HNSWParams: "HNSW", RNGGParams: "RNGG", BruteforceKNNParams: "KNN"}


def preset(builder: str, dataset: str):
    """(parameters, start graph's parameters or None) of a builder for a data set; the defaults where the set is not known."""
    name = dataset.lower().removeprefix("laion-")
    match builder:
        case "DEG":
            return (DEGParams(lid=LID(DEG[name][0]), edges_per_vertex=DEG[name][1], max_build_heap_size=DEG[name][2]) if name in DEG else DEGParams()), None
        case "EFANNA":
            return (EfannaParams(*EFANNA[name]) if name in EFANNA else EfannaParams()), None
        case "HNSW":
            return (HNSWParams(higher_max_degree=HNSW[name][0], lowest_max_degree=HNSW[name][1], max_build_heap_size=HNSW[name][2]) if name in HNSW else HNSWParams()), None
        case "NSSG":
            return (NSSGParams(range=NSSG[name][0], l=NSSG[name][1]), EfannaParams(*NSSG[name][2])) if name in NSSG else (NSSGParams(), None)
        case "RNN":
            return (RNNParams(initial_degree=96, reduce_degree=RNN[name], n_outer_loops=4, n_inner_loops=15) if name in RNN else RNNParams()), None
        case "RNGG":
            return RNGGParams(), None
        case "KNN":
            return BruteforceKNNParams(), None
    raise ValueError(f"unknown builder {builder}")


@dataclass(frozen=True)
class Select:
    """A selector by name: random, hubs (value: per cent from the other end) or flooding (value: hops), flooding again until the size is reached with `repeat`."""

    kind: str = "random"
    value: int = 1
    repeat: bool = False

    def __call__(self, nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
        match self.kind:
            case "random":
                return selectors.random_subset(nodes, size)
            case "hubs":
                return selectors.hub_nodes(nodes, edges, size, self.value)
            case "flooding":
                return (selectors.flooding_repeat if self.repeat else selectors.flooding)(nodes, edges, self.value, size)
        raise ValueError(f"unknown selector {self.kind}")

    def describe(self) -> str:
        return f"{self.kind}={self.value}" + ("|repeat" if self.repeat else "")


#: Rows of a cell of point-by-point builders.
CELL_ROWS = 100_000


def table_graph(vectors: DataFrame, params, start=None) -> DataFrame:
    """src, dst, slot: the graph of a builder that has a form on tables. Rows may have any ids: random ends are drawn among their numbers in order of vec_id."""
    for name in UNREAD.get(type(params), ()):
        if getattr(params, name) != getattr(type(params)(), name):
            raise ValueError(f"{type(params).__name__}.{name} is not implemented")
    if isinstance(params, BruteforceKNNParams):
        return knn_graph(vectors, params.degree)
    numbers = staged(numbered(vectors.select("vec_id")), "graph-numbers")
    rows = staged(vectors.join(numbers, vectors.vec_id == numbers.global_id).select(F.col("local_id").alias("vec_id"), "embedding"), "graph-rows")
    match params:
        case RNNParams():
            edges = rnn_graph(rows, params)
        case RNGGParams():
            edges = rng_graph(rows, params)
        case EfannaParams():
            edges = nn_descent(rows, params)
        case NSSGParams():
            edges = nssg_graph(rows, params, start)[0].edges
        case _:
            raise ValueError(f"no graph on tables for {params}")
    named = lambda a, b: numbers.select(F.col("local_id").alias(a), F.col("global_id").alias(b))
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "slot").join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst", "slot")


@dataclass(frozen=True)
class Level:
    """How a level is built (parameters of a builder) and how the nodes of the one above are chosen."""

    params: object
    selector: Select = field(default_factory=Select)
    start: object = None
    cell_rows: int | None = None

    def builder(self) -> Callable[[DataFrame], DataFrame]:
        """vectors -> edges (src, dst, slot), by one way at any number of rows: on tables, and of point-by-point builders, which have no such form, or where cell_rows is given, by overlapping cells."""

        def build(vectors: DataFrame) -> DataFrame:
            if self.cell_rows or isinstance(self.params, DEGParams | HNSWParams):
                return cell_graph(vectors, self.params, self.cell_rows or CELL_ROWS, start=self.start).edges.select("src", "dst", "slot")
            return table_graph(vectors, self.params, self.start).select("src", "dst", "slot")

        return build

    def describe(self) -> str:
        return f"{NAMES[type(self.params)]}({self.params.describe()})|{self.selector.describe()}"


def describe_levels(levels: list[Level]) -> str:
    """The levels from the bottom, joined as stored in result rows; the last one serves all above it."""
    return "|".join(f"level{i}={x.describe()}" for i, x in enumerate(levels))


def index_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about an index (nodes: level, vec_id; edges: level, src, dst): sizes, degrees, repeated and faulty edges, levels from the bottom."""
    degree = edges.groupBy("level", F.col("src").alias("vec_id")).agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("dst").alias("ends"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("loop"))
    per = nodes.select("level", "vec_id").join(degree, ["level", "vec_id"], "left").na.fill(0, ["degree", "ends", "loop"])
    levels = per.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("degree").alias("e"), F.avg("degree").alias("avg"), F.min("degree").alias("lo"), F.max("degree").alias("hi"), F.sum(F.col("degree") - F.col("ends")).alias("twice"), F.max("loop").alias("loop")
    )
    by_level = F.array_sort(F.collect_list(F.struct("level", "n", "e", "avg", "lo", "hi")))
    return levels.agg(
        F.transform(by_level, lambda x: x["n"]).alias("n_vertices"), F.sum("e").alias("n_edges"), F.sum("twice").alias("n_duplicates"), (F.max("loop") > 0).alias("has_loops"),
        F.transform(by_level, lambda x: x["avg"]).alias("avg_out_degrees"), F.transform(by_level, lambda x: F.struct(x["lo"].alias("min"), x["hi"].alias("max"))).alias("min_max_out_degrees"), F.avg("avg").alias("total_avg_out_degree"),
    )


def _as_text(report) -> tuple[str, str, str, str, str]:
    """The report's columns as result rows store them."""
    pairs = [(x["min"], x["max"]) for x in report.min_max_out_degrees]
    return str(report.n_vertices), str(report.n_edges), str(report.total_avg_out_degree), str(report.avg_out_degrees), str(pairs)


@dataclass(frozen=True)
class Experiment:
    """What is built and how it is searched. levels: from the bottom; with `flat` a single graph by the first level's builder."""

    name: str
    levels: list[Level]
    hierarchy: HierarchyParams = field(default_factory=HierarchyParams)
    sizes: list[int] | None = None
    flat: bool = False
    ks: tuple[int, ...] = (10,)
    ef_higher: tuple[int, ...] = (1,)
    heap_sizes: list[int] | None = None
    iters: int = 1


def run_one(data: Dataset, dataset: str, e: Experiment) -> list[tuple]:
    """A row of RESULT_COLUMNS for each k (from the largest), heap sizes and, in hierarchies, top level.

    The bottom is connected, in both directions under levels, so that a search can go on to all rows wherever it begins.
    """
    vectors = data.vectors.select("vec_id", "embedding")
    n, nq, dim = vectors.count(), data.queries.count(), vectors.select(F.size("embedding")).head()[0]
    began, most = time.time(), degree_of(e.levels[0].params) + 2
    least = vectors.agg(F.min("vec_id")).head()[0]
    build, scans = e.levels[0].builder(), Scans()
    if e.flat:
        index, built = index_from_edges(vectors, connect(build(vectors), vectors, least, most).edges), None
        nodes, edges = vectors.select(F.lit(0).alias("level"), "vec_id"), index.levels[0].edges.withColumn("level", F.lit(0))
        params = e.levels[0].params.describe()
    else:
        bottom = lambda rows: connect_both_ways(build(rows), rows, least, most).edges  # noqa: E731  # entered anywhere
        built = build_hierarchy(vectors, [bottom, *(x.builder() for x in e.levels[1:] or e.levels)], [x.selector for x in e.levels], e.hierarchy, e.sizes)
        index, nodes, edges = to_index(built, vectors), built.nodes.select("level", F.col("global_id").alias("vec_id")), built.edges
        params = f"{e.hierarchy.describe()}|{describe_levels(e.levels)}"
    took = time.time() - began
    about, rows = _as_text(index_report(nodes, edges).head()), []
    for k in sorted(e.ks, reverse=True):
        truth = reduced_truth(data.truth, k)
        for eh in e.ef_higher:
            for ef in max_heap_sizes(k, e.heap_sizes):
                if built:
                    found = level_wise(built, vectors, data.queries, truth, k, ef, eh, index=index, scans=scans).collect()  # a row for each level
                else:
                    found = [evaluate(index, data.queries, truth, k, ef, 1, scans, ef_higher=eh)]
                for layers, _, _, _, query_time, qps, recall in found:
                    rows.append((recall, qps, e.name, dataset, took, n, nq, dim, k, ef, layers, query_time, *about, params, eh))
    return rows


def run_experiments(spark: SparkSession, data: Dataset, dataset: str, experiments: list[Experiment], path: str | None = None, strict: bool = False) -> DataFrame:
    """The rows of all experiments with `seq`, their order. One that fails is logged and leaves the others' rows; path: where each one's rows and configuration are kept.

    strict: if any failed, an error tells so once the others are done, so that what is returned is whole.
    """
    rows: list[tuple] = []
    failed: list[Exception] = []
    schema = f"seq long, {RESULT_COLUMNS}"
    for e in experiments:
        for _ in range(e.iters):
            try:
                own = [(len(rows) + i, *r) for i, r in enumerate(run_one(data, dataset, e))]
            except Exception as error:
                logging.getLogger(__name__).exception("%s failed", e.name)
                failed.append(error)
                continue
            rows += own
            if path:
                write_results(spark.createDataFrame(own, schema).drop("seq"), path, f"name={e.name}\ndataset={dataset}\nk={e.ks}\nheap_sizes={e.heap_sizes}\n{describe_levels(e.levels)}")
    if strict and failed:
        raise ExceptionGroup("experiments without rows", failed)
    return staged(spark.createDataFrame(rows, schema), "experiments")
