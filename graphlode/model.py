"""Schemas of the tables that operators exchange, and builder parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import Enum

VECTORS = "vec_id long, embedding array<float>"
QUERIES = "query_id long, embedding array<float>"
EDGES = "src long, dst long, dist double, slot int"
LEVEL_NODES = "level int, local_id long, parent_local_id long, global_id long"
KNN_RESULT = "query_id long, rank int, vec_id long, dist double"
RESULT_COLUMNS = (
    "recall double, qps double, builder_type string, dataset string, elapsed_time double, n_data long, n_queries long, dim int, k int, max_heap_size int, layer_count int, query_time double, "
    "n_vertices string, n_edges string, total_avg_out_degree string, avg_out_degrees string, min_max_out_degrees string, params string, higher_level_max_heap_size int"
)


class KeepEdges(Enum):
    SHORT = "short"
    MIDDLE = "middle"
    LONG = "long"
    SPECIAL = "special"
    NONE = "none"


class LID(Enum):
    UNKNOWN = "unknown"
    HIGH = "high"
    LOW = "low"


class _Params:
    def describe(self) -> str:
        """name=value pairs joined by a bar, as stored in result rows."""
        return "|".join(f"{f.name}={v.value if isinstance(v := getattr(self, f.name), Enum) else v}" for f in fields(self))


@dataclass(frozen=True)
class RNGGParams(_Params):
    degree: int = 30
    degree_short_edges: int = 30
    prune_extend_degree: int = 40
    prune: KeepEdges = KeepEdges.NONE


@dataclass(frozen=True)
class EfannaParams(_Params):
    k: int = 50
    l: int = 50  # noqa: E741
    iter: int = 10
    s: int = 10
    r: int = 100


@dataclass(frozen=True)
class NSSGParams(_Params):
    range: int = 70
    l: int = 250  # noqa: E741
    angle: float = 60.0
    n_try: int = 10
    derive_angle_from_dim: bool = False


@dataclass(frozen=True)
class DEGParams(_Params):
    edges_per_vertex: int = 40
    max_build_heap_size: int = 60
    max_build_frontier_size: int | None = None
    extend_k: int = 0
    extend_eps: float = 0.0
    improve_k: int = 0
    improve_eps: float = 0.0
    lid: LID = LID.HIGH
    swap_tries: int = 0
    additional_swap_tries: int = 0
    use_range_search: bool = False
    max_path_length: int = 0


@dataclass(frozen=True)
class RNNParams(_Params):
    initial_degree: int = 100
    reduce_degree: int = 50
    n_outer_loops: int = 4
    n_inner_loops: int = 15
    concurrent_batch_size: int = 100


@dataclass(frozen=True)
class HNSWParams(_Params):
    higher_max_degree: int = 50
    lowest_max_degree: int = 100
    max_layers: int = 10
    n_parallel_burnin: int = 0
    max_build_heap_size: int = 50
    max_build_frontier_size: int | None = None
    level_norm_param_override: float | None = None
    insert_heuristic: bool = True
    insert_heuristic_extend: bool = True
    post_prune_heuristic: bool = False
    insert_minibatch_size: int = 100
    n_rounds: int = 1
    finetune_rnn: bool = False
    finetune_sen: bool = False


@dataclass(frozen=True)
class BruteforceKNNParams(_Params):
    degree: int = 30
    batch_size: int = 1000


@dataclass(frozen=True)
class HierarchyParams(_Params):
    min_layers: int = 1
    max_layers: int = 6
    min_n_vertices_layer: int = 50
    higher_max_degree: int = 40
    level_norm_param_override: float | None = None
    create_artificial_hub_nodes: int | None = None
