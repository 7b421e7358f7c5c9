import numpy as np
import pytest

from graphlode.model import LID, BruteforceKNNParams, DEGParams, EfannaParams, HNSWParams, KeepEdges, NSSGParams, RNGGParams, RNNParams
from graphlode.operators import kernels
from graphlode.operators.sharded import local_builder

X = np.random.default_rng(0).normal(size=(300, 8))


def exact(x, q, k):
    d = ((x - q) ** 2).sum(1)
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


def mean_recall(x, levels, entries, k=10, ef=60):
    hits = 0
    for q in x[::10]:
        got = kernels.layered_search(x, levels, q, k, ef, top_entries=entries) if len(levels) > 1 else kernels.greedy_search(x, levels[0][1], q, entries, k, ef)
        hits += len({i for _, i in got} & set(exact(x, q, k)))
    return hits / (len(x[::10]) * k)


@pytest.mark.parametrize(
    "params",
    [DEGParams(edges_per_vertex=12), DEGParams(edges_per_vertex=11, lid=LID.LOW), DEGParams(edges_per_vertex=12, improve_k=5, swap_tries=1), RNNParams(20, 16, 3, 4), HNSWParams(12, 24), NSSGParams(range=20, l=60), BruteforceKNNParams(20), EfannaParams(20, 40, 5, 10, 30)],
)
def test_builders_find_neighbours(params):
    levels, entries = local_builder(params)(X)
    assert mean_recall(X, levels, entries) > 0.95
    random_levels, _ = local_builder(RNGGParams(degree=20))(X)
    assert mean_recall(X, levels, entries, ef=20) > mean_recall(X, random_levels, [0], ef=20)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 30, 31])
@pytest.mark.parametrize("params", [DEGParams(edges_per_vertex=4), RNNParams(5, 4, 2, 2), HNSWParams(4, 8), NSSGParams(range=5, l=9), BruteforceKNNParams(5), EfannaParams(5, 9, 2, 3, 4), RNGGParams(3, prune_extend_degree=4)])
def test_small_inputs(n, params):
    levels, _ = local_builder(params)(X[:n])
    for ids, adjacency, _ in levels:
        assert len(adjacency) == len(ids)
        assert all(j != i and j < len(ids) for i, a in enumerate(adjacency) for j in a)


def test_regular_graph_is_regular_and_undirected():
    adjacency = kernels.build_deg(X, DEGParams(edges_per_vertex=10, improve_k=5, swap_tries=1))
    assert {len(a) for a in adjacency} == {10}
    assert all(i in adjacency[j] for i, a in enumerate(adjacency) for j in a)


def test_duplicates_do_not_break_pruning():
    x = np.repeat(X[:40], 3, axis=0)
    levels, entries = local_builder(NSSGParams(range=15, l=40))(x)
    assert all(len(a) <= 15 + 1 for a in levels[0][1])


def test_search_with_a_full_heap_is_exact():
    levels, _ = local_builder(BruteforceKNNParams(20))(X)
    for q in X[:20]:
        assert [i for _, i in kernels.greedy_search(X, levels[0][1], q, [0], 10, len(X))] == exact(X, q, 10)


def test_hill_climb_and_capped_frontier():
    levels, _ = local_builder(BruteforceKNNParams(20))(X)
    for q in X[:20]:
        one = kernels.greedy_search(X, levels[0][1], q, [0], 1, 1)
        assert len(one) == 1
        few = kernels.greedy_search(X, levels[0][1], q, [0], 5, 30, max_frontier=5)
        assert few == sorted(few) and len(few) == 5


def test_range_search_and_paths():
    levels, _ = local_builder(BruteforceKNNParams(20))(X)
    adjacency = levels[0][1]
    near = kernels.range_search(X, adjacency, X[7], [0], 5, 0.2)
    assert [i for _, i in near] == exact(X, X[7], 5)
    assert kernels.has_path(X, adjacency, 0, 99, 300)
    assert not kernels.has_path(X, [[] for _ in X], 0, 99, 300)


def test_repair_reaches_all():
    adjacency = [[1], [0], [3], [2], [], []]
    kernels.connect(adjacency, 0, 4)
    seen, stack = {0}, [0]
    while stack:
        for j in adjacency[stack.pop()]:
            if j not in seen:
                seen.add(j)
                stack.append(j)
    assert seen == set(range(6))


def test_builders_take_all_of_their_degrees(monkeypatch):
    x, asked = np.random.default_rng(1).normal(size=(120, 4)).astype(np.float32), []
    random_lists, build_efanna = kernels.random_lists, kernels.build_efanna
    monkeypatch.setattr(kernels, "random_lists", lambda n, k, seed: asked.append(k) or random_lists(n, k, seed))
    monkeypatch.setattr(kernels, "build_efanna", lambda x, params, seed: asked.append(params.k) or build_efanna(x, params, seed))
    local_builder(RNNParams(n_outer_loops=1, n_inner_loops=1))(x)
    local_builder(NSSGParams())(x)
    assert asked == [100, 70]


@pytest.mark.parametrize("params", [HNSWParams(n_rounds=2), HNSWParams(finetune_rnn=True), HNSWParams(finetune_sen=True), HNSWParams(post_prune_heuristic=True), HNSWParams(insert_minibatch_size=7), DEGParams(improve_eps=0.1), DEGParams(max_path_length=3), RNGGParams(degree_short_edges=3), RNNParams(concurrent_batch_size=1), BruteforceKNNParams(batch_size=2)])
def test_parameters_that_are_not_read_are_refused(params):
    with pytest.raises(ValueError, match="not implemented"):
        local_builder(params)


def reached_from(adjacency, root):
    seen, stack = {root}, [root]
    while stack:
        for j in adjacency[stack.pop()]:
            if j not in seen:
                seen.add(j)
                stack.append(j)
    return seen


def test_repair_without_room_leaves_no_gap():
    adjacency = [[1], [0], [3], [2], [4], [5]]
    assert kernels.connect(adjacency, 0, 1) == 3
    assert reached_from(adjacency, 0) == set(range(6))
    roomy = [[] for _ in range(50)]
    assert kernels.connect(roomy, 7, 2) == 0 and max(map(len, roomy)) == 2 and reached_from(roomy, 7) == set(range(50))


def test_neighbour_descent_finds_neighbours():
    x = np.random.default_rng(2).normal(size=(400, 10))
    found = kernels.build_efanna(x, EfannaParams(k=10, l=30, iter=8, s=10, r=30))
    assert np.mean([len(set(a) & set(exact(x, x[i], 11))) / 10 for i, a in enumerate(found)]) > 0.95
    small = np.repeat(X[:20], 3, axis=0)
    everything = kernels.build_efanna(small, EfannaParams(k=59, l=60, iter=3, s=60, r=60))
    assert all(sorted([*a, i]) == list(range(60)) for i, a in enumerate(everything))


@pytest.mark.parametrize("mode", list(KeepEdges))
def test_random_graph_modes(mode):
    wide = kernels.drawn_lists(300, 20, "rngg")
    lists = kernels.build_rngg(X, RNGGParams(degree=9, prune_extend_degree=20, prune=mode))
    for i, (row, kept) in enumerate(zip(wide, lists, strict=True)):
        near = sorted(row, key=lambda j: (((X[j] - X[i]) ** 2).sum(), j))
        want = {KeepEdges.SHORT: near[:9], KeepEdges.LONG: near[-9:], KeepEdges.MIDDLE: near[6:14], KeepEdges.SPECIAL: near[:4] + near[9:13], KeepEdges.NONE: row[:9]}
        assert kept == want[mode] and len(set(row)) == 20 and i not in row


def test_nssg_over_a_given_graph():
    start = kernels.nearest_lists(X, 20)
    levels, _ = local_builder(NSSGParams(range=20, l=60), start)(X)
    assert levels[0][1] == kernels.build_nssg(X, start, NSSGParams(range=20, l=60))[0]
    with pytest.raises(ValueError, match="other rows"):
        local_builder(NSSGParams(range=20, l=60), start[:-1])(X)


def test_capped_frontier_drops_the_farthest():
    adjacency = kernels.nearest_lists(X, 8)
    for q in X[:40]:
        got = kernels.greedy_search(X, adjacency, q + 0.1, [0], 5, 40, max_frontier=3)
        assert got == capped_by_sorting(X, adjacency, q + 0.1, 5, 40, 3)
        assert kernels.greedy_search(X, adjacency, q, [0], 5, 40, max_frontier=300) == kernels.greedy_search(X, adjacency, q, [0], 5, 40)


def capped_by_sorting(x, adjacency, q, k, ef, most):
    d = lambda i: float(kernels.distances(x, [i], q)[0])
    seen, kept, frontier = {0}, [(d(0), 0)], [(d(0), 0)]
    while frontier:
        frontier.sort()
        at, i = frontier.pop(0)
        if len(kept) >= ef and at > kept[-1][0]:
            break
        for j in [j for j in adjacency[i] if j not in seen]:
            seen.add(j)
            if len(kept) < ef or (d(j), j) < kept[-1]:
                kept = sorted([*kept, (d(j), j)])[:ef]
                frontier = sorted([*frontier, (d(j), j)])[:most]
    return kept[:k]


def test_range_paths():
    adjacency = kernels.nearest_lists(X, 10)
    assert kernels.has_path_range(X, adjacency, 0, 99, 10, 5.0)
    assert not kernels.has_path_range(X, [[] for _ in X], 0, 99, 10, 5.0)


def test_small_world_levels_are_nested():
    levels = kernels.build_hnsw(X, HNSWParams(6, 12))
    assert len(levels) > 1 and len(levels[0][0]) == 300
    for (below, _, _), (ids, adjacency, parent) in zip(levels, levels[1:], strict=False):
        assert (below[parent] == ids).all() and 0 in ids and max(map(len, adjacency)) <= 6
