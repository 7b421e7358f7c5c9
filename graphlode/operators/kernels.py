"""Graph algorithms on one shard in memory: search and the builders that grow a graph point by point.

Each works on a float64 matrix and adjacency as lists of row numbers, and is deterministic for a given seed. The Spark side
(`sharded.py`) runs them on shards of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np

from ..functions.distance import angle_from_dim, cos_threshold
from ..model import LID, DEGParams, EfannaParams, HNSWParams, KeepEdges, NSSGParams, RNGGParams, RNNParams
from .knn import local_top

#: Neighbour descent links all rows of so few.
SMALL = 30
#: Pairs that neighbour descent offers to pools at a time.
OFFERS = 1 << 19


def distances(x, rows, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a matrix from q; x may also be a function that has measured them."""
    if callable(x):
        return x(rows)
    d = x[rows] - q
    return np.einsum("ij,ij->i", d, d)


def greedy_search(x, adjacency, q, entries, k: int, ef: int, max_frontier: int | None = None) -> list[tuple[float, int]]:
    """Best-first search: the ef best seen are kept, the frontier is left when its nearest is farther than the worst kept.

    max_frontier bounds the frontier: when it is full its farthest member makes way. ef = 1 is hill climbing.
    """
    ef = max(ef, 1)
    visited = set(entries)
    start = list(visited)
    if not start:
        return []
    kept = [(-d, -i) for d, i in zip(distances(x, start, q), start, strict=True)]
    frontier = [(-d, -i) for d, i in kept]
    heapq.heapify(kept)
    heapq.heapify(frontier)
    # a capped frontier has a second heap, farthest first; `waiting` tells which entries of either are still in it
    farthest, waiting = [(-d, -i) for d, i in frontier], {i for _, i in frontier}
    heapq.heapify(farthest)
    while len(kept) > ef:
        heapq.heappop(kept)
    while frontier:
        d, i = heapq.heappop(frontier)
        if max_frontier is not None:
            if i not in waiting:
                continue
            waiting.discard(i)
        if len(kept) >= ef and d > -kept[0][0]:
            break
        fresh = [j for j in adjacency[i] if j not in visited]
        if not fresh:
            continue
        visited.update(fresh)
        for dj, j in zip(distances(x, fresh, q).tolist(), fresh, strict=True):
            if len(kept) < ef or (dj, j) < (-kept[0][0], -kept[0][1]):
                heapq.heappush(kept, (-dj, -j))
                if len(kept) > ef:
                    heapq.heappop(kept)
                heapq.heappush(frontier, (dj, j))
                if max_frontier is not None:
                    heapq.heappush(farthest, (-dj, -j))
                    waiting.add(j)
                    while len(waiting) > max_frontier:
                        waiting.discard(-heapq.heappop(farthest)[1])
    return sorted((-d, -i) for d, i in kept)[:k]


def range_search(x, adjacency, q, entries, k: int, eps: float, visited: set | None = None) -> list[tuple[float, int]]:
    """The k best met by a search that goes on wherever a node lies within radius * (1 + eps) of the k-th best; visited, if given, gets all nodes met."""
    visited, kept = set() if visited is None else visited, []
    visited.update(entries)
    frontier = sorted(zip(distances(x, list(visited), q).tolist(), visited, strict=True))
    for d, i in frontier:
        heapq.heappush(kept, (-d, -i))
    while len(kept) > k:
        heapq.heappop(kept)
    heapq.heapify(frontier)
    while frontier:
        d, i = heapq.heappop(frontier)
        radius = -kept[0][0] if len(kept) >= k else np.inf
        if d > radius * (1 + eps):
            break
        fresh = [j for j in adjacency[i] if j not in visited]
        if not fresh:
            continue
        visited.update(fresh)
        for dj, j in zip(distances(x, fresh, q).tolist(), fresh, strict=True):
            radius = -kept[0][0] if len(kept) >= k else np.inf
            if dj <= radius * (1 + eps):
                heapq.heappush(frontier, (dj, j))
                heapq.heappush(kept, (-dj, -j))
                if len(kept) > k:
                    heapq.heappop(kept)
    return sorted((-d, -i) for d, i in kept)


def has_path(x, adjacency, start: int, target: int, ef: int) -> bool:
    """Whether a greedy search for target from start meets it; False does not prove it unreachable."""
    return any(i == target for _, i in greedy_search(x, adjacency, x[target], [start], ef, ef))


def has_path_range(x, adjacency, start: int, target: int, k: int, eps: float) -> bool:
    """The same by a range search: whether it meets target, among its results or not."""
    met: set[int] = set()
    range_search(x, adjacency, x[target], [start], k, eps, met)
    return target in met


def descend(x, levels, q, ef_higher: int = 1, max_frontier: int | None = None, top_entries=(0,)) -> list[int]:
    """Where the bottom is entered; levels from the bottom: (global ids, adjacency in local ids, places in the level below)."""
    entries = None
    for number in range(len(levels) - 1, 0, -1):
        ids, adjacency, below = levels[number]
        start = [i for i in top_entries if i < len(ids)] or [0]
        got = greedy_search(x[ids], adjacency, q, entries or start, ef_higher, ef_higher, max_frontier)
        entries = [int(below[i]) for _, i in got]
    return entries or [0]


def layered_search(x, levels, q, k: int, ef: int, ef_higher: int = 1, max_frontier: int | None = None, top_entries=(0,)) -> list[tuple[float, int]]:
    """Descends from the top, and searches the bottom."""
    entries = descend(x, levels, q, ef_higher, max_frontier, top_entries)
    ids, adjacency, _ = levels[0]
    found = greedy_search(x[ids] if len(ids) != len(x) else x, adjacency, q, entries, k, max(ef, k), max_frontier)
    return [(d, int(ids[i])) for d, i in found]


def led_to(adjacency, starts) -> np.ndarray:
    """Whether paths from any of starts lead to a row."""
    met = np.zeros(len(adjacency), bool)
    met[list(starts)] = True
    left = list(starts)
    while left:
        for j in adjacency[left.pop()]:
            if not met[j]:
                met[j] = True
                left.append(j)
    return met


class Steps:
    """Edges between places 0 to n - 1 as arrays, by their first end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        self.ends, self.at = b[np.argsort(a, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])

    def flood(self, met: np.ndarray, starts: np.ndarray) -> None:
        """Marks in met all that paths from starts lead to past what is marked already."""
        frontier = np.unique(starts[~met[starts]])
        met[frontier] = True
        while len(frontier):
            first, counts = self.at[frontier], self.at[frontier + 1] - self.at[frontier]
            ends = self.ends[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            frontier = np.unique(ends[~met[ends]])
            met[frontier] = True

    def least(self, some: np.ndarray) -> np.ndarray:
        """For each place of some (ascending) the least of some that leads to it by edges between them, itself included; -1 elsewhere."""
        label, free = np.full(len(self.at) - 1, -1, np.int64), bytearray(len(self.at) - 1)
        for s in some.tolist():
            free[s] = 1
        ends, at = self.ends.tolist(), self.at.tolist()
        for s in some.tolist():
            left = [s] if free[s] else []
            free[s] = 0
            while left:
                i = left.pop()
                label[i] = s
                for j in ends[at[i] : at[i + 1]]:
                    if free[j]:
                        free[j] = 0
                        left.append(j)
        return label


def reversed_lists(adjacency) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in adjacency]
    for i, ends in enumerate(adjacency):
        for j in ends:
            out[j].append(i)
    return out


# ---- even-regular graphs ----


class RegularGraph:
    """An undirected graph whose nodes all have the same even number of edges, grown one node at a time."""

    def __init__(self, x: np.ndarray, degree: int):
        self.x, self.degree = x, degree
        self.near: list[dict[int, float]] = [{} for _ in range(len(x))]
        first = min(degree + 1, len(x))
        for a in range(first):
            for b in range(a):
                self.link(a, b)

    def length(self, a: int, b: int) -> float:
        d = self.x[a] - self.x[b]
        return float(d @ d)

    def link(self, a: int, b: int, w: float | None = None) -> None:
        self.near[a][b] = self.near[b][a] = self.length(a, b) if w is None else w

    def unlink(self, a: int, b: int) -> None:
        del self.near[a][b], self.near[b][a]

    def obeys(self, a: int, b: int, w: float) -> bool:
        """No neighbour of a that also touches b is closer to both than they are to each other."""
        return not any(b in self.near[u] and w > max(wu, self.near[u][b]) for u, wu in self.near[a].items())

    def add(self, v: int, params: DEGParams, present: int) -> None:
        """Joins node v to the graph of the nodes below `present`."""
        ef = max(params.max_build_heap_size, self.degree)
        if params.use_range_search and params.extend_k:
            found = range_search(self.x, self.near, self.x[v], [0], max(params.extend_k, self.degree), params.extend_eps)
        else:
            found = greedy_search(self.x, self.near, self.x[v], [0], ef, ef, params.max_build_frontier_size)
        order = [(d, c) for d, c in found]
        for checked in (True, False):
            for d, c in order:
                if len(self.near[v]) >= self.degree:
                    return
                if c not in self.near[v] and (not checked or self.obeys(c, v, d)):
                    self._split(v, c, d, params.lid)
        # what the search did not meet: any node serves, in order of distance, until the degree is full
        if len(self.near[v]) < self.degree:
            rest = np.setdiff1d(np.arange(present), [v])
            for c in rest[np.argsort(distances(self.x, rest, self.x[v]), kind="stable")].tolist():
                if len(self.near[v]) >= self.degree:
                    return
                if c not in self.near[v]:
                    self._split(v, c, self.length(v, c), params.lid)

    def _split(self, v: int, c: int, d: float, lid: LID) -> None:
        """Puts v between c and one of its neighbours, which keeps everyone's degree."""
        free = [(w, b) for b, w in self.near[c].items() if b != v and b not in self.near[v]]
        if not free:
            return
        if lid is LID.LOW:
            w, b = min(free, key=lambda t: (d + self.length(v, t[1]) - t[0], t[1]))
        else:
            w, b = max(free)
        self.unlink(c, b)
        self.link(v, c, d)
        self.link(v, b)

    def improve(self, tries: int, seed: int) -> int:
        """Swaps pairs of edges a-b, c-d for a-c, b-d where the sum of lengths shrinks; gives the number of swaps."""
        rng, done = np.random.default_rng(seed), 0
        for _ in range(tries):
            a = int(rng.integers(len(self.x)))
            bad = [(w, b) for b, w in self.near[a].items() if not self.obeys(a, b, w)]
            if not bad:
                continue
            w, b = max(bad)
            best = None
            for _, c in greedy_search(self.x, self.near, self.x[a], [a], 10, 20):
                if c in (a, b) or c in self.near[a]:
                    continue
                for d, wd in self.near[c].items():
                    if d not in (a, b) and d not in self.near[b]:
                        gain = w + wd - self.length(a, c) - self.length(b, d)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, c, d
            if best:
                _, c, d = best
                self.unlink(a, b)
                self.unlink(c, d)
                self.link(a, c)
                self.link(b, d)
                done += 1
        return done


def build_deg(x: np.ndarray, params: DEGParams, seed: int = 0) -> list[list[int]]:
    """An odd degree is rounded up. An unknown LID is taken as high."""
    degree = params.edges_per_vertex + params.edges_per_vertex % 2
    g = RegularGraph(x, degree)
    for v in range(degree + 1, len(x)):
        g.add(v, params, v)
    if params.improve_k and params.swap_tries:
        g.improve((params.swap_tries + params.additional_swap_tries) * len(x), seed)
    return [sorted(n, key=lambda b: (n[b], b)) for n in g.near]


# ---- neighbour descent, locally, and pruning of its result ----


def nearest_lists(x: np.ndarray, k: int) -> list[list[int]]:
    """Exact k nearest others of each row of a shard, ties by row."""
    rows = np.arange(len(x))
    owner, ids, _ = local_top(rows, x, rows, x, min(k, len(x) - 1) + 1, True) if len(x) > 1 else (rows[:0], rows[:0], None)
    return [part[:k].tolist() for part in np.split(ids, np.searchsorted(owner, np.arange(1, len(x))))] if len(x) else []


def random_lists(n: int, k: int, seed: int) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    k = min(k, n - 1)
    return [[int(j + (j >= i)) for j in rng.choice(n - 1, k, replace=False)] if k > 0 else [] for i in range(n)]


def drawn_lists(n: int, k: int, seed: str) -> list[list[int]]:
    """The random graph of the table form (`graphs.random_graph`) over rows 0 to n - 1: draw t of row i comes from md5(seed:i:t)."""
    k = min(k, max(n - 1, 0))
    tries, out = n * 8 if k * 2 > n else k * 2 + 20, []
    for i in range(n):
        draws = (int(hashlib.md5(f"{seed}:{i}:{t}".encode()).hexdigest()[:12], 16) % n for t in range(tries))
        out.append(list(dict.fromkeys(j for j in draws if j != i))[:k])
    return out


def build_rngg(x: np.ndarray, params: RNGGParams, seed: str = "rngg") -> list[list[int]]:
    """prune_extend_degree random edges, cut to `degree` by distance or in order of drawing."""
    if params.prune_extend_degree < params.degree:
        raise ValueError("prune_extend_degree must not be below degree")
    degree, extend, out = params.degree, params.prune_extend_degree, []
    for i, row in enumerate(drawn_lists(len(x), extend, seed)):
        d = distances(x, row, x[i]) if row else np.empty(0)
        near = [row[j] for j in np.lexsort((row, d))] if row else []
        m = min(degree, len(row))
        match params.prune:
            case KeepEdges.SHORT:
                chosen = near[:m]
            case KeepEdges.LONG:
                chosen = near[len(near) - m :]
            case KeepEdges.MIDDLE:
                chosen = near[extend // 2 - m // 2 : extend // 2 + m // 2]
            case KeepEdges.SPECIAL:
                chosen = near[: degree // 2] + near[degree : degree + degree // 2]
            case KeepEdges.NONE:
                chosen = row[:m]
        out.append(chosen)
    return out


def _best(owner: np.ndarray, ids: np.ndarray, d: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of rows (owner, id, distance, fresh) one for each owner and id, an old flag first, and the `most` nearest of each owner."""
    order = np.lexsort((fresh, ids, owner))
    owner, ids, d, fresh = owner[order], ids[order], d[order], fresh[order]
    one = np.ones(len(ids), bool)
    one[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, d, fresh = owner[one], ids[one], d[one], fresh[one]
    order = np.lexsort((ids, d, owner))
    owner, ids, d, fresh = owner[order], ids[order], d[order], fresh[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = place < most
    return owner[keep], ids[keep], d[keep], fresh[keep]


def _first(owner: np.ndarray, ids: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` rows of each owner with the smallest key."""
    order = np.lexsort((key, owner))
    owner, ids = owner[order], ids[order]
    keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < most
    return owner[keep], ids[keep]


def _lists(owner: np.ndarray, ids: np.ndarray, n: int) -> list[np.ndarray]:
    pairs = np.unique(np.stack([owner, ids]), axis=1)
    return np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, n)))


def build_efanna(x: np.ndarray, params: EfannaParams, seed: int = 0) -> list[list[int]]:
    """Neighbour descent: pools of the l best, `iter` rounds in which fresh members of a node's lists meet each other and the older ones.

    A pool starts with s random rows; in the first round 2 l random rows of each node meet. After that up to s fresh and s other members of
    each pool take part, and at most r (2 r for the others) nodes that hold the node itself, drawn at random.
    """
    n = len(x)
    if n <= SMALL:
        return [[j for j in np.lexsort((np.arange(n), distances(x, np.arange(n), x[i]))).tolist() if j != i] for i in range(n)]
    k = n // 2 if params.k > n else params.k
    rng, s = np.random.default_rng(seed), min(params.s, n - 1)

    def drawn(many: int) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(n), many)
        return owner, (owner + rng.integers(1, n, n * many)) % n

    owner, ids = drawn(s)
    gap = x[owner] - x[ids]
    pool = _best(owner, ids, np.einsum("ij,ij->i", gap, gap), np.ones(len(ids), bool), params.l)
    new, old = _lists(*drawn(min(2 * params.l, n - 1)), n), [np.empty(0, np.int64)] * n
    for _ in range(params.iter):
        worst, held = np.full(n, np.inf), np.bincount(pool[0], minlength=n)
        full = held >= params.l
        worst[full] = pool[2][np.cumsum(held)[full] - 1]  # pools are in order of distance
        offers, many = [], 0
        for i in range(n):
            a, b = new[i], np.concatenate([new[i], old[i]])
            if len(a) and len(b) > 1:
                d = np.maximum((x[a] ** 2).sum(1)[:, None] + (x[b] ** 2).sum(1)[None, :] - 2 * x[a] @ x[b].T, 0)
                p, q = np.nonzero((a[:, None] != b[None, :]) & (d < np.maximum(worst[a][:, None], worst[b][None, :])))
                offers.append(np.stack([np.concatenate([a[p], b[q]]), np.concatenate([b[q], a[p]])]))
                many += len(p)
            if offers and (many > OFFERS or i == n - 1):  # merged some at a time, so offers do not pile up
                pairs = np.unique(np.concatenate(offers, axis=1), axis=1)
                offers, many = [], 0
                gap = x[pairs[0]] - x[pairs[1]]
                d = np.einsum("ij,ij->i", gap, gap)
                good = d < worst[pairs[0]]
                pool = _best(*(np.concatenate([u, v]) for u, v in zip(pool, (pairs[0][good], pairs[1][good], d[good], np.ones(good.sum(), bool)), strict=True)), params.l)
                held = np.bincount(pool[0], minlength=n)
                worst = np.full(n, np.inf)
                full = held >= params.l
                worst[full] = pool[2][np.cumsum(held)[full] - 1]
        owner, ids, d, fresh = pool
        if not fresh.any():
            break
        sides = []
        for flag, cap in ((True, params.r), (False, 2 * params.r)):
            at = np.flatnonzero(fresh == flag)
            at = at[np.arange(len(at)) - np.searchsorted(owner[at], owner[at]) < s]
            back = _first(ids[at], owner[at], rng.random(len(at)), cap)
            sides.append(_lists(np.concatenate([owner[at], back[0]]), np.concatenate([ids[at], back[1]]), n))
            if flag:
                fresh = fresh.copy()
                taken = at
        fresh[taken] = False
        pool, (new, old) = (owner, ids, d, fresh), sides
    owner, ids, d, _ = pool
    return [part[:k].tolist() for part in np.split(ids, np.searchsorted(owner, np.arange(1, n)))]


def build_rnn_descent(x: np.ndarray, params: RNNParams, seed: int = 0) -> list[list[int]]:
    """Relative-neighbourhood descent: edges hidden by a nearer neighbour move on to it; reverse edges come in each outer round."""
    n = len(x)
    near = [dict(zip(r, distances(x, r, x[i]).tolist(), strict=True)) if r else {} for i, r in enumerate(random_lists(n, params.initial_degree, seed))]
    for outer in range(params.n_outer_loops):
        for _ in range(params.n_inner_loops):
            moved = 0
            for u in range(n):
                kept: list[int] = []
                for v in sorted(near[u], key=lambda b: (near[u][b], b)):
                    hidden = None
                    if kept:
                        d = distances(x, kept, x[v])
                        at = int(np.argmin(d))
                        hidden = (kept[at], float(d[at])) if d[at] < near[u][v] else None
                    if hidden is None:
                        kept.append(v)
                    else:
                        w, d = hidden
                        if v not in near[w]:
                            near[w][v] = d
                            moved += 1
                near[u] = {v: near[u][v] for v in kept}
            if not moved:
                break
        if outer < params.n_outer_loops - 1:
            for u in range(n):
                for v, d in list(near[u].items()):
                    near[v].setdefault(u, d)
            near = [dict(sorted(m.items(), key=lambda t: (t[1], t[0]))[: params.reduce_degree]) for m in near]
    return [sorted(m, key=lambda b: (m[b], b))[: params.reduce_degree] for m in near]


def angle_keep(x, u: int, pool: list[tuple[float, int]], t: float, most: int) -> list[tuple[float, int]]:
    """Nearest first, skipping what a kept one hides: seen from u, the angle between them is too small."""
    kept: list[tuple[float, int]] = []
    for d, v in pool:
        if len(kept) >= most:
            break
        if v == u or any(v == r for _, r in kept):
            continue
        if kept:
            dk = np.array([k for k, _ in kept])
            apart = distances(x, [r for _, r in kept], x[v])
            with np.errstate(invalid="ignore", divide="ignore"):
                cos = (d + dk - apart) / 2 / np.sqrt(d * dk)
            if (cos > t).any():  # an undefined angle hides nothing
                continue
        kept.append((d, v))
    return kept


def build_nssg(x: np.ndarray, start: list[list[int]], params: NSSGParams, seed: int = 0) -> tuple[list[list[int]], list[int]]:
    """Two-hop pools, angle pruning, reverse edges, then repairs until all is reachable from the entry points."""
    n = len(x)
    most = min(params.range, n - 1)
    pool_size = min(params.l, n)
    angle = params.angle
    if params.derive_angle_from_dim:
        angle = angle_from_dim(x.shape[1])
    t = cos_threshold(angle)
    start = [r[:most] for r in start]
    kept = []
    for u in range(n):
        pool: dict[int, None] = {}
        for v in start[u]:
            for w in start[v]:
                if w != u and len(pool) < pool_size:
                    pool.setdefault(w)
            if len(pool) >= pool_size:
                break
        ids = list(dict.fromkeys([*pool, *start[u]]))
        d = distances(x, ids, x[u]).tolist() if ids else []
        kept.append(angle_keep(x, u, sorted(zip(d, ids, strict=True)), t, most))
    offers: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for u in range(n):
        for d, v in kept[u]:
            offers[v].append((d, u))
    for v in range(n):  # in order of distance, so the result does not depend on who comes first
        for d, u in sorted(offers[v]):
            if any(w == u for _, w in kept[v]):
                continue
            kept[v] = [*kept[v], (d, u)] if len(kept[v]) < most else angle_keep(x, v, sorted([*kept[v], (d, u)]), t, most)
    adjacency = [[v for _, v in sorted(r)] for r in kept]
    roots = np.random.default_rng(seed).permutation(n)[: params.n_try].tolist()
    for root in roots:
        connect(adjacency, root, most)
    return adjacency, roots


def connect(adjacency: list[list[int]], root: int, most: int) -> int:
    """Links the lowest unreached node to the lowest reached one with room, until all is reached from root.

    Where no reached node has room, the one with fewest edges gets one beyond `most`; gives the number of such edges.
    """
    n, seen, queue, beyond = len(adjacency), np.zeros(len(adjacency), bool), [root], 0
    seen[root] = True
    room: list[int] = [root]  # reached nodes that had room when they were met
    first = 0  # no node below is unreached
    while True:
        while queue:
            for v in adjacency[queue.pop()]:
                if not seen[v]:
                    seen[v] = True
                    queue.append(v)
                    heapq.heappush(room, v)
        while first < n and seen[first]:
            first += 1
        if first == n:
            return beyond
        while room and len(adjacency[room[0]]) >= most:
            heapq.heappop(room)
        host = room[0] if room else min((w for w in range(n) if seen[w]), key=lambda w: (len(adjacency[w]), w))
        beyond += not room
        adjacency[host].append(first)
        seen[first] = True
        queue.append(first)
        heapq.heappush(room, first)


# ---- hierarchical navigable small worlds ----


def build_hnsw(x: np.ndarray, params: HNSWParams, seed: int = 0) -> list[tuple[np.ndarray, list[list[int]], np.ndarray]]:
    """Levels from the bottom: (global ids, adjacency in local ids, places in the level below).

    Rows are inserted one by one from the top: a search with one candidate leads down to the row's own level, and from there each level is
    entered where the search in the one above it ended. Row 0 is in all levels and is where every search starts.
    """
    n = len(x)
    norm = params.level_norm_param_override or 1 / np.log(params.higher_max_degree)
    draw = np.random.default_rng(seed).random(n)
    level_of = np.minimum((-np.log(1 - draw) * norm).astype(int), params.max_layers - 1)
    if not n:
        return [(np.arange(0), [], np.arange(0))]
    top = level_of[0] = level_of.max()
    near: list[dict[int, list[int]]] = [{0: []} for _ in range(top + 1)]
    for v in range(1, n):
        entries = [0]
        for level in range(top, -1, -1):
            ef = params.max_build_heap_size if level <= level_of[v] else 1
            found = greedy_search(x, near[level], x[v], entries, ef, ef, params.max_build_frontier_size)
            entries = [i for _, i in found]
            if level <= level_of[v]:
                _insert(x, near[level], v, found, params.lowest_max_degree if level == 0 else params.higher_max_degree, params)
    out, below = [], None
    for graph in near:
        ids = np.array(sorted(graph))
        place = {int(v): i for i, v in enumerate(ids)}
        out.append((ids, [[place[u] for u in graph[v]] for v in ids.tolist()], ids if below is None else np.searchsorted(below, ids)))
        below = ids
    return out


def _diverse(x, pool: list[tuple[float, int]], most: int, heuristic: bool) -> list[int]:
    if not heuristic:
        return [v for _, v in pool[:most]]
    kept: list[int] = []
    for d, v in pool:
        if len(kept) >= most:
            break
        if not kept or (distances(x, kept, x[v]) > d).all():
            kept.append(v)
    return kept


def _insert(x, near: dict[int, list[int]], v: int, found: list[tuple[float, int]], most: int, params: HNSWParams) -> None:
    """Links row v to a diverse choice of what a search for it found; neighbours with too many edges choose anew."""
    chosen = _diverse(x, found, max(most // 2, 1), params.insert_heuristic)
    if params.insert_heuristic_extend:
        chosen += [u for _, u in found if u not in chosen][: max(most // 2, 1) - len(chosen)]
    near[v] = chosen
    for u in chosen:
        near[u].append(v)
        if len(near[u]) > most:
            pool = sorted(zip(distances(x, near[u], x[u]).tolist(), near[u], strict=True))
            near[u] = _diverse(x, pool, most, True)
