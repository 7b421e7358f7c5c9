"""N-gram Jaccard join with count-vector R-trees.

A document's set of word shingles is hashed into groups (a power of two, 64 to 4,096, about as many as the set is large); the
counts of the groups are its point. The sum over the groups of the smaller of two counts bounds two sets' overlap from above, and
the sum of the smaller of two boxes' upper corners does so for all points inside. An R-tree over points prunes boxes and
points by these bounds; every pair that survives in an R-tree is verified on the sets themselves, and links come from nowhere else.

One tree over a whole corpus prunes nothing: the points of unrelated texts lie at nearly equal distances, so
every box meets every other and the work grows with the square of the input. So there is a forest. Each tree holds the
documents that share one *key*, an element among the first n - ceil(n * percent / 100) + 1 of the set in a global
order; two sets at or above the threshold always share such a key, so no pair is lost, whatever the order. It
puts elements that many documents hold last, by counts over all documents, so passages that many share are no keys.

1. `profile`: size and signature of each document, and the counted elements of each task in packed form. Documents with equal sets
   are one class from here on.
2. `frequent`: elements are counted over all documents; ranks of the frequent ones make a table of CELLS cells.
3. `keys`, `blocks`: each class gives its keys; a key that several classes give is a block. Blocks with the same classes are one.
4. `survivors`, `forest`: blocks are dealt by their least class, so a class is sent once for many blocks. A task grows each block's
   trees, one for each fineness, and joins them. First coarse points tell which classes have a partner within the bound at all; only their sets are read.
   Then pairs within the bound are verified if they are not connected yet; a block that is one component is done, so copies cost a number of
   verifications in proportion to their number. Only links that connect leave the task.
5. A block above `tile_rows` or `tile_elements` is cut into tiles by a hash. Each tile is a tree of its own, then one tree holds a head
   of each tile, and then trees are joined for those pairs of tiles that are not of one component (tiles are cut anew, by component).

Equality is that of 64-bit shingle hashes and of 128-bit set signatures; both are fixed mixing functions without a secret, so
texts made on purpose can collide.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows
with a null id take no part and have a null component. Rows that repeat an id are nodes of their own: each gets the smallest id
that its own text reaches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, frugal, frugal_group, join_groups, staged
from .components import components
from .idfilter import id_filter, slots
from .textvec import Words, mix, slices, windows

CELLS = 1 << 24
#: At most so many frequent elements have a rank; they come to the driver and go to the tasks as a table of CELLS bytes.
MOST_FREQUENT = 1 << 22
LEAST_FREQUENT = 4
#: Elements that a task counts before it sends the counts on, and elements of a bucket that are counted together.
CHUNK, BUCKET = 1 << 20, 1 << 20
#: Bits by which the elements of a bucket are told apart when they are counted.
REST = 26
#: A key that more documents hold is dealt to several tasks.
HOT_BITS = 12
LEAF = 32
MOST_TRIED = 1 << 20
#: Rows of a few numbers that go to all tasks; above that both sides are shuffled.
BROADCAST_ROWS = 500_000
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles, A-Z lower-cased; a shorter text's words are one shingle."""
    words = Words([t.encode() for t in texts], lower=True)
    grams, of = windows(words, n)
    out = []
    for i in range(len(texts)):
        k = words.of[i + 1] - words.of[i]
        if k >= n:
            out.append(np.unique(grams[of[i] : of[i + 1]]))
        elif k:
            acc = np.array([_SHORT])
            for j in range(words.of[i], words.of[i + 1]):
                acc = mix(acc + words.hashes[j : j + 1])
            out.append(acc)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), mix(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes put together by place, under Zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def prefix(s: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits + REST bits of hashes, by which they are counted."""
    return s >> np.uint64(64 - REST - bits)


def counted(s: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, gaps of sorted distinct rests, how often each) for hashes with repeats."""
    values, times = np.unique(prefix(s, bits), return_counts=True)
    buckets, rest = values >> np.uint64(REST), (values & np.uint64((1 << REST) - 1)).astype(np.uint32)
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(values)]
    return [(int(buckets[a]), pack(np.diff(rest[a:b], prepend=np.uint32(0))), pack(np.minimum(times[a:b], 2**32 - 1))) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


PROFILE = "kind int, doc_id long, n long, s1 long, s2 long, point binary, gaps binary, times binary"


def profile(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """kind 0: doc_id, n, s1, s2, point of each document; kind 1: bucket (in doc_id), gaps and times of counted elements."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("point", pa.binary()), ("gaps", pa.binary()), ("times", pa.binary())])

    def rows(kind: int, columns: list) -> pa.RecordBatch:
        size = len(columns[0] if kind == 0 else columns[-1])
        full = [pa.array(np.full(size, kind, np.int32)), *(pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True))]
        return pa.RecordBatch.from_arrays(full, schema=schema)

    def run(batches):
        seen, held, size = set(), [], 0

        def counts():
            found = counted(np.concatenate(held), bits)
            return rows(1, [[x[0] for x in found], None, None, None, None, [x[1] for x in found], [x[2] for x in found]])

        for b in batches:
            ids = b.column(0)
            for first, texts in slices(b.column(1)):
                sets = shingle_sets(texts, n)
                sigs = [signature(s) for s in sets]
                for s, sig in zip(sets, sigs, strict=True):
                    if len(s) and sig not in seen:  # a text counts once in a task
                        seen.add(sig)
                        held.append(s)
                        size += len(s)
                yield rows(0, [ids.slice(first, len(texts)), [len(s) for s in sets], [x[0] for x in sigs], [x[1] for x in sigs], [packed_point(s) for s in sets], None, None])
                if size >= CHUNK:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    return docs.mapInArrow(frugal(run), PROFILE)


def frequent(profiled: DataFrame, bits: int) -> np.ndarray:
    """A rank (bits of the count) for each of CELLS cells; 0 for all but the MOST_FREQUENT elements that LEAST_FREQUENT documents hold."""
    schema = pa.schema([("cell", pa.int32()), ("rank", pa.int32()), ("level", pa.int32())])

    def count(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.cumsum(unpack(x.as_py()), dtype=np.uint32) for x in table["gaps"]])
        times = np.concatenate([unpack(x.as_py()) for x in table["times"]]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, times = values[order], times[order]
        firsts = np.flatnonzero(np.diff(values, prepend=values[:1] + np.uint32(1)))
        total = np.add.reduceat(times, firsts)
        often = total >= LEAST_FREQUENT
        cells = (values[firsts][often] & np.uint32(CELLS - 1)).astype(np.int32)
        logs = np.log2(total[often])
        return pa.table([pa.array(cells), pa.array(logs.astype(np.int32) + 1), pa.array((logs * 4).astype(np.int32))], schema=schema)

    found = staged(profiled.where("kind = 1").select(F.col("doc_id").alias("bucket"), "gaps", "times").groupBy("bucket").applyInArrow(frugal_group(count), "cell int, rank int, level int"), "frequent")
    levels, least, room = {r.level: r["count"] for r in found.groupBy("level").count().collect()}, 0, MOST_FREQUENT  # at most 256 rows
    for level in sorted(levels, reverse=True):
        room -= levels[level]
        if room < 0:
            least = level + 1
            break
    table = np.zeros(CELLS, np.uint8)
    cells = found.where(F.col("level") >= least).groupBy("cell").agg(F.max("rank").cast("byte").alias("rank")).toArrow()  # at most MOST_FREQUENT rows of 5 bytes
    table[cells["cell"].to_numpy()] = cells["rank"].to_numpy()
    return table


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def keys(docs: DataFrame, n: int, percent: int, bits: int, ranks: np.ndarray) -> DataFrame:
    """(key, part, s1, s2) for each key of each distinct set of a task. part: 0, or by s1 for keys of very many documents."""
    schema = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
    packed = zstandard.ZstdCompressor(level=1).compress(ranks.tobytes())

    def run(batches):
        ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        seen = set()
        for b in batches:
            for _, texts in slices(b.column(1)):
                parts, rank_of, meta = [], [], []
                for s in shingle_sets(texts, n):
                    if len(s) and (sig := signature(s)) not in seen:
                        seen.add(sig)
                        rank = ranks[(prefix(s, bits) & np.uint64(CELLS - 1)).astype(np.int64)]
                        # sorted already by hash; frequent ones go last
                        first = np.argsort(rank, kind="stable")[: prefix_length(len(s), percent)]
                        parts.append(s[first])
                        rank_of.append(rank[first])
                        meta.append((len(first), *sig))
                if parts:
                    times, s1, s2 = (np.array(c, np.int64) for c in zip(*meta, strict=True))
                    s1, s2, rank = np.repeat(s1, times), np.repeat(s2, times), np.concatenate(rank_of).astype(np.int64)
                    shares = np.int64(1) << np.maximum(rank - HOT_BITS, 0)
                    part = np.where(shares > 1, 1 + (s1 & (shares - 1)), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(part), pa.array(s1), pa.array(s2)], schema=schema)

    return docs.mapInArrow(frugal(run), "key long, part long, s1 long, s2 long")


def blocks(keyed: DataFrame) -> DataFrame:
    """(key, s1, s2): the distinct rows of keys that several classes give, and all of a key dealt in parts. Rows stream by in order; one is held."""
    dealt = keyed.repartition("key", "part").sortWithinPartitions("key", "part", "s1", "s2")
    names = ("key", "part", "s1", "s2")
    schema = pa.schema([(c, pa.int64()) for c in ("key", "s1", "s2")])

    def emit(rows: np.ndarray, which: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(rows[c][which]) for c in (0, 2, 3)], schema=schema)

    def run(batches):
        held, had = None, False  # the last distinct row, and whether its key had a row before
        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in names])
            if not rows.shape[1]:
                continue
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, new]
            same = (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)
            many = rows[1] > 0
            many[1:] |= same
            many[:-1] |= same
            many[0] |= had
            had = bool(same[-1]) if len(same) else had
            if many[:-1].any():
                yield emit(rows[:, :-1], many[:-1])
            held = rows[:, -1:]
        if held is not None and (had or held[1, 0] > 0):
            yield emit(held, np.array([True]))

    return dealt.mapInArrow(frugal(run), "key long, s1 long, s2 long")


def to_all(rows: DataFrame) -> DataFrame:
    """rows (stored) as the side of a join: sent to all tasks if they are at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def needed(total: np.ndarray | int, percent: int):
    """The overlap two sets of `total` elements together need, times (100 + percent)."""
    return percent * total


def fineness(n: int, per_group: int = 1) -> int:
    """Bits of the group number: 64 to 4,096 groups, with about per_group elements each. Two sets that reach a threshold above 50 % differ by a bit at most."""
    return min(12, max(6, (-(-n // per_group) - 1).bit_length()))


def point(s: np.ndarray, bits: int) -> np.ndarray:
    """Counts of the groups."""
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)


def packed_point(s: np.ndarray, per_group: int = 8) -> bytes:
    """A point in which unrelated sets lie too far apart, in as few bytes as will do: one for its bits, one for the width of a count, the counts."""
    bits = fineness(len(s), per_group)
    counts = point(s, bits)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([bits, width]) + counts.astype(f"<u{width}").tobytes()


def unpacked_point(data: bytes) -> tuple[int, np.ndarray]:
    return data[0], np.frombuffer(data, f"<u{data[1]}", offset=2).astype(np.int32)


def folded(counts: np.ndarray, bits: int) -> np.ndarray:
    """A point at fewer bits: neighbouring groups are one."""
    return counts.reshape(1 << bits, -1).sum(axis=1, dtype=np.int32)


class RTree:
    """Points packed into leaves by size and coordinates, leaves into nodes; boxes keep upper corners and least sizes."""

    def __init__(self, points: np.ndarray):
        sizes = points.sum(axis=1)
        wide = np.argsort(points.var(axis=0) / (points.mean(axis=0) + 1), kind="stable")[::-1][:2]
        order = np.lexsort((points[:, wide[1]], points[:, wide[0]] // 4, np.log2(sizes + 1).astype(int)))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.upper = np.stack([points[x].max(axis=0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.nodes = [np.arange(i, min(i + LEAF, len(self.leaves))) for i in range(0, len(self.leaves), LEAF)]
        self.node_upper = np.stack([self.upper[x].max(axis=0) for x in self.nodes])
        self.node_least = np.array([self.least[x].min() for x in self.nodes])
        self.points, self.sizes = points, sizes

    @staticmethod
    def _meet(ua, la, ub, lb, percent) -> np.ndarray:
        """Which of several boxes (or points) ub a single one ua may reach the threshold with."""
        return np.minimum(ua, ub).sum(axis=1) * (100 + percent) >= needed(la + lb, percent)

    def join(self, other: RTree, percent: int, done=lambda x, y: False):
        """Yields (rows of self, rows of other) whose bound allows the threshold, each pair once if other is self. done(rows, rows): their pairs are not wanted."""
        own = other is self
        for i, a in enumerate(self.nodes):
            for j in np.flatnonzero(self._meet(self.node_upper[i], self.node_least[i], other.node_upper, other.node_least, percent)).tolist():
                if own and j < i:
                    continue
                for k in a.tolist():
                    b = other.nodes[j]
                    b = b[b >= k] if own else b
                    for m in b[self._meet(self.upper[k], self.least[k], other.upper[b], other.least[b], percent)].tolist():
                        x, y = self.leaves[k], other.leaves[m]
                        if done(x, y):
                            continue
                        for at, row in enumerate(x.tolist()):
                            rest = y[at + 1 :] if own and k == m else y
                            hit = rest[self._meet(self.points[row], self.sizes[row], other.points[rest], other.sizes[rest], percent)]
                            if len(hit):
                                yield np.full(len(hit), row), hit


class Groups:
    """Which sets are connected so far: a label for each, and the sets of each label. The smaller part is relabelled."""

    def __init__(self, labels: np.ndarray):
        self.labels = np.unique(labels, return_inverse=True)[1]
        self.parts = {}
        for i, x in enumerate(self.labels.tolist()):
            self.parts.setdefault(x, []).append(i)

    def connect(self, i: int, j: int) -> None:
        a, b = int(self.labels[i]), int(self.labels[j])
        if len(self.parts[a]) < len(self.parts[b]):
            a, b = b, a
        gone = self.parts.pop(b)
        self.labels[gone] = a
        self.parts[a] += gone


def trees(points: list[tuple[int, np.ndarray]], left: np.ndarray, right: np.ndarray, percent: int, done):
    """Yields (rows, rows) of the members left and right (left with itself, if right is empty) whose bound allows the threshold.

    points: bits and counts. There is a tree for each number of bits; it meets the trees of as many bits and of one more. done(rows, rows): not wanted.
    """
    cache = {}

    def tree(members: np.ndarray, own: int, bits: int):
        rows = members[[points[i][0] == own for i in members.tolist()]]
        if not len(rows):
            return None
        if (members is right, own, bits) not in cache:
            cache[members is right, own, bits] = RTree(np.stack([folded(points[i][1], bits) for i in rows.tolist()])), rows
        return cache[members is right, own, bits]

    both = right if len(right) else left
    for bits in sorted({points[i][0] for i in (*left.tolist(), *right.tolist())}):
        for x, y in ((bits, bits), (bits, bits + 1), *([(bits + 1, bits)] if len(right) else [])):
            a, b = tree(left, x, bits), tree(both, y, bits)
            if a and b:
                for p, q in a[0].join(b[0], percent, lambda u, v: done(a[1][u], b[1][v])):  # noqa: B023
                    yield a[1][p], b[1][q]


def connect(sets: list[np.ndarray], labels: np.ndarray, jobs: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that connect: pairs of sets of different labels that reach the threshold. jobs: (rows, rows) to join with each other, or with themselves if the second is empty."""
    groups, tried, links = Groups(labels), set(), []
    points = [(bits := fineness(len(s)), point(s, bits)) for s in sets]

    def one(*rows: np.ndarray) -> bool:
        found = np.concatenate([groups.labels[x] for x in rows])
        return bool((found == found[0]).all())

    for left, right in jobs:
        if one(left, right):
            continue
        for p, q in trees(points, left, right, percent, one):
            open_ = groups.labels[p] != groups.labels[q]
            for i, j in zip(p[open_].tolist(), q[open_].tolist(), strict=True):
                pair = (i, j) if i < j else (j, i)
                if groups.labels[i] == groups.labels[j] or pair in tried:
                    continue
                if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) * (100 + percent) >= needed(len(sets[i]) + len(sets[j]), percent):
                    groups.connect(i, j)
                    links.append(pair)
                else:
                    if len(tried) >= MOST_TRIED:
                        tried.clear()  # a pair may be verified again
                    tried.add(pair)
            if one(left, right):
                break
    return links


def partnered(points: list[tuple[int, np.ndarray]], jobs: list[tuple[np.ndarray, np.ndarray]], percent: int) -> np.ndarray:
    """Which points have another one in a job that the bound allows."""
    found = np.zeros(len(points), bool)

    def done(x: np.ndarray, y: np.ndarray) -> bool:
        return bool(found[x].all() and found[y].all())

    for left, right in jobs:
        if not done(left, right):
            for p, q in trees(points, left, right, percent, done):
                found[p] = found[q] = True
    return found


def dealt(jobs: DataFrame, holders: DataFrame, ddl: str, run) -> DataFrame:
    """run(ids, table of holders, jobs as rows of it) for each g of jobs (g, job, side, c); holders: of (a g), c, and what is known of c. ddl: of run's columns."""
    names = [x.split(" ")[0] for x in ddl.split(", ")]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()) for _ in names], names=names)
        if not left.num_rows or not right.num_rows:
            return none
        ids = right["c"].to_numpy()
        right, ids = right.take(pa.array(np.unique(ids, return_index=True)[1])), np.unique(ids)
        job, side, at = left["job"].to_numpy(), left["side"].to_numpy(), np.searchsorted(ids, left["c"].to_numpy())
        by = np.lexsort((at, side, job))
        cut = [by[x] for x in np.split(np.arange(len(by)), np.flatnonzero(np.diff(job[by])) + 1)]
        columns = run(ids, right, [(at[x][side[x] == 0], at[x][side[x] == 1]) for x in cut])
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in columns], names=names)

    return jobs.groupBy("g").cogroup(holders.groupBy("of")).applyInArrow(frugal_group(task), ddl)


def forest(jobs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect. jobs (g, job, side, c): the classes of a job, dealt by g; sides 0 and 1 are joined, a single side with itself. sets: c, label, elements."""
    jobs = staged(jobs, "jobs")
    holders = sets.join(to_all(staged(jobs.select(F.col("g").alias("of"), "c").distinct(), "holders")), "c").select("of", "c", "label", "elements")

    def run(ids: np.ndarray, held: pa.Table, cut: list) -> tuple[np.ndarray, np.ndarray]:
        members = [np.frombuffer(x.as_py(), np.uint64) for x in held["elements"]]
        found = np.array(connect(members, held["label"].to_numpy(), cut, percent), np.int64).reshape(-1, 2)
        return ids[found[:, 0]], ids[found[:, 1]]

    return dealt(jobs, holders, "u long, v long", run)


def survivors(jobs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(c): the classes for which a tree holds a partner within the bound. points: c, point."""
    jobs = staged(jobs, "jobs")
    holders = points.join(to_all(staged(jobs.select(F.col("g").alias("of"), "c").distinct(), "holders")), "c").select("of", "c", "point")

    def run(ids: np.ndarray, held: pa.Table, cut: list) -> tuple[np.ndarray]:
        return (ids[partnered([unpacked_point(x.as_py()) for x in held["point"]], cut, percent)],)

    return dealt(jobs, holders, "c long", run).distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(c, label, elements) of the classes wanted (c, s1, s2, doc_id: a row that holds it), stored. label: c.

    A filter on the ids goes to the documents, so only texts that are needed are hashed again and no text is shuffled.
    """
    passes = np.packbits(id_filter(wanted, wanted.count()))
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("elements", pa.binary())])

    def run(batches):
        pass_ = np.unpackbits(passes).astype(bool)
        for b in batches:
            b = b.filter(pa.array(pass_[slots(b.column(0).to_numpy(), len(pass_))]))
            for first, texts in slices(b.column(1)):
                sets = shingle_sets(texts, n)
                sigs = np.array([signature(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    found = docs.mapInArrow(frugal(run), "doc_id long, s1 long, s2 long, elements binary")
    # rows that repeat an id may repeat a set, which changes nothing
    return staged(found.join(to_all(wanted), ["doc_id", "s1", "s2"]).select("c", F.col("c").alias("label"), "elements"), "sets")


def tiled(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int, tile_rows: int, tile_elements: int) -> DataFrame:
    """More links (u, v): those of blocks that are too large for one tree. members (stored): key, c, n, m, w."""
    tiles = F.ceil(F.greatest(F.col("m") / tile_rows, F.col("w") / tile_elements))
    whole = F.lit(0).alias("side")
    alone = members.withColumn("tile", F.pmod(F.xxhash64("c"), tiles))
    job = F.xxhash64("key", "tile").alias("job")
    inside = staged(forest(alone.select(job.alias("g"), job, whole, "c"), sets, percent), "tile-links")

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members with their component, and the sets."""
        of = components(links).select(F.col("node").alias("c"), F.col("component"))
        rows = staged(alone.join(of, "c", "left").withColumn("component", F.coalesce("component", "c")), "tile-rows")
        return rows, sets.drop("label").join(of, "c", "left").select("c", F.coalesce("component", "c").alias("label"), "elements")

    # a head for each tile: the first of the tile's largest component
    rows, named = labelled(links.unionByName(inside))
    heads = rows.groupBy("key", "tile", "component").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("rows")).groupBy("key", "tile").agg(F.max_by("c", F.struct("rows", "c")).alias("c"))
    job = F.xxhash64("key", F.lit("heads")).alias("job")
    met = staged(forest(heads.select(job.alias("g"), job, whole, "c").distinct(), named, percent), "head-links")

    # what is left: tiles anew, by component; those of one component need not meet
    rows, named = labelled(links.unionByName(inside).unionByName(met))
    open_ = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(open_, "key")
    size = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    parts = F.ceil(F.greatest(F.col("rows") * 2 / tile_rows, F.col("weight") * 2 / tile_elements))
    size = size.withColumn("parts", parts).withColumn("pure", F.when(F.col("parts") > 1, F.col("component")))
    rest = size.where("pure is null").groupBy("key").agg(F.ceil(F.greatest(F.sum("rows") * 2 / tile_rows, F.sum("weight") * 2 / tile_elements)).alias("rest"))
    size = size.join(rest, "key", "left")
    at = F.when(F.col("pure").isNull(), F.xxhash64(F.lit(0), F.pmod(F.xxhash64("component"), F.col("rest")))).otherwise(F.xxhash64("pure", F.pmod(F.xxhash64("c"), F.col("parts"))))
    cut = staged(rows.join(size.select("key", "component", "pure", "parts", "rest"), ["key", "component"]).withColumn("tile", at).select("key", "tile", "pure", "c"), "tiles")
    of_key = cut.select("key", "tile", "pure").distinct()
    x, y = of_key.alias("x"), of_key.alias("y")
    meets = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") <= F.col("y.tile"))).where("x.pure is null or y.pure is null or x.pure <> y.pure")
    meets = meets.select(F.col("x.key").alias("key"), F.col("x.tile").alias("a"), F.col("y.tile").alias("b"), F.xxhash64("x.key", "x.tile", "y.tile").alias("job"))
    one = meets.join(cut, (meets.key == cut.key) & (meets.a == cut.tile)).select(meets.job.alias("g"), "job", whole, "c")
    two = meets.where("a <> b").join(cut, (meets.key == cut.key) & (meets.b == cut.tile)).select(meets.job.alias("g"), "job", F.lit(1).alias("side"), "c")
    across = staged(forest(one.unionByName(two), named, percent), "across-links")
    return inside.unionByName(met).unionByName(across)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    tile_rows: int = 4096, tile_elements: int = 1 << 22, group_elements: int = 1 << 19,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    rows = documents(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).head().bytes or 0
    bits = min(32, math.ceil(size / 6 / BUCKET).bit_length())  # a word and its space have about six bytes
    profiled = staged(profile(rows, words, bits), "profile")
    docs_of = profiled.where("kind = 0").select("doc_id", "n", "s1", "s2", "point")
    named = docs_of.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("point").alias("point"))
    classes = staged(named.withColumn("c", F.monotonically_increasing_id()), "classes")

    with_id = rows.where("doc_id is not null")
    shared = staged(blocks(keys(with_id, words, percent, bits, frequent(profiled, bits))), "blocks")
    placed = shared.join(classes.select("s1", "s2", "c", "n"), ["s1", "s2"]).select("key", "c", "n")
    marks = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min("c").alias("first"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.bit_xor(F.xxhash64("c")).alias("h1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("h2"),
    )
    # of keys with the same classes one is enough, and two classes whose sizes are too far apart are done
    wanted = marks.where((F.col("m") > 1) & ((F.col("m") > 2) | (F.col("most") * percent <= F.col("least") * 100)))
    wanted = wanted.groupBy("m", "w", "first", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m", "w", "first")
    members = staged(placed.join(wanted, "key"), "members")

    fits = (F.col("m") <= tile_rows) & (F.col("w") <= tile_elements)
    total, large = members.agg(F.sum(F.when(fits, F.col("n"))), F.coalesce(F.bool_or(~fits), F.lit(False))).head()
    groups = max(1, math.ceil((total or 0) / group_elements))
    jobs = members.where(fits).select(F.pmod(F.xxhash64("first"), F.lit(groups)).alias("g"), F.col("key").alias("job"), F.lit(0).alias("side"), "c")
    near = staged(survivors(jobs, classes.select("c", "point"), percent), "survivors")
    left = near.unionByName(members.where(~fits).select("c")).distinct() if large else near
    sets = class_sets(with_id, staged(left.join(classes.select("c", "s1", "s2", F.col("rep").alias("doc_id")), "c"), "wanted"), words)
    links = staged(forest(jobs.join(near, "c", "left_semi"), sets, percent), "links")
    if large:
        links = links.unionByName(tiled(members.where(~fits), sets, links, percent, tile_rows, tile_elements))
    final = components(links)

    of_class = classes.join(final, classes.c == final.node, "left").select("s1", "s2", "rows", "rep", "component")
    least = of_class.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = of_class.where("rows > 1 or component is not null").join(least, "component", "left").select("s1", "s2", "rows", F.coalesce("least", "rep").alias("component_id"))
    out = join_groups(docs_of, staged(of_class, "of-class"), ["s1", "s2"], "rows", docs_of.count())
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
