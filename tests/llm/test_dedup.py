import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphlode.llm.common import join_groups
from graphlode.llm.components import components
from graphlode.llm.exact_dedup import FuseFilter, exact_duplicates
from graphlode.llm.line_dedup import dedup_lines
from graphlode.llm.ngram_join import REST, RTree, connect, counted, fineness, folded, near_duplicates, pack, packed_point, partnered, point, prefix_length, shingle_sets, unpack, unpacked_point

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 60_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    f = FuseFilter.build(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(n + 1).integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.001 or n < 2
    assert n < 10_000 or len(f.cells) < 1.35 * n


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_duplicates(docs, corpus, batches):
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        groups[text or ""].append(doc_id)
    got = {r.doc_id: r for r in exact_duplicates(docs, batches=batches, bucket_keys=10).collect()}
    assert len(got) == len(corpus)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


def test_exact_duplicates_odd_rows(odd_docs, no_docs):
    rows = exact_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r.kept or r.doc_id == r.keep_id for r in rows)
    assert exact_duplicates(no_docs).count() == 0


def brute_lines(rows):
    keys = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(keys(line)) >= 10:
                holders[keys(line)].add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if min(holders.get(keys(x), {doc_id})) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(docs, corpus, batches, fanout):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs, batches=batches, fanout=fanout, keep=("lang",)).collect()}
    assert got == brute_lines([(r[0], r[1]) for r in corpus])
    assert sum(v[1] for v in got.values()) > 10


def test_line_dedup_odd_rows(odd_docs, no_docs):
    assert dedup_lines(odd_docs).count() == odd_docs.count()
    assert dedup_lines(no_docs).count() == 0


def test_lines_of_rows_without_id(spark):
    line = "a line that all documents hold"
    rows = [(None, f"{line}\nonly {i} of these rows has this") for i in range(12)]
    got = [(r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(x[:2] for x in got) == [(2, 0)] + [(2, 1)] * 11 and {x[2].split("\n")[-1] for x in got} == {r[1].split("\n")[1] for r in rows}
    last = 2**63 - 1
    mixed = spark.createDataFrame([*rows, (last, line.upper()), (7, "short")], "doc_id long, text string")
    assert sum(r.n_dropped for r in dedup_lines(mixed).collect()) == 12
    assert [r.kept_text for r in dedup_lines(mixed).where(f"doc_id = {last}").collect()] == [line.upper()]


@pytest.mark.parametrize("share", [2, 10_000])
def test_groups_of_any_share_are_joined_alike(spark, share):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i // 4}", None if i % 5 else "x") for i in range(300)], "id long, k string, v string")
    groups = rows.groupBy("k").count().where("count > 1").cache()
    got = join_groups(rows, groups, ["k"], "count", rows.count(), share)
    want = rows.join(groups, "k", "left")
    assert got.columns == want.columns and sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_a_third_of_all_rows_equal(spark):
    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text number {i} of its own") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(docs).collect()}
    assert got == {i: ((2997, 1000) if i % 3 == 0 else (i, 1)) for i, _ in rows}


def brute_near(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    want = brute_near([(r[0], r[1]) for r in corpus])
    assert got == want
    assert max(Counter(v[1] for v in want.values()).values()) > 6


def test_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_near(list(enumerate(t for i, t in rows if i is not None)))
    ids = [i for i, _ in rows if i is not None]
    reached = defaultdict(list)
    for at, (_, label) in want.items():
        reached[label].append(ids[at])
    named = sorted((ids[at], n, min(reached[label])) for at, (n, label) in want.items())
    got = near_duplicates(odd_docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == named
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 5
    assert near_duplicates(no_docs).count() == 0


def test_rows_that_repeat_an_id_are_nodes_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 1), (2, 2), (3, 2)]


def test_prefix_is_long_enough():
    for n in range(1, 300):
        least = -(-80 * n // 100)  # any partner shares at least this many
        assert prefix_length(n, 80) == n - least + 1


def test_shingles_count_words_as_the_pattern_does():
    texts = ["", "a", "a b c d e f", "A\x0bB\x1cC d e", "É é É é É é É"]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        w = WORD.findall(t.translate(LOWER))
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else bool(w))


def test_rtree_loses_no_pair():
    points = np.random.default_rng(5).integers(0, 12, (3000, 64))
    points[1500:] = points[:1500] + np.random.default_rng(6).integers(0, 2, (1500, 64))
    t = RTree(points[:2900])
    got = {(min(a, b), max(a, b)) for p, q in t.join(t, 80) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    other = RTree(points[2900:])
    got |= {(a, 2900 + b) for p, q in t.join(other, 80) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    got |= {(2900 + min(a, b), 2900 + max(a, b)) for p, q in other.join(other, 80) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    for a in range(0, 3000, 10):
        bound = np.minimum(points[a], points).sum(1) * 180 >= 80 * (points[a].sum() + points.sum(1))
        assert {b for b in range(a + 1, 3000) if bound[b]} == {b for x, b in got if x == a}


def near_sets(n: int) -> list[np.ndarray]:
    """Groups of near copies, and sets that are near none."""
    rng, out = np.random.default_rng(9), []
    for i in range(n):
        if i % 10 == 0:
            base = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 300)), dtype=np.uint64) * 2)
        out.append(base[rng.random(len(base)) < 0.93] if i % 10 else base)
    return [s for s in out if len(s)]


def test_connect_finds_the_components():
    sets = near_sets(200)
    every, none = np.arange(len(sets)), np.empty(0, np.int64)
    want = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(np.intersect1d(a, b)) * 180 >= 80 * (len(a) + len(b)):
                want[want == want[i]] = want[j]
    for jobs in ([(every, none)], [(every[:90], none), (every[90:], none), (every[:90], every[90:])]):
        links = connect(sets, every, jobs, 80)
        label = np.arange(len(sets))
        for i, j in links:
            assert label[i] != label[j]
            label[label == label[i]] = label[j]
        assert len(np.unique(label)) == len(np.unique(want)) == len({*zip(label.tolist(), want.tolist(), strict=True)})


def test_connect_verifies_copies_in_proportion_to_their_number(monkeypatch):
    base = np.unique(np.random.default_rng(1).integers(0, 2**63, 400, dtype=np.uint64) * 2)
    sets, calls, real = [np.delete(base, i) for i in range(300)], [], np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *a, **b: calls.append(1) or real(*a, **b))
    every = np.arange(300)
    assert len(connect(sets, every, [(every, np.empty(0, np.int64))] * 50, 80)) == 299
    assert len(calls) == 299


def test_large_blocks_are_tiled(spark, docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    for i in range(60):  # some near copies, some too far from all
        words = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[k] = f"x{i}-{k}"
        rows.append((1000 + i, " ".join(words)))
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(small, tile_rows=5, tile_elements=500, group_elements=500).collect()}
    assert got == brute_near(rows)


def test_points_bound_overlaps():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * 2) for n in (10, 300, 600, 2500, 9000)]
    sets += [s[: int(len(s) * 0.9)] for s in sets]
    for bits in range(6, 13):
        points = [point(s, bits) for s in sets]
        for a, p in zip(sets, points, strict=True):
            for b, q in zip(sets, points, strict=True):
                assert np.minimum(p, q).sum() >= len(np.intersect1d(a, b))
    assert [fineness(n) for n in (1, 64, 65, 4096, 10**6)] == [6, 6, 7, 12, 12]
    for s in sets:
        bits, counts = unpacked_point(packed_point(s))
        assert bits == fineness(len(s), 8) and (counts == point(s, bits)).all() and (folded(counts, 6) == point(s, 6)).all()
    assert all(fineness(-(-n * 100 // 80), k) - fineness(n, k) <= 1 for n in range(1, 9000) for k in (1, 8))


def test_partnered_loses_none():
    sets = [*near_sets(199), np.unique(np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64))]
    points, every = [unpacked_point(packed_point(s)) for s in sets], np.arange(len(sets))
    cut = [(every[:90], every[:0]), (every[90:], every[:0]), (every[:90], every[90:])]
    got = partnered(points, cut, 80)
    for i, a in enumerate(sets):
        assert got[i] or not any(len(np.intersect1d(a, b)) * 180 >= 80 * (len(a) + len(b)) for j, b in enumerate(sets) if i != j)
    assert not got[-1]


def test_packed_counts():
    values = np.array([0, 1, 5, 2**32 - 1, 7], np.uint32)
    assert (unpack(pack(values)) == values).all() and not len(unpack(pack(values[:0])))
    s = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64, endpoint=False)
    s = np.concatenate([s, s[:100], s[:10]])
    for bits in (0, 1, 5):
        want = Counter((s >> np.uint64(64 - REST - bits)).tolist())
        got = {}
        for bucket, gaps, times in counted(s, bits):
            got |= {(bucket << REST) + int(v): int(t) for v, t in zip(np.cumsum(unpack(gaps), dtype=np.uint32), unpack(times), strict=True)}
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 50)] + [(100, 200), (200, 300), (300, 100), (7, 7), (8, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 51)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([(7, 7)], "u long, v long")).count() == 0


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    from graphlode.llm import components as module

    steps, real = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: steps.append(name) or real(df, name))
    chain = spark.range(10_000).selectExpr("id as u", "id + 1 as v")
    assert module.components(chain).groupBy("component").count().collect() == [(0, 10_001)]
    assert len(steps) <= 20


def test_batches_merge_by_verified_positives(spark, docs, monkeypatch):
    from graphlode.llm import exact_dedup

    columns = ("doc_id", "keep_id", "group_size", "kept")
    whole = {tuple(r) for r in exact_dedup.exact_duplicates(docs, batches=1).select(*columns).collect()}
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs, batches=4).select(*columns).collect()} == whole
    monkeypatch.setattr(exact_dedup, "screen", lambda incoming, filters: incoming.where("false"))
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs, batches=4).select(*columns).collect()} != whole
