import zlib
from hashlib import sha256

import pytest

from graphlode.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in groups[name]])
    top = climb([trees[n][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at, folded, proof = i, leaf(r, int(tampered)), []
            for levels, start in ((trees[name], i), (top, g)):
                at = start
                for nodes in levels[:-1]:
                    run = nodes[at - at % 2 : at - at % 2 + 2]
                    proof += [x for k, x in enumerate(run) if k != at % 2]
                    run[at % 2] = folded
                    folded = digest("".join(run))
                    at //= 2
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[name][-1][0], root, digest("".join(proof)), folded, folded == root))
    return sorted(out, key=repr)


def result(docs, step):
    m = merkle.manifest(merkle.document_leaves(docs), ["doc_id"], step=step)
    return sorted(map(tuple, merkle.audit(m, "doc_id", "claim").collect()), key=repr)


@pytest.mark.parametrize("step", [3, 10])
def test_equals_brute_force(docs, corpus, step):
    got = result(docs, step)
    assert got == brute([r[:5] for r in corpus])
    assert {x[-1] for x in got} == {True, False}


def test_null_ids_and_repeated_rows(spark, odd_docs):
    assert result(odd_docs, 2) == brute([tuple(r)[:5] for r in odd_docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_small_trees(spark, n):
    rows = [(i, f"t{i}", None, "s", i) for i in range(n)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 1) == brute(rows)


def test_one_lone_group_beside_another(spark):
    rows = [(1, "a", "x", None, None), *((i, "b", "y", "s", 3) for i in range(2, 8)), (9, None, None, "s", 0)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 2) == brute(rows)


def test_a_third_of_the_rows_equal(spark):
    rows = [(5, "same", "x", "s", 4)] * 40 + [(i, f"t{i}", "x", "s", 2) for i in range(80)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), 3) == brute(rows)


def test_empty_table(no_docs):
    assert result(no_docs, 10) == []
