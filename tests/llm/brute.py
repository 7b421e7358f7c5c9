"""Brute-force versions of the pipeline's line and near-duplicate stages."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def lines_kept(texts: dict[int, str]) -> dict[int, str]:
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i in sorted(texts):
        for line in (texts[i] or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), i)
    return {i: "\n".join(x for x in (t or "").split("\n") if first.get(key(x), i) == i) for i, t in texts.items()}


def near_kept(texts: dict[int, str]) -> set[int]:
    sets, holders, label = {}, defaultdict(list), {i: i for i in texts}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            holders[s].append(i)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for j in holders[s]:
                shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i for i in texts if root(i) == i}
