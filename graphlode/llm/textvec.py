"""Hashes of all words of a batch of texts at once, with numpy.

A word's hash is a polynomial over its bytes, taken from one running sum over the whole batch and
divided by the power at its start (powers of an odd number have inverses modulo 2**64), then mixed.
Words are the runs of bytes other than the six ASCII white-space characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)  # a fixed table
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least n of them."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Sums:
    """Running sums from which the hash of any span is read. values: a number for each byte or character."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: hash, start and end of each, and `of`, where each text's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.find((_LOWER if lower else _VALUES)[data], ~WHITE[data], [len(t) for t in texts])

    def find(self, values: np.ndarray, inside: np.ndarray, sizes: list[int]) -> None:
        """Words are the runs of places inside; texts of these sizes follow each other, with one place between."""
        self.sums = Sums(values)
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = self.sums.spans(self.starts, self.ends)
        self.of = np.searchsorted(self.starts, np.cumsum([0, *(n + 1 for n in sizes)]))

    @classmethod
    def of_characters(cls, texts: list[str], letter: np.ndarray) -> Words:
        """Words of characters for which `letter` (by code point) holds; places are characters."""
        words, data = cls.__new__(cls), np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4")
        words.find(mix(data + np.uint64(_P)), letter[data], [len(t) for t in texts])
        return words

    def owner(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of all texts, and where each text's windows begin."""
    h, total = words.hashes, len(words.hashes)
    counts = np.maximum(np.diff(words.of) - n + 1, 0)
    of = np.concatenate([[0], np.cumsum(counts)])
    if total < n:
        return np.empty(0, np.uint64), of
    acc = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        acc += h[i : total - n + 1 + i] * np.uint64(pow(_P, i + 1, 2**64))
    good = np.zeros(total - n + 1, bool)
    at = np.repeat(words.of[:-1] - of[:-1], counts) + np.arange(of[-1])
    good[at] = True
    return mix(acc[good]), of


def slices(column, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Parts of an Arrow string column of about `limit` characters each (a longer text stands alone): first row, texts."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(column):
        t = text.as_py() or ""
        if texts and size + len(t) > limit:
            yield start, texts
            start, size, texts = i, 0, []
        texts.append(t)
        size += len(t)
    if texts:
        yield start, texts
