"""Language identification by words first, then by ever shorter character n-grams.

The model holds, for each known word, its smoothed log frequency in each language, and the same for the
character n-grams (5 to 1 letters) of words. A word of a text that is known is scored by its own
frequencies. An unknown one falls back to the longest n-gram length at which any of its n-grams is
known, and takes their mean. A text's language has the largest sum over its words (of equal sums, the first name); the score is its
posterior share under equal priors, with the mean word's evidence counted `evidence` times.

Words are runs of letters of any alphabet and of the marks that combine with them, lower-cased. Words and n-grams are
known if the sample holds them `least` times; all of these are in the model, by 64-bit hashes. It is learned from at most `sample`
rows of each language (those with the smallest hash of the id), which is what bounds its size.

Defined results: a null text, a text without a letter, and any text when nothing could be learned are `und`
with score 0. Rows without language or id teach nothing. Rows that repeat an id are predicted one by one, and all teach if one does.

Beside these, `identify` tells how many words a text has and which share of them the model knows (coverage). `coverage_floor`
gives the least coverage of a text in a learned language; texts of fewer than `MIN_WORDS` words have too little evidence for it.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, staged
from .textvec import Words, slices

UNDETERMINED = "und"
#: Fewer words tell nothing by their coverage. A lesser coverage speaks of no learned language, if KEEP_SHARE of held-out labelled rows reach it.
MIN_WORDS, LEAST_COVERAGE, KEEP_SHARE = 20, 0.2, 0.995
GRAMS = (5, 4, 3, 2, 1)
#: Words and n-grams that a task holds counts of before it sends them on.
HELD = 1 << 19


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    words: np.ndarray  # sorted hashes
    word_logs: np.ndarray  # a row for each hash, a column for each language
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # the same by length


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted hashes in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it is one or a mark that combines with letters."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


def _lowered(texts: list[str]) -> Words:
    return Words.of_characters([t.lower() for t in texts], letters()[1])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _spans(words: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character windows of the words numbered `which`, and the place in `which` each belongs to."""
    counts = np.maximum(words.ends[which] - words.starts[which] - n + 1, 0)
    owner = np.repeat(np.arange(len(which)), counts)
    if not len(owner):
        return np.empty(0, np.uint64), owner
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = words.starts[which][owner] + inside
    return words.sums.spans(starts, starts + n), owner


class Tally:
    """Counts by kind (0 words, else the length of n-grams), language and hash, as arrays."""

    def __init__(self):
        self.counts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, kind: int, lang: int, hashes: np.ndarray, times: np.ndarray) -> None:
        if len(hashes):
            self.counts.setdefault((kind, lang), []).append((hashes, times))
            self.size += len(hashes)

    def texts(self, texts: list[str], langs: np.ndarray) -> None:
        """The words of texts and the n-grams of these, counted for each distinct word once."""
        words = _lowered(texts)
        of_word = langs[words.owner()]
        for lang in np.unique(of_word).tolist():
            at = np.flatnonzero(of_word == lang)
            hashes, first, times = np.unique(words.hashes[at], return_index=True, return_counts=True)
            self.add(0, lang, hashes, times)
            for n in GRAMS:
                found, owner = _spans(words, at[first], n)
                self.add(n, lang, *_summed(found, times[owner]))

    def merge(self) -> None:
        self.counts = {k: [_summed(*map(np.concatenate, zip(*v, strict=True)))] for k, v in self.counts.items()}
        self.size = sum(len(v[0][0]) for v in self.counts.values())

    def batch(self, n_langs: int) -> pa.RecordBatch:
        """kind, hash, and a count for each language; what was held is let go."""
        self.merge()
        rows = [(kind, lang, h, t) for (kind, lang), [(h, t)] in self.counts.items()]
        columns = [pa.array(np.concatenate([np.full(len(h), kind) for kind, _, h, _ in rows])), pa.array(np.concatenate([h for _, _, h, _ in rows]).view(np.int64))]
        columns += [pa.array(np.concatenate([t if lang == j else np.zeros(len(h), np.int64) for _, lang, h, t in rows])) for j in range(n_langs)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["kind", "hash", *(f"n{j}" for j in range(n_langs))])


def _summed(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(of, weights=times, minlength=len(keys)).astype(np.int64)


def sampled(usable: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang): the `sample` rows of each language with the smallest hash of the id.

    Counts give a bound on the hash that about twice as many rows reach; only these are ordered, so no task holds a language's rows.
    """
    ids = usable.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().collect()}
    scale = 2.0
    while True:
        bounds = [(k, int(min(1.0, scale * sample / n) * 2**64) - 2**63) for k, n in counts.items()]
        below = ids.sparkSession.createDataFrame([(k, min(b, 2**63 - 1)) for k, b in bounds], "lang string, most long")
        near = staged(ids.join(F.broadcast(below), "lang").where("h <= most").select("doc_id", "lang", "h"), "sample")  # a row for each language
        held = {r.lang: r["count"] for r in near.groupBy("lang").count().collect()}
        if all(held.get(k, 0) >= min(sample, n) for k, n in counts.items()):
            break
        scale *= 4
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("at", place).where(F.col("at") <= sample).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, sample: int = 4_000, least: int = 2) -> LanguageModel:
    """docs: doc_id, text, lang (rows to learn from)."""
    usable = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    names = sorted(r[0] for r in usable.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], np.empty(0, np.uint64), np.empty((0, 0)), {})
    number, k = {n: i for i, n in enumerate(names)}, len(names)
    chosen = usable.join(F.broadcast(sampled(usable, sample)), ["doc_id", "lang"]).select("text", "lang")  # at most sample ids a language

    def count(batches):
        tally = Tally()
        for b in batches:
            langs = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for first, texts in slices(b.column(0)):
                tally.texts(texts, langs[first : first + len(texts)])
                if tally.size > HELD:
                    tally.merge()
                    if tally.size > HELD // 2:
                        yield tally.batch(k)
        if tally.size:
            yield tally.batch(k)

    per_lang = [f"n{j}" for j in range(k)]
    counts = chosen.mapInArrow(frugal(count), "kind long, hash long, " + ", ".join(f"{c} long" for c in per_lang)).groupBy("kind", "hash").agg(*(F.sum(c).alias(c) for c in per_lang))
    counts = staged(counts, "language-counts")
    totals = {r.kind: np.array([r[c] for c in per_lang]) for r in counts.groupBy("kind").agg(*(F.sum(c).alias(c) for c in per_lang)).collect()}
    found = counts.where(sum((F.col(c) for c in per_lang), F.lit(0)) >= least).toArrow()
    kinds, hashes, matrix = found["kind"].to_numpy(), found["hash"].to_numpy().view(np.uint64), np.stack([found[c].to_numpy() for c in per_lang], axis=1)

    def table(kind: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(kinds == kind)
        at = at[np.argsort(hashes[at])]
        logs = np.log(matrix[at] + 0.5) - np.log(totals.get(kind, np.zeros(k)) + 0.5 * (len(at) + 1))
        return hashes[at], logs.astype(np.float32)

    words, logs = table(0)
    return LanguageModel(names, words, logs, {n: table(n) for n in GRAMS})


def score_texts(model: LanguageModel, texts: list[str], evidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language, posterior share (-1 and 0 if it has no words), number of words and share of known ones for each text."""
    words, k = _lowered(texts), len(model.languages)
    n_words, owner = np.diff(words.of), words.owner()
    evidence_of = np.zeros((len(words.hashes), k))
    at, known = _find(model.words, words.hashes)
    evidence_of[known] = model.word_logs[at[known]]
    coverage = np.bincount(owner, weights=known, minlength=len(texts)) / np.maximum(n_words, 1)
    left = np.flatnonzero(~known)
    for n in GRAMS:
        if not len(left):
            break
        keys, logs = model.grams[n]
        hashes, of = _spans(words, left, n)
        at, hit = _find(keys, hashes)
        hits = np.bincount(of[hit], minlength=len(left))
        sums = np.stack([np.bincount(of[hit], weights=logs[at[hit], j], minlength=len(left)) for j in range(k)], axis=1)
        got = hits > 0
        evidence_of[left[got]] = sums[got] / hits[got, None]
        left = left[~got]
    sums = np.stack([np.bincount(owner, weights=evidence_of[:, j], minlength=len(texts)) for j in range(k)], axis=1)
    mean = sums / np.maximum(n_words, 1)[:, None] * np.minimum(n_words, evidence)[:, None]
    share = np.exp(mean - mean.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    return np.where(n_words > 0, best, -1), np.where(n_words > 0, share[np.arange(len(texts)), best], 0.0), n_words, coverage


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", evidence: float = 20.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, n_words, coverage for each row, and a struct `row` of the columns named in keep."""
    rest = [F.struct(*keep).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *rest)

    carried = ["row"] if keep else []

    def run(batches):
        for b in batches:
            langs, scores, counts, known = [], [], [], []
            for _, texts in slices(b.column("text")):
                if model.languages:
                    best, share, n_words, coverage = score_texts(model, texts, evidence)
                else:
                    best, share, n_words, coverage = np.full(len(texts), -1), np.zeros(len(texts)), np.diff(_lowered(texts).of), np.zeros(len(texts))
                counts.extend(n_words)
                known.extend(coverage)
                for text, i, s in zip(texts, best, share, strict=True):
                    ok = i >= 0 and has_letter(text)
                    langs.append(model.languages[i] if ok else UNDETERMINED)
                    scores.append(float(s) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(known, pa.float64()), *(b.column(c) for c in carried)], names=["doc_id", "lang_pred", "score", "n_words", "coverage", *carried])

    ddl = "doc_id long, lang_pred string, score double, n_words long, coverage double"
    if rest:
        ddl += f", row {rows.schema['row'].dataType.simpleString()}"
    return rows.mapInArrow(frugal(run), ddl)


def coverage_floor(held: DataFrame, model: LanguageModel) -> float:
    """The least coverage of a text in a learned language: LEAST_COVERAGE, or less where KEEP_SHARE of the labelled rows of held (doc_id, text, lang) do not reach that; 0 if there are none.

    All rows count. Only coverages below LEAST_COVERAGE can move the floor, and of these only those of the bin that holds the quantile are read one by one.
    """
    usable = held.where("text is not null and doc_id is not null").where(F.col("lang").isin(model.languages))
    told = staged(identify(usable, model).where(F.col("n_words") >= MIN_WORDS).select("coverage"), "coverage")
    n = told.count()
    if not n:
        return 0.0
    left = max(1, math.ceil(round((1 - KEEP_SHARE) * n, 6)))  # the place of the quantile, from 1
    per_bin = F.floor(F.col("coverage") * 1000).alias("bin")
    for r in told.where(F.col("coverage") < LEAST_COVERAGE).groupBy(per_bin).count().orderBy("bin").collect():  # at most 200 rows
        if left > r["count"]:
            left -= r["count"]
            continue
        for value in told.where(per_bin == r.bin).where(F.col("coverage") < LEAST_COVERAGE).groupBy("coverage").count().orderBy("coverage").toLocalIterator():
            left -= value["count"]
            if left <= 0:
                return value.coverage
    return LEAST_COVERAGE


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the rows that teach nothing: the CRC-32 of the id in decimal is a multiple of `folds`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows that are not held out, applied to all."""
    teach = docs.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(teach, **params)
    return identify(docs, model, id_col, text_col).withColumn("held_out", held_out("doc_id"))
