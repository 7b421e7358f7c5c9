"""Quality rules and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into `buckets`. Two multinomials over the buckets are estimated, each with one
added to every count: of the trusted target (labelled documents of good quality that are not toxic) and of the
raw corpus (all documents). A document's score is the mean log ratio of the two over its
n-grams; it is kept if the score reaches a threshold and no base rule fails it. Nothing is drawn at random.

All documents give the raw counts, all trusted ones the target, and all labelled ones that pass the base rules the threshold: the
score between the trusted and the others (poor or toxic) that gives the best balance of recalls, moved
down, if need be, to where `keep_share` of the trusted documents stay. Of texts only those are shuffled that a filter of trusted ids
lets through; scores are ranked by ranges.

Where there are no labelled documents of both kinds the base rules alone decide. Null and empty texts have no
words and fail the base rule. Labels without id or quality are not used, and a null toxic counts as 0. Of clashing labels of one id the worse
counts: the least quality and the largest toxic. Rows that repeat an id are judged one by one, and each of them teaches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, frugal, staged
from .idfilter import id_filter, slots
from .textvec import Words, slices, windows

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50

BASE_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class QualityModel:
    log_ratio: np.ndarray
    threshold: float


def _buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs, and the text each belongs to."""
    pairs, of = windows(words, 2)
    grams = np.concatenate([words.hashes, pairs])
    owner = np.concatenate([words.owner(), np.repeat(np.arange(len(of) - 1), np.diff(of))])
    return (grams % np.uint64(buckets)).astype(np.int64), owner


def _repeated(words: Words) -> np.ndarray:
    """For each text, the words that lie in a 3-word window found twice or more in it."""
    grams, of = windows(words, 3)
    out = np.zeros(len(of) - 1, np.int64)
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]  # windows by position
    first = hit - of[owner[hit]] + words.of[owner[hit]]
    covered = np.zeros(len(words.hashes), bool)
    for k in range(3):
        covered[first + k] = True
    at = np.concatenate([[0], np.cumsum(covered)])
    out[:] = at[words.of[1:]] - at[words.of[:-1]]
    return out


def base_counts(texts: list[str], words: Words) -> dict[str, list[int]]:
    chars = [len(t) - sum(map(t.count, WHITE)) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    dups = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        dups.append(len(lines) - len(set(lines)))
    return {"n_words": np.diff(words.of), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": _repeated(words)}


def gram_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all n-grams of docs (text) by bucket: summed in each task, then in two steps."""

    def count(batches):
        total, seen = np.zeros(buckets, np.int64), False
        for b in batches:
            for _, texts in slices(b.column(0)):
                grams, _ = _buckets(Words([t.encode() for t in texts]), buckets)
                total += np.bincount(grams, minlength=buckets)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]}, schema=pa.schema([("counts", pa.binary())]))

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]}, schema=pa.schema([("counts", pa.binary())]))

    parts = staged(docs.select("text").mapInArrow(frugal(count), "counts binary"), "gram-counts")
    n = parts.count()
    while n > 64:  # a vector of fixed size for each task, so few are left for the driver
        n = -(-n // 64)
        parts = staged(parts.repartition(n).mapInArrow(frugal(add), "counts binary"), "gram-counts")
    return sum((np.frombuffer(r[0], np.int64) for r in parts.collect()), np.zeros(buckets, np.int64))


def score_documents(docs: DataFrame, log_ratio: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and score of each row of docs (doc_id, text, ...), and the columns named in keep."""
    buckets = len(log_ratio)

    def run(batches):
        for b in batches:
            columns = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            scores = []
            for _, texts in slices(b.column("text")):
                words = Words([t.encode() for t in texts])
                for k, v in base_counts(texts, words).items():
                    columns[k].extend(v)
                grams, owner = _buckets(words, buckets)
                n = np.bincount(owner, minlength=len(texts))
                scores.extend(np.bincount(owner, weights=log_ratio[grams], minlength=len(texts)) / np.maximum(n, 1))
            arrays = [b.column(c) for c in ("doc_id", *keep)] + [pa.array(np.asarray(v, np.int64)) for v in columns.values()] + [pa.array(np.asarray(scores, np.float64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *keep, *columns, "score"])

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(frugal(run), f"doc_id long{extra}, {BASE_DDL}, score double")


def threshold_of(good: np.ndarray, bad: np.ndarray, keep_share: float) -> float:
    """The cut with the best sum of recalls, in the middle of its gap; at most the score that keep_share of the good reach. `exact_threshold` finds it on tables."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    gone = np.searchsorted(np.sort(bad), cuts) / len(bad)
    best = int(np.argmax(kept + gone))
    cut = cuts[best] if best == 0 else (cuts[best] + cuts[best - 1]) / 2
    return float(min(cut, np.quantile(good, 1 - keep_share)))


def exact_threshold(scored: DataFrame, keep_share: float) -> float:
    """threshold_of over a table (trusted boolean, score double) of any size: scores are counted, ranked by ranges, and a few rows come to the driver."""
    good, bad = (F.sum((F.col("trusted") == t).cast("long")) for t in (True, False))
    counted = scored.groupBy("score").agg(good.alias("good"), bad.alias("bad")).repartitionByRange("score").withColumn("part", F.spark_partition_id())
    counted = staged(counted, "score-counts")
    n_good = n_bad = 0
    starts = []
    for r in counted.groupBy("part").agg(F.sum("good"), F.sum("bad")).orderBy("part").collect():  # a row for each range
        starts.append((r[0], n_good, n_bad))
        n_good, n_bad = n_good + r[1], n_bad + r[2]
    if not n_good or not n_bad:
        return -np.inf
    before = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = [F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"{c}_start") for c in ("good", "bad")]
    of_part = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, good_start long, bad_start long"))
    ranked = staged(counted.join(of_part, "part").select("score", "good", below[0].alias("good_below"), below[1].alias("bad_below")), "score-ranks")
    # the sum of recalls less one, times both counts: exact, where sums of shares are rounded
    gain = F.col("bad_below").cast("decimal(19,0)") * n_good - F.col("good_below").cast("decimal(19,0)") * n_bad
    cut = ranked.agg(F.min_by("score", F.struct(-gain, "score"))).head()[0]
    last = ranked.where(F.col("score") < F.lit(cut)).agg(F.max("score")).head()[0]
    place = (n_good - 1) * (1 - keep_share)
    ranks = [int(place), min(int(place) + 1, n_good - 1)]
    at = [ranked.where((F.col("good_below") <= r) & (F.col("good_below") + F.col("good") > r)).head()[0] for r in ranks]
    floor = at[0] + (at[1] - at[0]) * (place - ranks[0])
    return float(min(cut if last is None else (cut + last) / 2, floor))


def base_failed(n_words="n_words", n_repeat="n_repeat_words"):
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > REPEAT_PERCENT * F.col(n_words))


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text of the rows of docs whose doc_id is in ids (stored, distinct): what a filter rules out is not shuffled.

    The join is a merge at any size, so that its reader's Python and the filter's are of two stages: in one, each core would have two workers, which live on.
    """
    passes = np.packbits(id_filter(ids, ids.count()))

    def sift(batches):
        wanted = np.unpackbits(passes).view(bool)
        for b in batches:
            keys = b.column("doc_id")
            found = wanted[slots(keys.fill_null(0).to_numpy(zero_copy_only=False), len(wanted))] & keys.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(found))

    return docs.select("doc_id", "text").mapInArrow(frugal(sift), "doc_id long, text string").join(ids.hint("merge"), "doc_id").select("text")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, keep_share: float = 0.995) -> tuple[QualityModel, DataFrame]:
    """The model, and base counts and score of each row (stored). docs: doc_id, text. labels: doc_id, quality, toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = staged(known.where("quality in (0, 1)").selectExpr("doc_id", "quality = 1 and coalesce(toxic, 0) = 0 as trusted"), "known")
    target, raw = gram_counts(with_ids(docs, known.where("trusted").select("doc_id")), buckets), gram_counts(docs, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    scored = staged(score_documents(docs, ratio), "scored")
    judged = scored.where(~base_failed()).select("doc_id", "score").join(known, "doc_id").select("trusted", "score")
    return QualityModel(ratio, exact_threshold(judged, keep_share)), scored


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **params) -> DataFrame:
    """doc_id, base counts, base_failed, score, kept for each row; `keep` names columns of docs to carry along."""
    model, out = fit(documents(docs, id_col, text_col), labels, **params)
    if keep:  # texts that are carried along are scored again, not joined
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*keep).alias("row"))
        out = score_documents(rows, model.log_ratio, ("row",))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
