"""Exact deduplication with binary-fuse filters over immutable snapshots.

The corpus is taken in as batches. Duplicates inside a new batch are grouped by digest
(pre-aggregated, so a group with a third of all rows is combined before the shuffle). The distinct
digests of the batch are then screened by the filter of every earlier snapshot: a static
binary-fuse filter of 16 bits a key for each digest bucket. Only positives join the snapshot's exact
bucket, and what joins has its texts compared. A group whose text is in a snapshot joins the group there; the
others are new groups and become a snapshot themselves, with filters built from them. Groups of
different batches are merged in no other way.

Sizes: a bucket holds about ``bucket_keys`` distinct digests whatever the input's size (the number of
buckets follows the count), digests are uniform, and copies are gone before dealing, so no bucket is hot.

Defined results: null text equals the empty text; of equal texts the row with the largest id stays (a
null id is below all others; rows that repeat the largest id of a group all stay).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, join_groups, staged
from .idfilter import id_filter, slots

#: The most bits of the filter of ids whose texts are compared: 4 MB, wide enough for two million pairs.
FILTER_BITS = 1 << 25

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class FuseFilter:
    """A 3-wise binary-fuse filter of 16-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, cells: np.ndarray):
        self.seed, self.segment, self.cells = seed, segment, cells

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, ...]:
        # three neighbouring segments; the first is drawn by the high bits, places inside by others
        first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
        base = first.astype(np.int64) * segment
        m = np.uint64(segment - 1)
        return tuple(base + j * segment + ((h >> np.uint64(s)) & m).astype(np.int64) for j, s in enumerate((0, 9, 18)))

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h * _MIX[1]) >> np.uint64(48)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels the 3-uniform hypergraph of all keys, a round of free cells at a time."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        for seed in range(200):
            segments = max(3, math.ceil(n * factor / segment) + 2)
            cells = np.zeros(segments * segment, np.uint16)
            h = _mixed(keys, seed)
            order = cls._peel(cls._places(h, segment, segments), len(cells), len(keys))
            if order is None:
                factor *= 1.02  # rare; a slightly larger table and another seed
                continue
            places, prints = cls._places(h, segment, segments), cls._prints(h)
            for k, slot in reversed(order):
                v = prints[k]
                for p in places:
                    at = p[k]
                    v = v ^ np.where(at == slot, np.uint16(0), cells[at])
                cells[slot] = v
            return cls(seed, segment, cells)
        raise RuntimeError("no binary-fuse filter found")

    @staticmethod
    def _peel(places, size: int, n: int):
        """Rounds of (keys, their free cells) until no key is left; None if a core stays."""
        degree, held = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ids = np.arange(n, dtype=np.int64)
        for p in places:
            np.add.at(degree, p, 1)
            np.bitwise_xor.at(held, p, ids)
        rounds, left = [], n
        free = np.flatnonzero(degree == 1)
        while left and len(free):
            free = free[degree[free] == 1]
            k, first = np.unique(held[free], return_index=True)
            if not len(k):
                break
            rounds.append((k, free[first]))
            left -= len(k)
            touched = []
            for p in places:
                np.subtract.at(degree, p[k], 1)
                np.bitwise_xor.at(held, p[k], k)
                touched.append(p[k])
            free = np.unique(np.concatenate(touched))
            free = free[degree[free] == 1]
        return None if left else rounds

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys.astype(np.uint64), self.seed)
        a, b, c = self._places(h, self.segment, len(self.cells) // self.segment)
        return self.cells[a] ^ self.cells[b] ^ self.cells[c] == self._prints(h)


def _as_key(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(), dtype=np.int64).view(np.uint64)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """One row for each bucket of a snapshot (bucket, key): bucket, seed, segment, cells."""

    def build(table: pa.Table) -> pa.Table:
        f = FuseFilter.build(_as_key(table["key"]))
        return pa.table({"bucket": [table["bucket"][0].as_py()], "seed": [f.seed], "segment": [f.segment], "cells": [f.cells.tobytes()]}, schema=pa.schema([("bucket", pa.int64()), ("seed", pa.int64()), ("segment", pa.int64()), ("cells", pa.binary())]))

    return snapshot.select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket long, seed long, segment long, cells binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming (bucket, key, digest, ...) rows that the bucket's filter does not exclude."""
    names = incoming.columns

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0).select(names)
        f = FuseFilter(right["seed"][0].as_py(), right["segment"][0].as_py(), np.frombuffer(right["cells"][0].as_py(), np.uint16))
        return left.filter(pa.array(f.contains(_as_key(left["key"])))).select(names)

    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, incoming.schema)


def with_equal_texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """digest, home: the least snapshot in which the text of pairs' (digest, rep, old_rep, home) rep is, byte by byte, that of old_rep.

    A filter on the ids goes to the rows, so texts that no pair names are not shuffled.
    """
    at = F.coalesce("doc_id", F.lit(-1)).alias("at")  # a representative without id is found by its digest
    ids = pairs.select("digest", "home", F.explode(F.array("rep", "old_rep")).alias("doc_id")).select("digest", "home", at).distinct()
    passes = np.packbits(id_filter(ids.select(F.col("at").alias("doc_id")), pairs.count(), FILTER_BITS))

    def run(batches):
        pass_ = np.unpackbits(passes).astype(bool)
        for b in batches:
            yield b.filter(pa.array(pass_[slots(b.column(0).to_numpy(), len(pass_))]))

    needed = rows.select(at, "text").mapInArrow(run, "at long, text string")
    texts = needed.withColumn("digest", F.sha2("text", 256)).join(ids.hint("merge"), ["at", "digest"])
    same = texts.groupBy("digest", "home").agg((F.min("text") == F.max("text")).alias("same")).where("same")
    return same.groupBy("digest").agg(F.min("home").cast("long").alias("home"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, bucket_keys: int = 50_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_length.

    docs are taken in as `batches` batches, dealt by a hash of the id.
    """
    rows = documents(docs, id_col, text_col)
    digested = staged(rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("text_length")), "digests")
    batch_of = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(batches))
    n_rows = digested.count()
    buckets = max(1, math.ceil(n_rows / bucket_keys))

    groups = (
        digested.groupBy(batch_of.alias("batch"), "digest")
        .agg(F.max("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("key", F.xxhash64("digest"))
        .withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(buckets)))
    )
    groups = staged(groups, "batch-groups")
    snapshots, homes = [groups.where(F.col("batch") == 0)], []
    for b in range(1, batches):
        incoming = groups.where(F.col("batch") == b)
        positives = []
        for s, snapshot in enumerate(snapshots):
            passed = screen(incoming.select("bucket", "key", "digest", "rep"), build_filters(snapshot))
            positives.append(passed.join(snapshot.select("digest", F.col("rep").alias("old_rep")), "digest").select("digest", "rep", "old_rep", F.lit(s).alias("home")))
        found = staged(with_equal_texts(rows, staged(reduce(DataFrame.union, positives), "positives")), "verified")
        homes.append(found.select("digest", F.lit(b).cast("long").alias("batch"), "home"))
        if b < batches - 1:
            snapshots.append(staged(incoming.join(found, "digest", "left_anti"), "snapshot"))
    placed = groups.withColumn("home", F.col("batch"))
    if homes:
        placed = groups.join(reduce(DataFrame.union, homes), ["digest", "batch"], "left").withColumn("home", F.coalesce("home", "batch"))
    group = Window.partitionBy("digest", "home")  # at most a row for each batch
    many = placed.select("digest", "batch", F.max("rep").over(group).alias("group_rep"), F.sum("n").over(group).alias("rows")).where("rows > 1")
    out = join_groups(digested.withColumn("batch", batch_of), staged(many, "repeated"), ["digest", "batch"], "rows", n_rows)
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("group_rep"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("digest").alias("text_sha256"), "text_length",
    )
