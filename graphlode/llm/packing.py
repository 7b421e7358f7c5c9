"""Best-fit packing by minimum bin slack.

Documents longer than a sequence are cut: the first piece takes the remainder, the others are full. The
pieces' lengths form a histogram of at most `capacity` numbers, however many documents there are. From it the
driver plans patterns: the longest length left is put into a bin, a bitset subset-sum over the available
lengths (a bit for each reachable fill) finds the fullest feasible combination with it, and that
pattern is taken as often as its lengths last. Each time, some length keeps fewer pieces than the
pattern uses of it, so there are at most about 3.4 * capacity patterns, whatever the input.

Pieces then get ranks inside their length and each rank has its place in the plan. Ranks are counted
in salted cells (length, hash of the id), so no task holds all pieces of a common length.

Defined results: null text is the empty one (its only id is the end id). A null id and rows that repeat an id
are packed as documents of their own; the ranks of equal rows are interchangeable.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, frugal, staged
from .tokens import encoder as encoder_of

PIECES_DDL = "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a batch.
ROWS = 4_096


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, row_no, piece, start, length, ids_crc32(, ids). Texts are not shuffled."""
    fields = pa.schema([("doc_id", pa.int64()), ("row_no", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def cut(batches):
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            doc_ids, out = b.column(0).to_pylist(), []
            for doc_id, found in encoder.each(doc_ids, b.column(1)):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                at, piece, row = 0, 0, row + 1
                for stop in range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity):
                    out.append((doc_id, row, piece, at, stop - at, zlib.crc32(ids[at:stop])) + (ids[at:stop].view("<i4"),) * with_ids)
                    at, piece = stop, piece + 1
                if len(out) >= ROWS:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields.types, strict=True)], schema=fields)

    return documents(docs, id_col, text_col).mapInArrow(frugal(cut), PIECES_DDL + ", ids array<int>" * with_ids)


def fullest(anchor: int, left: Counter, capacity: int) -> Counter:
    """The combination of available lengths with `anchor` in it that leaves the least slack; longer lengths first on ties."""
    room = capacity - anchor
    free = left - Counter([anchor])
    reach, steps = 1, []
    for length in sorted((x for x in free if x <= room), reverse=True):
        many, part = min(free[length], room // length), 1
        while many > 0:  # powers of two stand for every multiple
            take = min(part, many)
            grown = (reach | reach << take * length) & ((1 << room + 1) - 1)
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            many, part = many - take, part * 2
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, Counter([anchor])
    for before, length, take in reversed(steps):
        if not before >> fill & 1:
            chosen[length] += take
            fill -= take * length
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns and how often each is taken; together they use every piece once."""
    left, out = Counter({k: v for k, v in histogram.items() if v}), []
    while left:
        pattern = fullest(max(left), left, capacity)
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, capacity: int, cell_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, row_no, piece, length, ...), which must be a stored table."""
    spark = pieces.sparkSession
    if any(f.name in ("sequence_id", "offset") for f in pieces.schema):
        raise ValueError("pieces already have places")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    segments, sequences, used = [], 0, Counter()
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            segments.append((length, used[length], used[length] + n * times, sequences, n, offset))
            used[length] += n * times
            offset += n * length
        sequences += times
    segments = spark.createDataFrame(segments, "seg_length long, rank_from long, rank_to long, seq_base long, seg_n long, seg_offset long")

    salts = max(1, math.ceil(max(counts.values(), default=1) / cell_rows))
    salted = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(salts)))
    cells = salted.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("length").alias("c_length"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_from"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "row_no", "piece")) - 1
    ranked = salted.withColumn("inside", inside).join(cells, (F.col("length") == F.col("c_length")) & (F.col("cell") == F.col("c_cell")))
    ranked = ranked.withColumn("rank", F.col("cell_from") + F.col("inside"))
    r = F.col("rank") - F.col("rank_from")
    # the plan's size is bounded by the capacity, not by the input
    placed = ranked.join(F.broadcast(segments), (F.col("length") == F.col("seg_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    n = F.col("seg_n")
    return placed.select(
        *pieces.columns,
        (F.col("seq_base") + F.floor(r / n)).cast("long").alias("sequence_id"),
        (F.col("seg_offset") + F.pmod(r, n) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, row_no, piece, start, length, ids_crc32, sequence_id, offset(, ids) for each piece of each document."""
    pieces = staged(encode_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity, 5_000 if with_ids else 50_000)
