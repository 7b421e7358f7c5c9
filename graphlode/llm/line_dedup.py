"""Line deduplication with levelled sorted runs of line hashes.

The corpus comes in batches of ascending ids. A batch's distinct lines (128-bit hash of the line's key and smallest
id that holds it) are anti-joined by sort-merge with every run made so far; what is left is new and becomes
a sorted run of its own. When a level has `fanout` runs they are compacted into one run of the next level, so
there are at most (fanout - 1) * log(batches) runs. A document keeps a line only where the pair
(hash, document) is in a run, so the join that decides has no hot key, even if every document holds the same line.

A line's key is the line without white space at both ends, A-Z in lower case. Keys shorter than `min_chars` code points
are never dropped, nor are repeats inside the one document that keeps a line.

Defined results: a null or empty text is one empty line. Rows that repeat an id are one document.
Each row without an id is a document of its own above all that have one, in the order of the table: such rows are numbered
in a stored table, and their lines are the last batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, staged

WHITE = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1
LINE = "h1 long, h2 long, named boolean, id long"


def line_hash(line: str, min_chars: int) -> bytes | None:
    """16 bytes for a line's key, None if the key is too short to be dropped."""
    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, named, id): the distinct line hashes of each row of docs (named, id, text)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("named", pa.bool_()), ("id", pa.int64())])

    def emit(batches):
        for b in batches:
            found, counts = [], []
            for text in b.column("text"):
                own = {line_hash(x, min_chars) for x in text.as_py().split("\n")} - {None}
                found += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(found), ">i8").reshape(-1, 2).astype(np.int64)
            named, ids = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), counts) for c in ("named", "id"))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(named, pa.bool_()), pa.array(ids, pa.int64())], schema=schema)

    return docs.mapInArrow(frugal(emit), LINE)


def with_numbers(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows with named and id: whether a row has a doc_id, and that id or a number among the rows without; and whether there are any such."""
    own = rows.where("doc_id is not null").select(F.lit(True).alias("named"), F.col("doc_id").alias("id"), *rows.columns)
    nameless = rows.where("doc_id is null")
    if nameless.isEmpty():
        return own, False
    numbered = nameless.select(F.lit(False).alias("named"), F.monotonically_increasing_id().alias("id"), *rows.columns)
    return own.unionByName(staged(numbered, "nameless")), True


class Runs:
    """Levels of sorted runs (h1, h2, named, id), each hash in one run only."""

    def __init__(self, fanout: int = 3):
        self.fanout, self.levels = fanout, [[]]

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch (h1, h2, named, id) whose documents, all named or none, are above those of the batches before."""
        fresh = lines.groupBy("h1", "h2", "named").agg(F.min("id").alias("id"))
        for run in self.all():
            fresh = fresh.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(staged(fresh.sortWithinPartitions("h1", "h2"), "line-run"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for r in self.levels[level][1:]:
                merged = merged.unionByName(r)
            self.levels[level] = []
            self._put(staged(merged.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "line-run"), level + 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text, and the input's columns named in `keep` in a struct `row`."""
    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows, any_nameless = with_numbers(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"), rest.alias("row")))
    lines = staged(line_hashes(rows.select("named", "id", "text"), min_chars), "lines")
    of_named = lines.where("named")
    cuts = of_named.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({min(int(c), LAST_ID - 1) for c in cuts})  # any cut will do: a batch takes what lies between two
    runs, low = Runs(fanout), None
    for high in [*cuts, None]:
        inside = F.lit(True) if low is None else F.col("id") > low
        inside = inside if high is None else inside & (F.col("id") <= high)
        runs.add(of_named.where(inside))
        low = high
    if any_nameless:
        runs.add(lines.where("not named"))
    kept = runs.all()[0]
    for r in runs.all()[1:]:
        kept = kept.unionByName(r)
    drops = lines.join(kept.hint("merge"), ["h1", "h2", "named", "id"], "left_anti").groupBy("named", "id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    joined = rows.join(drops.hint("merge"), ["named", "id"], "left").select("doc_id", "text", "drops", "row")

    row_type = rows.schema["row"].dataType
    out_type = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("row", row_type)])

    def cut(batches_):
        for b in batches_:
            n_lines, n_dropped, texts = [], [], []
            for text, drop in zip(b.column("text"), b.column("drops"), strict=True):
                found = text.as_py().split("\n")
                n_lines.append(len(found))
                if drop.is_valid:
                    gone = {np.array([x["h1"], x["h2"]], ">i8").tobytes() for x in drop.as_py()}
                    found = [x for x in found if line_hash(x, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(found))
                texts.append("\n".join(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string()), b.column("row")], names=["doc_id", "n_lines", "n_dropped", "kept_text", "row"])

    return joined.mapInArrow(frugal(cut), out_type)
