"""fvecs and ivecs files: each record is an int32 dimension and as many 32-bit values.

A record has a fixed length, so a file is read by ranges of whole records: Spark's binary reader, asked for no content, lists the files; the first
four bytes of each give its dimension; and a data source makes a partition of every SPLIT bytes. Ranges are opened by pyarrow's file systems (local, HDFS, S3, GCS), so a store that
Spark alone can open will not do. A row's number is its offset over the record's length, and a filter on that number
leaves out ranges at planning. Row numbers run through the files in order of their names. No file is held whole; several are written per task when they get large.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a partition, bytes that are decoded at a time, and bytes of a file that is written.
SPLIT, AT_ONCE, ROLL = 64 << 20, 4 << 20, 1 << 30
_FORMAT = "graphlode_vecs"


def decode_records(data: bytes, kind: str) -> np.ndarray:
    """The matrix of whole records; kind 'f' or 'i'. No bytes give 0 x 0; records of different dimensions raise OSError."""
    raw = np.frombuffer(data, "<i4")
    if not len(raw):
        return np.empty((0, 0), np.float32 if kind == "f" else np.int64)
    dim = int(raw[0])
    if dim <= 0 or len(raw) % (dim + 1) or (raw.reshape(-1, dim + 1)[:, 0] != dim).any():
        raise OSError("records have different dimensions")
    body = raw.reshape(-1, dim + 1)[:, 1:]
    return body.view("<f4") if kind == "f" else body.astype(np.int64)


def encode_records(rows: np.ndarray, kind: str) -> bytes:
    rows = np.asarray(rows, "<f4" if kind == "f" else "<i4")
    out = np.empty((rows.shape[0], rows.shape[1] + 1), "<i4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = rows.view("<i4")
    return out.tobytes()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Range(InputPartition):
    path: str
    dim: int
    first: int  # of the records in the file
    count: int
    base: int  # number of the file's first record


class _Reader(DataSourceReader):
    """Ranges of the files in `files`: path, dimension, records and number of the first record, as JSON text."""

    def __init__(self, options: dict):
        import json

        self.kind, self.cut = options["kind"], int(options["cut"]) if options.get("cut") else None
        self.files, self.split = json.loads(options["files"]), int(options["split"])
        self.low, self.high = 0, sum(f[2] for f in self.files)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the row number narrow the ranges; Spark still applies all filters."""
        for f in filters:
            match f:
                case EqualTo(("vec_id" | "query_id",), v):
                    self.low, self.high = max(self.low, v), min(self.high, v + 1)
                case In(("vec_id" | "query_id",), vs) if vs:
                    self.low, self.high = max(self.low, min(vs)), min(self.high, max(vs) + 1)
                case GreaterThan(("vec_id" | "query_id",), v):
                    self.low = max(self.low, v + 1)
                case GreaterThanOrEqual(("vec_id" | "query_id",), v):
                    self.low = max(self.low, v)
                case LessThan(("vec_id" | "query_id",), v):
                    self.high = min(self.high, v)
                case LessThanOrEqual(("vec_id" | "query_id",), v):
                    self.high = min(self.high, v + 1)
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, dim, records, base in self.files:
            step = max(1, self.split // (4 * (dim + 1)))
            for first in range(0, records, step):
                a, b = max(first, self.low - base), min(first + step, records, self.high - base)
                if a < b:
                    out.append(_Range(path, dim, a, b - a, base))
        return out or [_Range("", 1, 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        value, names = (pa.float32(), ("vec_id", "embedding")) if self.kind == "f" else (pa.int64(), ("query_id", "ids"))
        size, step = 4 * (part.dim + 1), max(1, AT_ONCE // (4 * (part.dim + 1)))
        fs, path = _open(part.path)
        with fs.open_input_file(path) as f:
            for at in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - at)
                rows = decode_records(f.read_at(n * size, at * size), self.kind)
                if rows.shape != (n, part.dim):
                    raise OSError("records have different dimensions")
                rows = np.ascontiguousarray(rows[:, : self.cut])
                of = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.base + at, part.base + at + n)), pa.ListArray.from_arrays(pa.array(of), pa.array(rows.ravel(), value))], names=list(names))


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "vec_id long, embedding array<float>" if self.options["kind"] == "f" else "query_id long, ids array<long>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def file_table(spark: SparkSession, path: str) -> list[tuple[str, int, int, int]]:
    """path, dimension, records and number of the first record of each file that is not empty, in order of names. A length that is no whole number of records raises OSError."""
    listed = sorted((r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())  # a row for each file, no content
    out, base = [], 0
    for name, length in listed:
        if not length:
            continue
        fs, inside = _open(name)
        with fs.open_input_file(inside) as f:
            dim = int(np.frombuffer(f.read_at(4, 0), "<i4")[0]) if length >= 4 else 0
        if dim <= 0 or length % (4 * (dim + 1)):
            raise OSError("records have different dimensions")
        out.append((name, dim, length // (4 * (dim + 1)), base))
        base += out[-1][2]
    return out


def read_vecs(spark: SparkSession, path: str, kind: str = "f", first: int | None = None, split: int = SPLIT) -> DataFrame:
    """vec_id, embedding (fvecs) or query_id, ids (ivecs); `first` cuts each record; split: bytes of a partition."""
    import json

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VecsSource)
    return spark.read.format(_FORMAT).option("kind", kind).option("cut", "" if first is None else str(first)).option("split", str(split)).option("files", json.dumps(file_table(spark, path))).load()


def write_vecs(df: DataFrame, path: str, kind: str = "f", id_col: str = "vec_id", value_col: str = "embedding", roll: int = ROLL) -> int:
    """Writes rows in order of their id, for each range of ids one file or, from `roll` bytes on, several; gives the number of files."""
    dealt = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("vals")).repartitionByRange("id").sortWithinPartitions("id")

    def write(batches):
        from pyspark import TaskContext

        part, number, out, size = TaskContext.get().partitionId(), 0, None, 0
        fs, base = _open(path)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                temp, size = f"{base}/_{part:06d}-{uuid.uuid4().hex}", 0  # two attempts of a task never share it
                out = fs.open_output_stream(temp)
            data = encode_records(np.array(b.column(1).to_pylist()), kind)
            out.write(data)
            size += len(data)
            if size >= roll:
                out.close()
                fs.move(temp, f"{base}/part-{part:06d}-{number:06d}.{kind}vecs")
                out, number = None, number + 1
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/part-{part:06d}-{number:06d}.{kind}vecs")
            number += 1
        yield pa.RecordBatch.from_pydict({"files": [number]}, schema=pa.schema([("files", pa.int64())]))

    return dealt.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).head()[0]


def read_ground_truth(one_based: DataFrame, id_cols: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A truth table whose ids count from one, as its usual container stores them, to ids from zero."""
    return one_based.withColumns({c: F.col(c) - 1 for c in id_cols})
