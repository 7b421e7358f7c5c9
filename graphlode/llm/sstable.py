"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of ids in ascending order:

    data blocks | block index | Bloom filter | footer

* A key is the id in an order-preserving form of 9 bytes (0 for a null id, then the signed 64-bit id
  with its sign flipped, big-endian). In a block a key is stored as the length it shares with the key before and the rest.
* A block holds whole documents of at least ``block_bytes`` together (one document may be longer) and is compressed by Zstandard; its CRC-32 stands in the index.
* The sparse index has a row for each block: last key, place, size, number of documents, ids before it.
* The Bloom filter is over all keys, 10 bits each, 7 probes.
* The footer has the places of index and filter, totals, the width of an id and the magic number.

`lookup` reads footer, filter and index, finds the block by binary search, and reads that block alone.
Shards are written under a name that depends on the partition alone, first to a name of its own and then renamed, so a task that is run again writes the same file.

Defined results: null text is the empty one (its ids are the end id alone); a null id sorts first; rows
that repeat an id keep an order by the hash of their text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir
from .tokens import encoder as encoder_of

MAGIC = b"GLSST001"
_FOOTER = struct.Struct("<QQQQQQHH8s")
FOOTER_BYTES = _FOOTER.size


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """A plain Bloom filter over byte keys; two CRC-based hashes, combined."""

    PROBES = 7

    def __init__(self, bits: bytearray):
        self.bits = bits

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int = 10) -> Bloom:
        out = cls(bytearray(max(8, len(keys) * bits_per_key // 8 + 1)))
        for k in keys:
            for p in out._probes(k):
                out.bits[p >> 3] |= 1 << (p & 7)
        return out

    def _probes(self, key: bytes):
        a, b, m = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1, 8 * len(self.bits)
        return [(a + i * b) % m for i in range(self.PROBES)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._probes(key))


class ShardWriter:
    def __init__(self, out, id_bytes: int, block_bytes: int, level: int = 1):
        self.out, self.id_bytes, self.block_bytes, self.zip = out, id_bytes, block_bytes, zstandard.ZstdCompressor(level=level)
        self.at = self.n_tokens = 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self._new()

    def _new(self):
        self.heads, self.values, self.size, self.block_keys, self.before, self.last = [], [], 0, 0, self.n_tokens, b""

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: the document's ids, little-endian, of the shard's width. Keys must not descend."""
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        self.heads.append(_varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids) // self.id_bytes))
        self.values.append(ids)
        self.size += len(ids)
        self.n_tokens += len(ids) // self.id_bytes
        self.block_keys += 1
        self.last = key
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._cut()

    def _cut(self) -> None:
        if not self.block_keys:
            return
        heads = b"".join(self.heads)
        packed = self.zip.compress(struct.pack("<II", self.block_keys, len(heads)) + heads + b"".join(self.values))
        self.out.write(packed)
        self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QIIIQ", self.at, len(packed), zlib.crc32(packed), self.block_keys, self.before))
        self.at += len(packed)
        self._new()

    def close(self) -> None:
        self._cut()
        index, bloom = b"".join(self.index), bytes(Bloom.of(self.keys).bits)
        self.out.write(index + bloom + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_tokens, self.id_bytes, 0, MAGIC))


def _footer(tail: bytes) -> tuple:
    f = _FOOTER.unpack(tail[-_FOOTER.size :])
    if f[-1] != MAGIC:
        raise ValueError("not a token shard")
    return f


def _index(data: bytes) -> list[tuple]:
    rows, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<H", data, at)
        rows.append((data[at + 2 : at + 2 + n], *struct.unpack_from("<QIIIQ", data, at + 2 + n)))
        at += 2 + n + 28
    return rows


def _block(packed: bytes, crc: int, id_bytes: int):
    """(key, ids as bytes) of each document of a block."""
    if zlib.crc32(packed) != crc:
        raise ValueError("a block does not match its checksum")
    data = zstandard.ZstdDecompressor().decompress(packed)
    n, heads = struct.unpack_from("<II", data)
    at, value, key = 8, 8 + heads, b""
    for _ in range(n):
        shared, at = _read_varint(data, at)
        rest, at = _read_varint(data, at)
        key = key[:shared] + data[at : at + rest]
        count, at = _read_varint(data, at + rest)
        yield key, data[value : value + count * id_bytes]
        value += count * id_bytes


def lookup(path: str, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents of this id in one shard (none, one, or several rows that repeat it)."""
    fs, name = pafs.FileSystem.from_uri(path if path.startswith("file:") or "://" in path else f"file://{path}")
    key, found = key_of(doc_id), []
    with fs.open_input_file(name) as f:
        size = f.size()
        index_at, index_n, bloom_at, bloom_n, _, _, width, _, _ = _footer(f.read_at(_FOOTER.size, size - _FOOTER.size))
        if key not in Bloom(bytearray(f.read_at(bloom_n, bloom_at))):
            return []
        index = _index(f.read_at(index_n, index_at))
        for last, at, n, crc, _, _ in index[bisect_left([x[0] for x in index], key) :]:
            block = list(_block(f.read_at(n, at), crc, width))
            keys = [k for k, _ in block]
            i = bisect_left(keys, key)
            while i < len(keys) and keys[i] == key:
                found.append(np.frombuffer(block[i][1], f"<u{width}").tolist())
                i += 1
            if last > key:
                break
    return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 128 << 10, path: str | None = None, file_bytes: int = 1 << 30) -> DataFrame:
    """Encodes and writes shards of about file_bytes, one or more for each range of ids; (shard, name, n_docs, n_tokens, folder), already computed. Shards ascend with ids."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shards")
    dealt = documents(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(path if path.startswith("file:") or "://" in path else f"file://{path}")
        encoder, writer = encoder_of(tokenizer), None
        width, files = encoder.id_bytes, 0
        end = end_id.to_bytes(width, "little")
        for b in batches:
            for doc_id, ids in encoder.each(b.column(0).to_pylist(), b.column(1)):
                if writer is not None and writer.at >= file_bytes:
                    yield finish(fs, base, writer, out, temp, shard)
                    writer = None
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    temp, shard, files = f"{base}/_{part:07d}-{uuid.uuid4().hex}", (part << 32) + files, files + 1
                    out = fs.open_output_stream(temp)
                    writer = ShardWriter(out, width, block_bytes)
                writer.add(doc_id, ids.astype(f"<u{width}").tobytes() + end)
        if writer is not None:
            yield finish(fs, base, writer, out, temp, shard)

    def finish(fs, base: str, writer: ShardWriter, out, temp: str, shard: int) -> pa.RecordBatch:
        writer.close()
        out.close()
        name = f"part-{shard >> 32:07d}-{shard & 0xFFFFFFFF:05d}.sst"
        fs.move(temp, f"{base}/{name}")
        return pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [len(writer.keys)], "n_tokens": [writer.n_tokens]}, schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    at, ddl = shared_dir(spark, "shard-manifest"), "shard long, name string, n_docs long, n_tokens long"
    dealt.mapInArrow(write, ddl).write.parquet(at)
    return spark.read.schema(ddl).parquet(at).withColumn("folder", F.lit(path))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the shards of a folder: doc_id, start (ids before it in the whole set), n_tokens, ids_crc32(, ids)."""
    fields = [("shard_name", pa.string()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def rows(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, base = pafs.FileSystem.from_uri(folder if folder.startswith("file:") or "://" in folder else f"file://{folder}")
                size = fs.get_file_info(f"{base}/{name}").size
                with fs.open_input_file(f"{base}/{name}") as f:  # footer and index, then a block at a time
                    index_at, index_n, _, _, _, _, width, _, _ = _footer(f.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
                    for _, at, n, crc, _, before in _index(f.read_at(index_n, index_at)):
                        got, inside = [], before
                        for key, raw in _block(f.read_at(n, at), crc, width):
                            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                            got.append((name, id_of(key), inside, len(ids), zlib.crc32(ids)) + ((ids.astype(np.int32),) if with_ids else ()))
                            inside += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*got, strict=True), fields, strict=True)], schema=pa.schema(fields))

    ddl = "shard_name string, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(rows, ddl)
    # one row a shard: ids before each shard, in shard order
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = manifest.select(F.col("name").alias("shard_name"), before.alias("base"))
    out = found.join(base, "shard_name").withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
