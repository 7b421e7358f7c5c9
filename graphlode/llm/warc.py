"""WARC archives as seekable Zstandard bundles.

A bundle holds groups of records, each group compressed as an independent frame. Two skippable frames
follow: the record map (record id, frame, offset inside the decompressed frame, length) and the seek
table of the Zstandard seekable format (compressed and decompressed size of each frame, then the
number of frames, a descriptor byte and the magic number). Any Zstandard reader can read a bundle from
the front; `read_record` reads the end of the file, one frame and nothing else.

Bundles are cut from rows dealt by ranges of the id, written under a name that depends on the
partition alone: a task that is run again writes the same bytes, first to a name of its own and then
renamed. A payload is stored once: records with an equal, long enough payload point to the one
with the smallest id. Payloads are equal when their SHA-256 and length are; the SHA-1 is the record's digest alone.

Defined results: a null payload is the empty one, a null url is left out. A row without id is always
a response and is referred to by none. Rows that repeat the smallest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, shared_dir, staged

SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit without payload when refers_to is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the offset after the record that starts at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    block = data[end + 4 : stop]
    return head, block[block.index(b"\r\n\r\n") + 4 :], stop + 4


class BundleWriter:
    """Collects records; `close` gives nothing back but leaves the whole file in `out`."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes, self.zip = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.places, self.open, self.size = [], [], [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.places.append((page_id, len(self.frames), self.size, len(data)))
        self.open.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._cut()

    def _cut(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self._cut()
        places = self.zip.compress(json.dumps(self.places).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_MAP, len(places) + 4) + places + struct.pack("<I", len(places)))
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


def bundle_tables(tail: bytes, size: int) -> tuple[list, list]:
    """(frames as (offset, packed, plain), record places) from the last bytes of a bundle of `size` bytes."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("not a seekable bundle")
    start = len(tail) - 9 - 8 * count
    frames, at = [], 0
    for packed, plain in struct.iter_unpack("<II", tail[start : start + 8 * count]):
        frames.append((at, packed, plain))
        at += packed
    (n,) = struct.unpack("<I", tail[start - 12 : start - 8])
    places = tail[start - 12 - n : start - 12]
    return frames, json.loads(zstandard.ZstdDecompressor().decompress(places))


def _tables(f, size: int) -> tuple[list, list]:
    """The tables of an open bundle: its end is read, more of it if they are longer."""
    want = min(size, 1 << 16)
    while True:
        tail = f.read_at(want, size - want)
        start = want - 9 - 8 * struct.unpack("<IBI", tail[-9:])[0]
        if start >= 12 and start - 12 >= struct.unpack("<I", tail[start - 12 : start - 8])[0] or want == size:
            return bundle_tables(tail, size)
        want = min(size, want * 4)


def read_record(path: str, page_id: int) -> tuple[dict[str, str], bytes]:
    """The record of an id: the footer, then its frame alone, are read."""
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    size = fs.get_file_info(name).size
    with fs.open_input_file(name) as f:
        frames, places = _tables(f, size)
        place = next((p for p in places if p[0] == page_id), None)
        if place is None:
            raise KeyError(page_id)
        _, frame, offset, _ = place
        at, packed, _ = frames[frame]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))
    head, payload, _ = parse(data, offset)
    return head, payload


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = 256 << 10, level: int = 3, date: str = "2024-01-01T00:00:00Z", path: str | None = None, file_bytes: int = 1 << 30) -> DataFrame:
    """Writes bundles of about file_bytes, one or more for each range of ids; returns (path, n_records, n_bytes), already computed."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")
    ).withColumn("row_key", F.concat(F.sha2("payload", 256), F.lit("/"), F.octet_length("payload").cast("string")))
    keys = staged(rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "row_key"), "payload-keys")
    first = keys.groupBy("row_key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    revisits = join_groups(keys, staged(first, "first-of-equal"), ["row_key"], "n", keys.count()).where("page_id > first_id").groupBy("page_id", "row_key").agg(F.min("first_id").alias("refers_to"))
    # a marker row goes ahead of the record it makes a revisit, so payloads are shuffled once
    markers = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "row_key", "refers_to", F.lit(0).alias("kind"))
    records = rows.select("page_id", "url", "payload", "row_key", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    dealt = records.unionByName(markers).repartitionByRange("page_id", "row_key").sortWithinPartitions("page_id", "row_key", "kind")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        writer = marked = None
        files = 0
        for b in batches:
            for page_id, url, payload, key, refers, kind in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "row_key", "refers_to", "kind")), strict=True):
                if kind == 0:
                    marked = page_id, key, refers
                    continue
                refers = marked[2] if marked and marked[:2] == (page_id, key) else None
                if writer is not None and out.tell() >= file_bytes:
                    yield finish(fs, writer, out, temp, final)
                    writer = None
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{files:05d}.warc.zst"
                    temp, final, files = f"{base}/_{part:06d}-{uuid.uuid4().hex}", (f"{base}/{name}", f"{path}/{name}"), files + 1
                    out = fs.open_output_stream(temp)
                    writer = BundleWriter(out, frame_bytes, level)
                writer.add(page_id, record(page_id, url, payload.encode(), refers, date))
        if writer is not None:
            yield finish(fs, writer, out, temp, final)

    def finish(fs, writer: BundleWriter, out, temp: str, final: tuple[str, str]) -> pa.RecordBatch:
        writer.close()
        size = out.tell()
        out.close()
        fs.move(temp, final[0])
        return pa.RecordBatch.from_pydict({"path": [final[1]], "n_records": [len(writer.places)], "n_bytes": [size]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    manifest = dealt.mapInArrow(write, "path string, n_records long, n_bytes long")
    at = shared_dir(spark, "warc-manifest")
    manifest.write.parquet(at)
    return spark.read.schema("path string, n_records long, n_bytes long").parquet(at).withColumn("folder", F.lit(path))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of a folder of bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to(, payload)."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def rows(batches):
        zip_ = zstandard.ZstdDecompressor()
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                size = fs.get_file_info(name).size
                with fs.open_input_file(name) as f:
                    frames, _ = _tables(f, size)
                    for at, packed, _plain in frames:  # a frame at a time
                        plain, at_record, got = zip_.decompress(f.read_at(packed, at)), 0, []
                        while at_record < len(plain):
                            head, payload, at_record = parse(plain, at_record)
                            if head["WARC-Type"] == "response" and (len(payload) != int(head["X-Payload-Length"]) or "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != head["WARC-Payload-Digest"]):
                                raise ValueError("a payload does not match its digest")
                            page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                            got.append((None if page is None else int(page), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], None if refers is None else int(refers)) + (payload,) * with_payload)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*got, strict=True), fields, strict=True)], schema=schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path").mapInArrow(rows, ddl)  # paths alone: contents are read by frame
