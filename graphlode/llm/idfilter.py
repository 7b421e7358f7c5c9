"""A filter of ids that goes to every task: only the texts that a stage needs are hashed or shuffled again."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import mix


def id_filter(wanted: DataFrame, n: int, most_bits: int = 1 << 24) -> np.ndarray:
    """A one-hash Bloom filter of n ids (doc_id), of at most most_bits (2 MB): it grows with n up to there, and lets more through beyond."""
    bits = 1 << min(max(n * 16, 1024).bit_length(), most_bits.bit_length() - 1)

    def fill(batches):
        out = np.zeros(bits, bool)
        for b in batches:
            out[slots(b.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(out).tobytes()]}, schema=pa.schema([("bits", pa.binary())]))

    parts = wanted.select("doc_id").repartition(4).mapInArrow(fill, "bits binary").collect()  # four rows at most
    return np.unpackbits(reduce(np.bitwise_or, (np.frombuffer(r[0], np.uint8) for r in parts), np.zeros(bits // 8, np.uint8))).astype(bool)


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
