"""Randomness that any engine can repeat: ranks and numbers from MD5 of seed and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffled(seed: str, *ids: str | Column) -> Column:
    """A key whose order is a random permutation: md5('seed:id:id...')."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids)).cast("binary"))


def uniform(seed: str, *ids: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the key."""
    return F.conv(F.substring(shuffled(seed, *ids), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
