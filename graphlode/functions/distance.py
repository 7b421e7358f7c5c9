"""Distances and angles as columns, and the numpy forms that kernels share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance of two float arrays, in double."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def cos_at(p: Column, r: Column, opposite: Column) -> Column:
    """Cosine between two edges of squared lengths p and r whose ends are `opposite` (squared) apart; null for a zero length."""
    return (p + r - opposite) / F.lit(2.0) / F.nullif(F.sqrt(p * r), F.lit(0.0))


def occludes(p: Column, r: Column, opposite: Column, threshold: float) -> Column:
    """Whether the angle between two edges is below the threshold's; an undefined angle occludes nothing."""
    return F.coalesce(cos_at(p, r, opposite) > F.lit(threshold), F.lit(False))


def cos_threshold(angle_degrees: float) -> float:
    return float(np.cos(np.radians(angle_degrees)))


def angle_from_dim(dim: int) -> float:
    """The widest angle, in degrees, that `dim` dimensions let an omnidirectional spread keep."""
    return float(np.degrees(np.arccos((dim - 2) / (2 * dim - 2))))


def thresholds(angle: Column, dim: Column) -> tuple[Column, Column]:
    """cos_threshold and angle_from_dim as columns."""
    return F.cos(F.radians(angle)), F.degrees(F.acos((dim - F.lit(2)) / (F.lit(2) * dim - F.lit(2))))


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of two blocks of rows by the Gram form: fast, rounded differently from the direct sum."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: squared distances of a[i] and b[i] by the direct sum."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)
