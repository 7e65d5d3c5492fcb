"""Distances between vectors, as Column expressions over arrays and as numpy twins over matrices.

Two cosines exist and are not interchangeable: `cosine_half` halves the distance into [0, 1] and reads only
as many elements as the shorter vector has; `cosine_full` lies in [0, 2] and is infinite for unequal lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms under this count as zero, and sums under it as empty histogram cells.
TINY = 1e-12


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _shorter(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n < TINY, a).otherwise(F.transform(a, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(k))


def _similarity(a: Column, b: Column) -> Column:
    product = norm(a) * norm(b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / product))


def cosine_half(a: Column, b: Column) -> Column:
    """(1 - similarity) / 2; 1 if either norm is nothing."""
    a, b = _shorter(a, b)
    return F.when((norm(a) < TINY) | (norm(b) < TINY), 1.0).otherwise((1 - _similarity(a, b)) / 2)


def cosine_full(a: Column, b: Column) -> Column:
    """1 - similarity; 1 if either norm is zero, infinite for unequal lengths."""
    zero = (norm(a) == 0) | (norm(b) == 0)
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).when(zero, 1.0).otherwise(1 - _similarity(a, b))


def euclidean(a: Column, b: Column) -> Column:
    a, b = _shorter(a, b)
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of squared differences over sums; cells whose sum is nothing are left out."""
    a, b = _shorter(a, b)
    cell = lambda x, y: F.when(F.abs(x + y) > TINY, (x - y) * (x - y) / (x + y)).otherwise(0.0)
    return 0.5 * _sum(F.zip_with(a, b, cell))


#: By algorithm: the distance that its nearest-neighbour search uses.
METRIC_OF = {"eigenfaces": "cosine_half", "fisherfaces": "euclidean", "lbph": "chi_square"}
COLUMNS = {"cosine_half": cosine_half, "cosine_full": cosine_full, "euclidean": euclidean, "chi_square": chi_square}


def matrix_distance(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of a and those of b."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if metric in ("cosine_half", "cosine_full"):
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        product = na[:, None] * nb[None, :]
        zero = (na[:, None] < TINY) | (nb[None, :] < TINY)
        similarity = np.clip(np.divide(a @ b.T, product, out=np.zeros_like(product), where=~zero), -1, 1)
        return np.where(zero, 1.0, (1 - similarity) / (2 if metric == "cosine_half" else 1))
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):  # one row at a time: memory for one matrix of b's size
        diff = b - row
        if metric == "euclidean":
            out[i] = np.sqrt((diff * diff).sum(axis=1))
        elif metric == "chi_square":
            total = b + row
            out[i] = 0.5 * np.divide(diff * diff, total, out=np.zeros_like(diff), where=np.abs(total) > TINY).sum(axis=1)
        else:
            raise ValueError(f"unknown metric {metric}")
    return out


def packed(v: np.ndarray) -> bytes:
    """The numbers as compressed doubles, without loss: histograms of mostly zeros are a hundredth of their size."""
    return zlib.compress(np.ascontiguousarray(v, "<f8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<f8")
