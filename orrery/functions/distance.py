"""Distances between vectors, as Columns and as NumPy kernels of the same meaning.

Smaller is nearer for all of them. Values are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Unsupported

METRICS = ("l2", "l2_squared", "cosine", "cosine_normalised", "angular", "inner_product")
TINY = 1e-9
PI = 3.141592653589793


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 where a vector is (nearly) zero."""
    flat = (norm(a) <= TINY) | (norm(b) <= TINY)
    return F.when(flat, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / (norm(a) * norm(b)))))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The distance by name."""
    match metric:
        case "l2":
            return F.sqrt(squared_l2(a, b))
        case "l2_squared":
            return squared_l2(a, b)
        case "cosine":
            return 1 - cosine_similarity(a, b)
        case "cosine_normalised":
            return 1 - dot(a, b)
        case "angular":
            return F.acos(cosine_similarity(a, b)) / PI
        case "inner_product":
            return -dot(a, b)
    raise Unsupported(f"no metric {metric!r}; there are {', '.join(METRICS)}")


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences: an example of a distance of the caller's own."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The unit vector; zeros where the norm is under 1e-10."""
    n = norm(v)
    return F.when(n < 1e-10, F.transform(as_double(v), lambda x: F.lit(0.0))).otherwise(F.transform(as_double(v), lambda x: x / n))


@dataclass(frozen=True)
class Own:
    """A distance of the caller's own for the searches that take a metric.

    ``about`` gives those of all pairs (rows of a, rows of b), ``off`` how far one of them may be off at
    most, and ``exact`` those of a's and b's rows one by one. Pairs that may be among the nearest by
    ``about`` are computed again by ``exact``.
    """

    about: Callable[[np.ndarray, np.ndarray], np.ndarray]
    off: Callable[[np.ndarray, np.ndarray], float]
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _l1_sums(x: np.ndarray) -> float:
    return float(np.nan_to_num(np.abs(x).sum(axis=1), nan=0.0, posinf=np.inf).max(initial=0.0))


def _l1_about(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|x - y| = x + y - 2 min(x, y), in single precision where that has the range."""
    kind = np.float32 if _l1_sums(a) + _l1_sums(b) < 1e30 else np.float64
    a, b = a.astype(kind), b.astype(kind)
    columns, least = np.ascontiguousarray(b.T), np.zeros((len(a), len(b)), dtype=kind)
    for i in range(0, len(a), 64):
        out = least[i : i + 64]
        one = np.empty_like(out)
        for c in range(a.shape[1]):
            np.minimum(a[i : i + 64, c, None], columns[c][None], out=one)
            out += one
    return a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * least


def _l1_off(a: np.ndarray, b: np.ndarray) -> float:
    most = _l1_sums(a) + _l1_sums(b)
    return (5e-7 if most < 1e30 else 1e-15) * (4 + a.shape[1]) * most


#: ``l1`` as such a distance.
L1 = Own(_l1_about, _l1_off, lambda a, b: np.abs(a - b).sum(axis=1))


def kernel(metric: str | Own, base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances (base rows, queries) by matrix product."""
    base, queries = base.astype(np.float64), queries.astype(np.float64)
    if isinstance(metric, Own):
        return metric.about(base, queries)
    product = base @ queries.T
    if metric == "inner_product":
        return -product
    if metric == "cosine_normalised":
        return 1 - product
    nb, nq = (base * base).sum(axis=1), (queries * queries).sum(axis=1)
    if metric in ("l2", "l2_squared"):
        square = np.maximum(nb[:, None] + nq[None, :] - 2 * product, 0)
        return square if metric == "l2_squared" else np.sqrt(square)
    if metric in ("cosine", "angular"):
        lengths = np.sqrt(nb)[:, None] * np.sqrt(nq)[None, :]
        flat = (np.sqrt(nb) <= TINY)[:, None] | (np.sqrt(nq) <= TINY)[None, :]
        cos = np.where(flat, 0.0, np.clip(product / np.where(flat, 1.0, lengths), -1, 1))
        return 1 - cos if metric == "cosine" else np.arccos(cos) / PI
    raise Unsupported(f"no metric {metric!r}; there are {', '.join(METRICS)}")
