"""Quantisers: scalar, random-projection, binary, product, and their scans with exact reranking.

Quantisers are fitted by aggregation over all rows (scalar ones) or on a bounded sample of
``SAMPLE`` rows, the ones whose ids hash lowest; every row is then encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TooFewVectors
from ..functions import distance as D
from ..schema import VectorTable
from . import knn

SAMPLE = 20_000


def sample(base: VectorTable, n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` vectors, the same ones however the table is partitioned."""
    rows = base.rows.select("vector", F.xxhash64("id").alias("_h"), "id").orderBy("_h", "id").limit(n).select("vector").collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 25, spherical: bool = False, weight: np.ndarray | None = None) -> np.ndarray:
    """Centroids of rows in memory, of ``weight`` each, by k-means++ and Lloyd's updates; for a whole
    table see ``kmeans.fit``."""
    if k > len(x):
        raise TooFewVectors(k, len(x))
    rng = np.random.default_rng(seed)
    weight = np.ones(len(x)) if weight is None else weight
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), D.TINY)
    x = unit(x) if spherical else x
    chosen = [x[rng.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = far * weight / (far * weight).sum() if far.sum() > 0 else None
        chosen.append(x[rng.choice(len(x), p=p)])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    c = np.array(chosen)
    for _ in range(rounds):
        at = D.kernel("l2_squared", x, c).argmin(axis=1)
        n = np.bincount(at, weight, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x * weight[:, None])
        new = np.where(n[:, None] > 0, s / np.where(n > 0, n, 1)[:, None], c)
        new = unit(new) if spherical else new
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


# -- scalar ----------------------------------------------------------------------------------


def scalar_bounds(base: VectorTable) -> tuple[list[float], list[float]]:
    """Least and largest value of each dimension; one row a dimension reaches the driver."""
    each = base.rows.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    return [float(r["lo"]) for r in each], [float(r["hi"]) for r in each]


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scalar_codes(vector: Column, low: list[float], high: list[float], levels: int) -> Column:
    """Codes 0 .. levels of each value, rounded half up between the bounds."""
    ends = F.arrays_zip(D.as_double(vector).alias("x"), _array(low).alias("lo"), _array(high).alias("hi"))
    code = lambda e: F.when(e["hi"] > e["lo"], F.floor((e["x"] - e["lo"]) / (e["hi"] - e["lo"]) * levels + 0.5)).otherwise(0)
    return F.transform(ends, lambda e: F.least(F.lit(levels), F.greatest(F.lit(0), code(e))).cast("int"))


def scalar_decoded(codes: Column, low: list[float], high: list[float], levels: int) -> Column:
    ends = F.arrays_zip(codes.alias("c"), _array(low).alias("lo"), _array(high).alias("hi"))
    return F.transform(ends, lambda e: e["lo"] + e["c"] * ((e["hi"] - e["lo"]) / levels))


def scalar_knn(base: VectorTable, queries: VectorTable, k: int, bits: int = 4, pool: int = 10) -> DataFrame:
    """Scan of scalar codes for ``pool`` * k candidates a query by asymmetric L2, then exact L2."""
    levels = 2**bits - 1
    low, high = scalar_bounds(base)
    codes = base.rows.select("id", scalar_codes(F.col("vector"), low, high, levels).alias("codes"))
    decoded = codes.select(F.col("id").alias("vec_id"), scalar_decoded(F.col("codes"), low, high, levels).alias("embedding"))
    return knn.rerank(knn.knn_join(VectorTable(decoded), queries, pool * k, "l2"), base, queries, k, "l2")


# -- codes that tasks make with a shared matrix or codebook ------------------------------------


def _mapped(base: VectorTable, transform) -> VectorTable:  # noqa: ANN001
    """The table with its vectors mapped, a batch (rows, dimensions) at a time."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(transform(np.stack([np.asarray(x, dtype=np.float64) for x in v]))))

    return VectorTable(base.rows.select(F.col("id").alias("vec_id"), run(F.col("vector").cast("array<double>")).alias("embedding")))


def rotation(dimension: int, seed: int = 0) -> np.ndarray:
    """A random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def projected_knn(base: VectorTable, queries: VectorTable, k: int, to: int = 64, pool: int = 10, seed: int = 0) -> DataFrame:
    """Gaussian projection to ``to`` dimensions held in a byte each, then exact cosine on the pool."""
    matrix = np.random.default_rng(seed).normal(size=(base.dimension() or 1, to)) / np.sqrt(to)
    fitted = sample(base) @ matrix
    low, step = fitted.min(axis=0), np.maximum(np.ptp(fitted, axis=0), D.TINY) / 255
    code = lambda x: np.clip(np.round((x @ matrix - low) / step), 0, 255) * step + low
    near = knn.knn_join(_mapped(base, code), _mapped(queries, lambda x: x @ matrix), pool * k, "l2")
    return knn.rerank(near, base, queries, k, "cosine")


def binary_codes(base: VectorTable, seed: int = 0) -> DataFrame:
    """(id, code): the signs of the rotated vector, packed into binary."""
    turn = rotation(base.dimension() or 1, seed)

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        signs = np.stack([np.asarray(x, dtype=np.float64) for x in v]) @ turn >= 0
        return pd.Series([row.tobytes() for row in np.packbits(signs, axis=1)])

    return base.rows.select("id", run(F.col("vector").cast("array<double>")).alias("code"))


def binary_knn(base: VectorTable, queries: VectorTable, k: int, pool: int = 10, seed: int = 0) -> DataFrame:
    """One bit a dimension: signs of the rotated vector against the rotated query, then exact cosine."""
    dimension = base.dimension() or 1
    turn = rotation(dimension, seed)

    @F.pandas_udf("array<double>")
    def signs(code: pd.Series) -> pd.Series:
        return pd.Series([np.unpackbits(np.frombuffer(c, dtype=np.uint8))[:dimension] * 2.0 - 1 for c in code], dtype=object)

    decoded = binary_codes(base, seed).select(F.col("id").alias("vec_id"), signs("code").alias("embedding"))
    near = knn.knn_join(VectorTable(decoded), _mapped(queries, lambda x: x @ turn), pool * k, "inner_product")
    return knn.rerank(near, base, queries, k, "cosine")


@dataclass(frozen=True)
class ProductQuantiser:
    """Codebooks (parts, codes, values) over the rotated vector."""

    turn: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, parts: int = 8, codes: int = 256, seed: int = 0, turns: int = 0) -> ProductQuantiser:
        """Plain with ``turns`` 0; else that many alternations with the best rotation (Procrustes)."""
        if x.shape[1] % parts:
            raise ValueError(f"{parts} parts don't divide {x.shape[1]} dimensions")
        turn = np.eye(x.shape[1]) if not turns else rotation(x.shape[1], seed)
        for i in range(turns + 1):
            y = x @ turn
            books = np.stack([_padded(lloyd(p, min(codes, len(x)), seed), min(codes, len(x))) for p in np.split(y, parts, axis=1)])
            it = cls(turn, books)
            if i < turns:
                u, _, v = np.linalg.svd(x.T @ it.rotated(it.encode(x)))
                turn = u @ v
        return it

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([D.kernel("l2_squared", p, b).argmin(axis=1) for p, b in zip(np.split(x @ self.turn, len(self.books), axis=1), self.books)], axis=1).astype(np.uint8)

    def rotated(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.rotated(codes) @ self.turn.T


def _padded(c: np.ndarray, n: int) -> np.ndarray:
    return c if len(c) == n else np.concatenate([c, np.repeat(c[-1:], n - len(c), axis=0)])


def product_knn(base: VectorTable, queries: VectorTable, k: int, parts: int = 8, codes: int = 256, turns: int = 0, pool: int = 10, seed: int = 0) -> DataFrame:
    """Scan of product codes, then exact L2 on the pool."""
    pq = ProductQuantiser.fit(sample(base), parts, codes, seed, turns)
    coded = _mapped(base, lambda x: pq.decode(pq.encode(x)))
    return knn.rerank(knn.knn_join(coded, queries, pool * k, "l2"), base, queries, k, "l2")
