"""All pairs of rows within a radius of each other: a self-join by blocks, exact.

Equal vectors are one class, the smallest id standing for it. Classes are dealt into blocks by their
nearest centroid's list and their distance from it; near lists share a block if they are small. Two
vectors within ``radius`` differ in their distance from any centroid by the radius at most, so two blocks
meet only if their ranges of distances from every centroid come that near. A pair of blocks meets once,
at one of the two: that one is held there, and the other's rows pass by a pack at a time. So each pair
of classes is seen once, and no task holds more than a block of ``BLOCK`` rows, whatever share of the
rows one list has.

Centroids decide how much is compared, never what is found. A block is copied to half of the blocks that
it meets; where the radius is near the distances between centroids, those are all.

Defined results: rows without an id or a vector have no pairs; of several vectors with one id one
counts; pairs are a < b by id; an empty table gives an empty result; other columns are
dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..functions import distance as D
from ..schema import VectorTable
from . import knn
from .shared import keep

#: Rows of a block at most, blocks that a small table is dealt into, rows of the sample that cuts lists.
BLOCK, BLOCKS, SAMPLE = 1 << 16, 8, 20_000
PAIRS = "a long, b long, distance double"
_PACK = "at int, own boolean, ids binary, vectors binary"
_RANGE = "block int, n long, lo array<double>, hi array<double>"


def _vectors(base: VectorTable) -> DataFrame:
    return base.df.dropna(subset=[base.id_col, base.vector_col]).select(F.col(base.id_col).cast("long").alias("member"), D.as_double(F.col(base.vector_col)).alias("vector"))


def classes(base: VectorTable) -> DataFrame:
    """(id, vector): each different vector with the smallest of its ids; of several vectors with one id
    the least."""
    first = _vectors(base).groupBy("vector").agg(F.min("member").alias("id"))
    return first.groupBy("id").agg(F.min("vector").alias("vector"))


def members(base: VectorTable) -> DataFrame:
    """(id, member): every row's id with the one that stands for its vector."""
    rows = _vectors(base)
    first = rows.groupBy("vector").agg(F.min("member").alias("id"))
    return rows.join(first, "vector").select("id", "member").distinct()


class _Blocks:
    """The block of a row: by its nearest centroid, and cuts of the distance from it where a list is large."""

    def __init__(self, centroids: np.ndarray, sample: np.ndarray, n: int, rows: int):
        self.centroids = centroids
        d, _ = self.distances(sample)
        home = d.argmin(axis=1)
        size = np.bincount(home, minlength=len(centroids)) * (n / max(len(sample), 1))
        self.first, self.cuts, self.n = np.full(len(centroids), -1), [np.zeros(0)] * len(centroids), 0
        between = D.kernel("l2_squared", centroids, centroids)
        for c in range(len(centroids)):
            if self.first[c] >= 0:
                continue
            self.first[c] = self.n
            if size[c] > rows:
                many = math.ceil(size[c] / rows)
                self.cuts[c] = np.unique(np.quantile(d[home == c, c], np.arange(1, many) / many))
                self.n += len(self.cuts[c]) + 1
                continue
            held = size[c]
            for other in np.argsort(between[c], kind="stable"):
                if self.first[other] < 0 and held + size[other] <= rows:
                    self.first[other] = self.n
                    held += size[other]
            self.n += 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from the centroids, and what they may be off by."""
        d = D.kernel("l2", x, self.centroids)
        return d, 1e-6 * (1 + d) + knn._slack("l2", x, self.centroids)

    def of(self, d: np.ndarray) -> np.ndarray:
        home = d.argmin(axis=1)
        block = self.first[home].copy()
        for c in np.unique(home):
            if len(self.cuts[c]):
                mine = home == c
                block[mine] += np.searchsorted(self.cuts[c], d[mine, c], side="right")
        return block


def _ranges(distinct: DataFrame, blocks: _Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and largest distance from each centroid of each block: numbers for a block and
    centroid reach the driver, which are few."""
    shared = distinct.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        n, shape = np.zeros(b.n, np.int64), (b.n, len(b.centroids))
        lo, hi = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                d, off = b.distances(knn._matrix(batch.slice(i, 1024).column("vector")))
                at = b.of(d)
                n += np.bincount(at, minlength=b.n)
                np.minimum.at(lo, at, d - off)
                np.maximum.at(hi, at, d + off)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(lo[some]), pa.list_(pa.float64())), pa.array(list(hi[some]), pa.list_(pa.float64()))], names=["block", "n", "lo", "hi"])

    each = distinct.mapInArrow(run, _RANGE).select("block", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("c", "r"))
    got = each.groupBy("block", "c").agg(F.sum("n").alias("n"), F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi")).toPandas()
    n, shape = np.zeros(blocks.n, np.int64), (blocks.n, len(blocks.centroids))
    lo, hi = np.full(shape, np.inf), np.full(shape, -np.inf)
    n[got["block"]] = got["n"]
    lo[got["block"], got["c"]], hi[got["block"], got["c"]] = got["lo"], got["hi"]
    return n, lo, hi


def _meetings(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First part and number of parts of each block, which has at most ``most`` rows a part, and where
    each part goes besides its own place: of two that meet, one goes to the other."""
    parts = np.maximum(1, -(-n // most))
    first = np.cumsum(parts) - parts
    of = np.repeat(np.arange(len(n)), parts)
    lo, hi, there = lo[of], hi[of], np.arange(len(of))
    goes = []
    for i in there:
        near = (n[of[i]] > 0) & (n[of] > 0) & (lo[i] <= hi + radius).all(axis=1) & (lo <= hi[i] + radius).all(axis=1)
        ahead = (there - i) % len(of)  # a part goes to the nearer half of those after it, in a circle
        goes.append(np.flatnonzero(near & (ahead > 0) & ((2 * ahead < len(of)) | ((2 * ahead == len(of)) & (there > i)))))
    return first, parts, goes


def _close(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows of x and of y that may be within the radius, a tile at a time; in single
    precision where what that may be off by is little against the radius."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most, off = (radius + 10.0**-knn.PLACES) ** 2 * (1 + 1e-6), (16 + x.shape[1]) * (xx.max() + yy.max())
    if 1e-6 * off < 0.01 * most:
        x, y, xx, yy, most = *(v.astype(np.float32) for v in (x, y, xx, yy)), np.float32(most + 1e-6 * off)
    else:
        most += 2e-15 * off
    for i in range(0, len(x), 256):
        for j in range(0, len(y), 2048):
            square = x[i : i + 256] @ y[j : j + 2048].T
            square *= -2
            square += xx[i : i + 256, None]
            square += yy[None, j : j + 2048]
            u, v = np.nonzero(square <= most)
            if len(u):
                yield u + i, v + j


def near_pairs(distinct: DataFrame, radius: float, centroids: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs of ``distinct`` (id, vector; L2) no further apart than ``radius``."""
    if radius < 0 or not len(centroids):
        raise Unsupported("a radius of 0 or more and one centroid at least")
    spark = distinct.sparkSession
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))  # no distance from any row
    distinct = keep(distinct.filter(~odd).select("id", "vector"), "classes")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], PAIRS)
    some = distinct.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE).limit(2 * SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    blocks = _Blocks(np.asarray(centroids, dtype=np.float64), knn._matrix(some), n, min(block, max(1024, -(-n // BLOCKS))))
    shared = spark.sparkContext.broadcast((blocks, *_meetings(*_ranges(distinct, blocks), radius, block)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first, parts, goes = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                ids, x = b.slice(i, 8192).column("id").to_numpy(), knn._matrix(b.slice(i, 8192).column("vector"))
                at = blocks.of(blocks.distances(x)[0])
                at = first[at] + (ids * 0x9E3779B1 >> 16) % parts[at]
                slim = x.astype(np.float32)
                whole = (slim == x).all()  # single precision holds them
                for part in np.unique(at):
                    mine = np.flatnonzero(at == part)
                    to = np.concatenate([[part], goes[part]]).astype(np.int32)
                    pack = [ids[mine].tobytes(), (slim if whole else x)[mine].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.arange(len(to)) == 0), *[pa.array([p] * len(to), pa.binary()) for p in pack]], names=["at", "own", "ids", "vectors"])

    def found(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, itself: bool) -> Iterator[pa.RecordBatch]:
        for u, v in _close(x, y, radius):
            if itself:
                u, v = u[u < v], v[u < v]
            d = np.round(np.sqrt(((x[u] - y[v]) ** 2).sum(axis=1)), knn.PLACES) + 0.0
            u, v, d = ids[u[d <= radius]], others[v[d <= radius]], d[d <= radius]
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], names=["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, block = -1, [], None
        for b in batches:
            for at, mine, ids, x in zip(*(b.column(c).to_pylist() for c in ("at", "own", "ids", "vectors"))):
                ids = np.frombuffer(ids, dtype=np.int64)
                x = np.frombuffer(x, dtype=np.float64 if len(x) == 8 * width * len(ids) else np.float32).reshape(len(ids), -1).astype(np.float64)
                # a block's own packs come before those that pass by
                if own and not (mine and at == now):
                    block, own = tuple(np.concatenate(p) for p in zip(*own)), []
                    yield from found(*block, *block, True)
                now = at
                if mine:
                    own.append((ids, x))
                else:
                    yield from found(ids, x, *block, False)
        if own:
            block = tuple(np.concatenate(p) for p in zip(*own))
            yield from found(*block, *block, True)

    width = np.asarray(centroids).shape[1]
    packs = distinct.mapInArrow(dealt, _PACK).repartition("at").sortWithinPartitions("at", F.col("own").desc())
    return packs.mapInArrow(run, PAIRS)


def duplicates(base: VectorTable, radius: float, centroids: np.ndarray, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The near pairs of the table's classes, and the classes' members."""
    return near_pairs(classes(base), radius, centroids, block), members(base)
