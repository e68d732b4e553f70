"""Exact L2 neighbours in few dimensions: rows and queries meet in the leaves of a k-d tree.

``knn_join`` compares every query with every row. In few dimensions most rows can be left out: a
query's k nearest rows of a sample bound its k-th distance, and only leaves whose box comes that near
can hold one of its k. The tree and the sample are bounded and shared; rows are shuffled to their leaf,
queries to the leaves that they need, and both are read a batch at a time.

The tree decides how much is compared, never what is found. In a leaf, of rows with equal vectors only
the k smallest ids are held, as no others can be among a query's k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..functions import distance as D
from ..schema import VectorTable
from . import knn
from .partitioned import Tree

#: Rows that a leaf should have, rows of the sample a leaf, and the most leaves.
LEAF_ROWS, LEAF_SAMPLE, MOST_LEAVES = 4096, 48, 4096
_MET = "leaf int, bound double, id long, vector array<double>"


def _sample(rows: DataFrame, n: int, wanted: int) -> np.ndarray:
    """About ``wanted`` of the ``n`` rows, by a hash of their ids; never over twice as many."""
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < wanted).limit(2 * wanted) if n > wanted else rows
    return knn._matrix(some.select("vector").toArrow().column("vector").combine_chunks())


class _Boxes:
    """The tree's leaves as boxes, and the sample's rows by leaf."""

    def __init__(self, x: np.ndarray, depth: int, k: int):
        x = x[np.isfinite(x).all(axis=1)]
        self.tree, self.k = Tree(x, depth, "axes"), k
        at = self.tree.leaf(x)
        self.x = x[np.argsort(at, kind="stable")]
        self.first = np.searchsorted(np.sort(at), np.arange(2**depth + 1))
        lo, hi = np.full((1, x.shape[1]), -np.inf), np.full((1, x.shape[1]), np.inf)
        for level in range(depth):
            node = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            axis, row = self.tree.normal[node].argmax(axis=1), np.arange(len(node))
            left, right = hi.copy(), lo.copy()
            left[row, axis] = np.minimum(left[row, axis], self.tree.at[node])
            right[row, axis] = np.maximum(right[row, axis], self.tree.at[node])
            lo, hi = np.stack([lo, right], axis=1).reshape(-1, x.shape[1]), np.stack([left, hi], axis=1).reshape(-1, x.shape[1])
        self.lo, self.hi = lo, hi

    def bound(self, q: np.ndarray) -> np.ndarray:
        """What the k-th distance of each query is at most."""
        out, leaf = np.full(len(q), np.inf), self.tree.leaf(q)
        order = np.argsort(leaf, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(q) else []:
            lo, hi = self.first[leaf[mine[0]] :][:2]
            near = self.x[lo:hi] if hi - lo >= self.k else self.x
            for i in range(0, len(mine) if len(near) >= self.k else 0, step := max(1, (1 << 20) // len(near))):
                some = mine[i : i + step]
                d = sum((q[some, None, c] - near[None, :, c]) ** 2 for c in range(q.shape[1]))
                out[some] = np.sqrt(np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        return out * (1 + 1e-9) + 10.0**-knn.PLACES

    def needed(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries and the leaves that come within their bounds."""
        found = []
        for i in range(0, len(q), step := max(1, (1 << 20) // len(self.lo))):
            p = q[i : i + step]
            d = sum(np.maximum(np.maximum(self.lo[None, :, c] - p[:, None, c], p[:, None, c] - self.hi[None, :, c]), 0) ** 2 for c in range(q.shape[1]))
            which, leaf = np.nonzero(np.sqrt(d) <= bound[i : i + step, None])
            found.append((which + i, leaf))
        return tuple(np.concatenate(a) for a in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


class _Leaf:
    """A leaf's rows so far; of equal vectors those of the k smallest ids."""

    def __init__(self, k: int):
        self.k, self.ids, self.x, self.more, self.most = k, None, None, [], LEAF_ROWS

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.more.append((ids, x))
        if sum(len(i) for i, _ in self.more) > self.most:
            self.settle()

    def settle(self) -> None:
        parts = ([] if self.ids is None else [(self.ids, self.x)]) + self.more
        if not self.more:
            return
        ids, x = (np.concatenate(a) for a in zip(*parts))
        order = np.lexsort((ids, *x.T))
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = np.arange(len(ids)) - first < self.k
        self.ids, self.x, self.more = ids[keep], x[keep], []
        self.most = max(LEAF_ROWS, len(self.ids))

    def answer(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.settle()
        for i in range(0, len(ids) if self.ids is not None else 0, knn.TILE_QUERIES):
            part = slice(i, i + knn.TILE_QUERIES)
            nearest = knn.Nearest(ids[part], q[part], self.k, "l2")
            nearest.see(self.ids, self.x)
            nearest.distance[nearest.distance > bound[part, None]] = np.inf
            yield nearest.result()


def leaf_knn(base: VectorTable, queries: VectorTable, k: int) -> DataFrame:
    """The k nearest rows of ``base`` by L2 to each query, as ``knn_join`` finds them."""
    spark = base.df.sparkSession
    rows = base.rows.select("id", D.as_double(F.col("vector")).alias("vector"))
    asked = queries.rows.select("id", D.as_double(F.col("vector")).alias("vector"))
    dimension = base.dimension()
    if k <= 0 or dimension is None:
        return spark.createDataFrame([], knn.RESULT + ", rank int")
    n = rows.count()
    depth = max(0, math.ceil(math.log2(min(MOST_LEAVES, max(1, n / LEAF_ROWS)))))
    boxes = spark.sparkContext.broadcast(_Boxes(_sample(rows, n, max(LEAF_SAMPLE, k) * 2**depth), depth, k))

    def batch(leaf: np.ndarray, bound: np.ndarray, ids: pa.Array, vectors: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(bound), ids, vectors], names=["leaf", "bound", "id", "vector"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = knn._matrix(b.column("vector"))
                there = np.flatnonzero(np.isfinite(x).all(axis=1))  # others have no distance
                at = pa.array(there)
                yield batch(boxes.value.tree.leaf(x[there]), np.full(len(there), -1.0), b.column("id").take(at), b.column("vector").take(at))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = knn._matrix(b.column("vector"))
            if q.shape[1] != dimension:
                raise DimensionMismatch(dimension, q.shape[1])
            bound = boxes.value.bound(q)
            which, leaf = boxes.value.needed(q, bound)
            for i in range(0, len(which), 1 << 14):
                at = pa.array(which[i : i + (1 << 14)])
                yield batch(leaf[i : i + (1 << 14)], bound[which[i : i + (1 << 14)]], b.column("id").take(at), b.column("vector").take(at))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf = -1, _Leaf(k)
        for b in batches:
            at, bound = b.column("leaf").to_numpy(), b.column("bound").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            for lo, hi in zip(edge, [*edge[1:], len(at)]):
                if at[lo] != now:
                    now, leaf = at[lo], _Leaf(k)
                mid = lo + int((bound[lo:hi] < 0).sum())  # a leaf's rows come before its queries
                ids, x = b.column("id").to_numpy()[lo:hi], knn._matrix(b.column("vector").slice(lo, hi - lo))
                if mid > lo:
                    leaf.add(ids[: mid - lo], x[: mid - lo])
                if hi > mid:
                    yield from leaf.answer(ids[mid - lo :], x[mid - lo :], bound[mid:hi])

    met = rows.mapInArrow(dealt, _MET).union(asked.mapInArrow(asking, _MET))
    return knn.top_k(met.repartition("leaf").sortWithinPartitions("leaf", "bound").mapInArrow(compared, knn.RESULT), k)
