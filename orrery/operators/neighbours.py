"""The approximate k-nearest-neighbour graph of a whole table.

``leaf_graph`` starts it: every vector goes to its ``overlap`` nearest lists of k-means over the whole
table, lists over ``leaf`` rows are dealt at random into leaves of that size, and all pairs of a leaf
are compared. ``descend`` improves it by rounds of NN-descent: a node's neighbours, forward and up to
``sample`` of its reverse ones, are likely neighbours of each other, so they are gathered with their
vectors and compared where one of the two came in since the round before. Rounds end when fewer than
``least`` of all edges changed. Only k rows a node are kept, so the work grows with the rows; each
round is written down.

Sampling reverse neighbours, those of the smallest hashes in each round, is the method's own bound on a
node that very many have as neighbour; the forward edges of these are all there. The graph is
approximate for it: tests hold its recall against the exact one.

Nodes are different vectors, named by the smallest id that has them (``pairs.members`` has the rest), so
copies fill no one's list. Edges are (src, dst, distance): L2 rounded to six places, of equally near
ones the smaller id, at most k a node.

Defined results: rows without an id or a vector take no part; of several vectors with one id one
counts; an empty table, or k of 0, gives an empty graph, one vector no edge; vectors of different
length raise ``DimensionMismatch``; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..functions import distance as D
from ..schema import VectorTable
from . import kmeans, knn, pairs
from .shared import groups, keep

LEAF = 1024
EDGES = "src long, dst long, distance double"


def _near_lists(centroids: kmeans.Centroids, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's n nearest lists, as (row, list) pairs."""
    rows, lists, far = [], [], []
    for g in centroids.groups(x, kmeans.NEAR_GROUPS).T:
        for group in np.unique(g):
            of = np.flatnonzero(g == group)
            lo, hi = (0, len(centroids.lists)) if centroids.first is None else centroids.first[group : group + 2]
            d = D.kernel("l2_squared", x[of], centroids.lists[lo:hi])
            near = np.argsort(d, axis=1, kind="stable")[:, :n]
            rows.append(np.repeat(of, near.shape[1]))
            lists.append((near + lo).ravel())
            far.append(np.take_along_axis(d, near, axis=1).ravel())
    row, list_, d = np.concatenate(rows), np.concatenate(lists), np.concatenate(far)
    order = np.lexsort((list_, d, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], np.arange(len(x)))[row[order]]
    top = order[rank < n]
    return row[top], list_[top]


def _leaves(distinct: DataFrame, centroids: kmeans.Centroids, overlap: int, leaf: int) -> DataFrame:
    """(list, part, id, vector): a row for each leaf that a vector is in."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                p = b.slice(i, 1024)
                row, at = _near_lists(shared.value, knn._matrix(p.column("vector")).astype(np.float64), overlap)
                taken = p.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), taken.column("id"), taken.column("vector")], names=["list", "id", "vector"])

    placed = distinct.select("id", "vector").mapInArrow(run, "list int, id long, vector array<double>")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / leaf).cast("int").alias("parts"))
    return placed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id", "list"), F.col("parts")).cast("int").alias("part"), "id", "vector")


def _k_nearest(edges: DataFrame, k: int, *more: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst", "distance", *more)


def _within(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["list", "part"]):
            ids, x = t.column("id").to_numpy(), knn._matrix(t.column("vector").combine_chunks())
            near = knn.Nearest(ids, x, k, "l2", exclude_self=True)
            near.see(ids, x)
            yield near.result().rename_columns(["src", "dst", "distance"])

    return run


def leaf_graph(base: VectorTable, k: int, leaf: int = LEAF, overlap: int = 3, seed: int = 0) -> DataFrame:
    """Each vector's k nearest of those that share a leaf with it. A table of at most ``leaf`` vectors is
    one leaf, and its graph is exact."""
    if k < 0 or leaf < 2 or overlap < 1:
        raise Unsupported("k of 0 or more, leaves of two rows or more, one list a row at least")
    distinct = keep(pairs.classes(base), "distinct")
    n = distinct.count()
    if k == 0 or n < 2:
        return distinct.sparkSession.createDataFrame([], EDGES)
    lists = 1 if n <= leaf else -(-2 * n * overlap // leaf)
    if lists == 1:
        centroids = kmeans.Centroids(np.zeros((1, VectorTable(distinct, "id", "vector").dimension())))
    else:
        centroids = kmeans.fit(VectorTable(distinct, "id", "vector"), lists, 6, seed).centroids
    dealt = _leaves(distinct, centroids, overlap, leaf).repartition("list", "part").sortWithinPartitions("list", "part")
    # a pair may meet in several leaves
    return keep(_k_nearest(dealt.mapInArrow(_within(k), EDGES).distinct(), k), "edges")


def _joined(k: int):  # noqa: ANN202
    """The k nearest that each member of a node's group finds there, looking at pairs with a new member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["node"]):
            ids, fresh = t.column("id").to_numpy(), t.column("fresh").to_numpy()
            if len(ids) < 2 or not fresh.any():
                continue
            x = knn._matrix(t.column("vector").combine_chunks())
            d = np.round(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0)), knn.PLACES) + 0.0
            d[~(fresh[:, None] | fresh[None, :])] = np.inf
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            row, found = np.repeat(np.arange(len(ids)), near.shape[1]), np.take_along_axis(d, near, axis=1).ravel()
            some = np.isfinite(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[some]]), pa.array(ids[near.ravel()[some]]), pa.array(found[some]), pa.array([True] * int(some.sum()))], names=["src", "dst", "distance", "fresh"])

    return run


def descend(base: VectorTable, graph: DataFrame, k: int, rounds: int = 6, sample: int | None = None, least: float = 0.01) -> DataFrame:
    """``graph`` (src, dst, distance) after rounds of descent over the vectors of ``base``."""
    sample = k if sample is None else sample
    distinct = keep(pairs.classes(base), "distinct")
    now = keep(graph.select("src", "dst", "distance", F.lit(True).alias("fresh")), "edges")
    n = now.count()
    for i in range(rounds):
        order = F.row_number().over(W.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("id", "node", F.lit(i)), "id"))
        back = now.select(F.col("dst").alias("node"), F.col("src").alias("id"), "fresh").withColumn("r", order).filter(F.col("r") <= sample).drop("r")
        members = now.select(F.col("src").alias("node"), F.col("dst").alias("id"), "fresh").union(back)
        members = members.groupBy("node", "id").agg(F.max("fresh").alias("fresh"))
        dealt = members.join(distinct, "id").select("node", "id", "fresh", "vector").repartition("node").sortWithinPartitions("node", "id")
        found = dealt.mapInArrow(_joined(k), EDGES + ", fresh boolean")
        # an edge that was there before stays an old one
        merged = now.withColumn("fresh", F.lit(False)).union(found).groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
        now = keep(_k_nearest(merged, k, "fresh"), "edges")
        if now.filter("fresh").count() <= least * n:
            break
    return now.select("src", "dst", "distance")


def graph(base: VectorTable, k: int, leaf: int = LEAF, overlap: int = 3, rounds: int = 6, width: int | None = None, seed: int = 0) -> DataFrame:
    """Leaves, then descent with ``width`` neighbours a node (twice k), of which the k nearest are left."""
    width = max(k, 2 * k if width is None else width)
    return _k_nearest(descend(base, leaf_graph(base, width, leaf, overlap, seed), width, rounds), k)
