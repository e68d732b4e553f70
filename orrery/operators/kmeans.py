"""K-means over a whole table, for few lists or very many.

Seeds come by k-means||: in each of ``SEED_ROUNDS`` rounds every row draws a key, smaller the further
it is from the seeds so far, and the smallest keys become seeds (a weighted sample without
replacement, the same however the table is partitioned). Seeds are weighted by the rows nearest to
them and reduced to the lists' first centroids by weighted k-means++ and Lloyd. Then each Lloyd round
is one pass: tasks add up their rows by list, the sums are merged by list, and k rows come back.

Over ``FLAT`` lists centroids are in two levels: about sqrt(k) groups, fitted the same way, share the
lists by what they cost, and all groups' lists are fitted at once. A row is compared with the groups and
with the lists of its ``NEAR_GROUPS`` nearest ones, so a pass costs about 4 sqrt(k) distances a row.

What reaches the driver and goes out to tasks is the model, k vectors, whose size is checked against
``MODEL_BYTES``. All rows take part in every pass; nothing is sampled but the seeds.

Defined results: rows without an id or a vector take no part; repeated rows count each; a list that
loses all its rows keeps its centroid; fewer different vectors than lists, or an empty table, raise
``TooFewVectors``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, TooFewVectors, Unsupported
from ..functions import distance as D
from ..schema import VectorTable
from .quantize import lloyd

FLAT = 1024
#: Groups whose lists a row is compared with.
NEAR_GROUPS = 3
SEED_ROUNDS = 4
#: Bytes of a model at most.
MODEL_BYTES = 1 << 30
#: Distances that a task computes at a time.
TILE = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), D.TINY)


@dataclass(frozen=True)
class Centroids:
    """Centroids of lists; those of group g, whose centre is ``tops[g]``, are ``first[g]`` to
    ``first[g + 1]``. Without ``tops`` there is one group."""

    lists: np.ndarray
    tops: np.ndarray | None = None
    first: np.ndarray | None = None

    def groups(self, x: np.ndarray, n: int) -> np.ndarray:
        """Each row's n nearest groups, nearest first."""
        if self.tops is None:
            return np.zeros((len(x), 1), dtype=np.int64)
        out = np.zeros((len(x), min(n, len(self.tops))), dtype=np.int64)
        step = max(1, TILE // len(self.tops))
        for i in range(0, len(x), step):
            d = np.round(D.kernel("l2_squared", x[i : i + step], self.tops), 9)
            out[i : i + step] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
        return out

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list, of equally near ones the first, and its squared distance."""
        if self.tops is None:
            return _nearest(x, self.lists)
        at, far = np.full(len(x), len(self.lists)), np.full(len(x), np.inf)
        for g in self.groups(x, NEAR_GROUPS).T:
            order = np.argsort(g, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1) if len(x) else []:
                lo, hi = self.first[g[rows[0]]], self.first[g[rows[0]] + 1]
                new, d = _nearest(x[rows], self.lists[lo:hi])
                better = (d < far[rows]) | ((d == far[rows]) & (new + lo < at[rows]))
                at[rows[better]], far[rows[better]] = new[better] + lo, d[better]
        return at, far


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    step = max(1, TILE // len(centroids))
    for i in range(0, len(x), step):
        d = np.round(D.kernel("l2_squared", x[i : i + step], centroids), 9)
        at[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d[np.arange(len(d)), at[i : i + step]]
    return at, far


@dataclass(frozen=True)
class Fitted:
    """A model and a row a Lloyd round: round, objective (mean squared distance), lists with rows,
    rows of the largest and of the mean list."""

    centroids: Centroids
    rounds: list[tuple[int, float, int, int, float]] = field(default_factory=list)


ROUNDS = "round int, objective double, lists_used long, largest long, mean_size double"


def _matrix(column: pa.Array, spherical: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return unit(x) if spherical else x


def _rows(base: VectorTable) -> DataFrame:
    return base.df.dropna(subset=[base.id_col, base.vector_col]).select(F.col(base.id_col).cast("long").alias("id"), F.col(base.vector_col).alias("vector"))


def update(rows: DataFrame, centroids: Centroids, spherical: bool = False) -> DataFrame:
    """(list, n, total, cost): rows of each list, the sum of their vectors and of squared distances."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids.lists)
    schema = "list int, n long, total array<double>, cost double"

    def batch(at: np.ndarray, n: np.ndarray, total: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * total.shape[1]).astype(np.int32)), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n), lists, pa.array(cost)], names=["list", "n", "total", "cost"])

    def parts(at: np.ndarray, n: np.ndarray, total: np.ndarray, cost: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, (8 << 20) // (8 * total.shape[1]))
        for i in range(0, len(at), step):
            yield batch(at[i : i + step], n[i : i + step], total[i : i + step], cost[i : i + step])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, shared.value.lists.shape[1]))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"), spherical)
                if x.shape[1] != total.shape[1]:
                    raise DimensionMismatch(total.shape[1], x.shape[1])
                at, far = shared.value.assign(x)
                n += np.bincount(at, minlength=k)
                cost += np.bincount(at, far, minlength=k)
                order = np.argsort(at, kind="stable")
                head = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[at[order][head]] += np.add.reduceat(x[order], head)
        some = np.flatnonzero(n)
        yield from parts(some, n[some], total[some], cost[some])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for i, n, t, c in zip(b.column("list").to_pylist(), b.column("n").to_pylist(), _matrix(b.column("total"), False) if b.num_rows else [], b.column("cost").to_pylist()):
                old = sums.get(i)
                sums[i] = [n, t, c] if old is None else [old[0] + n, old[1] + t, old[2] + c]
        if sums:
            at = np.array(sorted(sums))
            yield from parts(at, np.array([sums[i][0] for i in at]), np.stack([sums[i][1] for i in at]), np.array([sums[i][2] for i in at]))

    return rows.select("vector").mapInArrow(summed, schema).repartition("list").mapInArrow(merged, schema)


def _seed_pass(rows: DataFrame, seeds: Centroids, want: np.ndarray, seed: int, round_: int, spherical: bool) -> DataFrame:
    """(group, key, vector): ``want[g]`` rows of each group g, drawn by their squared distance from the
    group's seeds. A task sends as many of its own at most."""
    shared = rows.sparkSession.sparkContext.broadcast((seeds, want))
    u = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(round_)), F.lit(1 << 52)).alias("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, want = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def best() -> tuple[np.ndarray, ...]:
            g, key, x = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((key, g))
            rank = np.arange(len(order)) - np.searchsorted(g[order], g[order])
            order = order[rank < want[g[order]]]
            return g[order], key[order], x[order]

        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vector"), spherical)
            far = seeds.assign(x)[1]
            key = -np.log((b.column("u").to_numpy() + 1.0) / (1 << 52)) / np.maximum(far, 1e-300)
            some = far > 1e-12
            held.append((seeds.groups(x, 1)[some, 0], key[some], x[some]))
            if len(held) >= 16:
                held = [best()]
        if held:
            g, key, x = best()
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(g) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(key), lists], names=["group", "key", "vector"])

    drawn = rows.select("vector", u).mapInArrow(run, "group int, key double, vector array<double>")
    limits = rows.sparkSession.createDataFrame(enumerate(want.tolist()), "g int, most long")  # a row a group
    rank = F.row_number().over(W.partitionBy("group").orderBy("key"))
    return drawn.withColumn("rank", rank).join(F.broadcast(limits), F.col("group") == F.col("g")).filter("rank <= most").select("group", "key", "vector")


def _seeds(rows: DataFrame, groups: Centroids | None, quota: np.ndarray, seed: int, spherical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all groups, more than ``quota`` asks for, the first seed of each group, and their rows."""
    if groups is None:
        first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
        if not first:
            raise TooFewVectors(int(quota.sum()), 0)
        x = np.array([first[0]["vector"]], dtype=np.float64)
        x, of = unit(x) if spherical else x, np.zeros(1, np.int64)
    else:
        x, of = groups.lists, np.arange(len(groups.lists))
    seeds = lambda: Centroids(x, None if groups is None else groups.lists, np.searchsorted(of, np.arange(len(quota) + 1)))
    rounds = SEED_ROUNDS if groups is None else SEED_ROUNDS // 2
    for i in range(3 * SEED_ROUNDS):
        drawn = _seed_pass(rows, seeds(), quota, seed, i, spherical).orderBy("group", "key").collect()
        if drawn:
            x = np.concatenate([x, np.array([r["vector"] for r in drawn])])
            of = np.concatenate([of, np.array([r["group"] for r in drawn], dtype=np.int64)])
            x, at = np.unique(x, axis=0, return_index=True)  # equal vectors may be drawn together
            order = np.lexsort((at, of[at]))
            x, of = x[order], of[at][order]
        if not drawn or (i + 1 >= rounds and (np.bincount(of, minlength=len(quota)) >= quota).all()):
            break
    weight = np.zeros(len(x))
    for r in update(rows, seeds(), spherical).select("list", "n").collect():
        weight[r["list"]] = r["n"]
    return x, seeds().first, weight


def _shared_out(k: int, cost: np.ndarray) -> np.ndarray:
    """k lists for groups, in proportion to their cost, one each at least."""
    share = k * cost / cost.sum() if cost.sum() > 0 else np.full(len(cost), k / len(cost))
    out = np.maximum(np.floor(share), 1).astype(np.int64)
    for g in np.argsort(-(share - out), kind="stable")[: max(0, k - int(out.sum()))]:
        out[g] += 1
    while out.sum() > k:
        out[np.argmax(out)] -= 1
    return out


def _start(rows: DataFrame, groups: Centroids | None, quota: np.ndarray, seed: int, spherical: bool) -> Centroids:
    """First centroids, ``quota[g]`` of each group where it has as many different vectors; what a group
    lacks goes to others."""
    x, first, weight = _seeds(rows, groups, quota, seed, spherical)
    have, want = np.diff(first), quota.copy()
    if len(x) < quota.sum():
        raise TooFewVectors(int(quota.sum()), len(x))
    quota = np.minimum(quota, have)
    while (lack := int(want.sum() - quota.sum())) > 0:
        room = have - quota
        more = np.minimum(room, -(-lack * room // room.sum()))
        quota += np.minimum(more, np.maximum(0, lack - (np.cumsum(more) - more)))
    lists = [lloyd(x[lo:hi], int(q), seed, 10, spherical, np.maximum(weight[lo:hi], 1e-3)) for lo, hi, q in zip(first, first[1:], quota) if q]
    return Centroids(np.concatenate(lists), None if groups is None else groups.lists, np.concatenate([[0], np.cumsum(quota)]))


def _split(lists: np.ndarray, first: np.ndarray | None, n: np.ndarray, cost: np.ndarray, most: float, seed: int) -> np.ndarray:
    """Centroids, the smallest lists' moved into lists of more than ``most`` times the mean: one beside
    the large list's own, half a deviation off. Groups keep their numbers of lists."""
    out, rng = lists.copy(), np.random.default_rng(seed)
    group = np.zeros(len(n), np.int64) if first is None else np.repeat(np.arange(len(first) - 1), np.diff(first))
    large = np.flatnonzero(n > most * n.mean())
    taken = np.zeros(len(n), dtype=bool)
    for i in large[np.argsort(-n[large], kind="stable")].tolist():
        own = np.flatnonzero((group == group[i]) & ~taken & (n < n.mean() / 2))
        if len(own):
            j = own[np.argmin(n[own])]
            taken[j] = True
            step = rng.normal(size=lists.shape[1]) * np.sqrt(cost[i] / n[i] / lists.shape[1]) / 2
            out[i], out[j] = lists[i] - step, lists[i] + step
    return out


def _lloyd(rows: DataFrame, start: Centroids, rounds: int, spherical: bool, tolerance: float, most: float | None = None, seed: int = 0) -> Fitted:
    """Rounds until the objective falls by less than ``tolerance`` of itself, or ``rounds`` are done. The
    last row is of the centroids returned. In the first half of the rounds lists of more than ``most``
    times the mean are split."""
    now, report = start, []
    for i in range(rounds + 1):
        lists, n, cost = now.lists.copy(), np.zeros(len(now.lists), np.int64), np.zeros(len(now.lists))
        for r in update(rows, now, spherical).toLocalIterator():
            lists[r["list"]], n[r["list"]], cost[r["list"]] = np.array(r["total"]) / r["n"], r["n"], r["cost"]
        report.append((i, float(cost.sum()) / max(1, int(n.sum())), int((n > 0).sum()), int(n.max()), float(n.mean())))
        splits = most is not None and i < rounds // 2 and n.max() > most * n.mean()
        if i == rounds or (i and not splits and 0 <= report[-2][1] - report[-1][1] <= tolerance * report[-2][1]):
            return Fitted(now, report)
        lists = _split(lists, now.first, n, cost, most, seed + i) if splits else lists
        now = Centroids(unit(lists) if spherical else lists, now.tops, now.first)
    return Fitted(now, report)


def fit(base: VectorTable, k: int, rounds: int = 15, seed: int = 0, spherical: bool = False, tolerance: float = 1e-3, flat: int = FLAT, most: float | None = None) -> Fitted:
    """Centroids of k lists of all rows; cosine with ``spherical``. With ``most``, lists of more than so
    many times the mean size are split and the smallest merged, at some cost of the objective."""
    dimension = base.dimension() or 1
    if k < 1:
        raise Unsupported(f"{k} lists")
    if 8 * dimension * k * (1 + SEED_ROUNDS // 2) > MODEL_BYTES:
        raise Unsupported(f"{k} lists of {dimension} dimensions and their seeds take more than {MODEL_BYTES} bytes")
    rows, groups, quota = _rows(base), None, np.array([k])
    if k > flat:
        tops = _lloyd(rows, _start(rows, None, np.array([int(np.ceil(np.sqrt(k)))]), seed, spherical), rounds // 2, spherical, tolerance)
        cost = {r["list"]: r["cost"] for r in update(rows, tops.centroids, spherical).select("list", "cost").collect()}
        groups = Centroids(tops.centroids.lists[sorted(cost)])
        quota = _shared_out(k, np.array([cost[i] for i in sorted(cost)]))
    return _lloyd(rows, _start(rows, groups, quota, seed, spherical), rounds, spherical, tolerance, most, seed)
