"""Proximity graphs over shards of bounded size.

A row's shard is a hash of its id, so shards are even and any number of tasks builds them. Inside
a shard the neighbours of each row are its nearest rows thinned by a diversification rule, edges
run both ways, and rows out of reach of the entry are joined to their nearest reached row. A
search walks every shard with a beam and takes the best of all.

Rules, ``c`` a candidate for row ``q`` in order of distance, ``s`` any neighbour kept already:

    rnd   keep if d(q, c) < d(s, c), then fill up with rejects
    rrnd  keep if d(q, c) < alpha * d(s, c), then fill up
    mond  keep if the angle between c and s at q is over 60 degrees, then fill up
    mrng  as rnd, not filled up
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..schema import VectorTable
from . import knn

SHARD_ROWS = 4_000
INDEX = "shard int, id long, vector array<float>, neighbours array<int>, position int"


def thin(d: np.ndarray, between: np.ndarray, limit: int, rule: str, alpha: float = 1.2) -> list[int]:
    """Positions kept of candidates in ascending order of ``d``, their distances to the row;
    ``between`` has those among candidates."""
    kept: list[int] = []
    for c in range(len(d)):
        if len(kept) == limit:
            break
        s = between[c, kept]
        if rule == "mond":
            cos = (d[c] ** 2 + d[kept] ** 2 - s**2) / np.maximum(2 * d[c] * d[kept], D.TINY)
            ok = (cos < 0.5).all()
        else:
            ok = (d[c] < (alpha if rule == "rrnd" else 1.0) * s).all()
        if ok:
            kept.append(c)
    if rule != "mrng":
        for c in range(len(d)):
            if len(kept) >= limit:
                break
            if c not in kept:
                kept.append(c)
    return kept


def build_shard(x: np.ndarray, degree: int, pool: int, rule: str) -> list[list[int]]:
    """Neighbours of each row of a shard."""
    n = len(x)
    out: list[list[int]] = []
    for lo in range(0, n, 512):
        d = D.kernel("l2", x[lo : lo + 512], x)
        for i, row in enumerate(d):
            row[lo + i] = np.inf
            near = np.argsort(row, kind="stable")[: min(pool, n - 1)]
            out.append(near[thin(row[near], D.kernel("l2", x[near], x[near]), degree, rule)].tolist())
    links = [set(v) for v in out]
    for i, v in enumerate(out):
        for j in v:
            links[j].add(i)
    for i in range(n):  # both ways, up to twice the degree
        if len(links[i]) > 2 * degree:
            near = np.array(sorted(links[i]))
            row = D.kernel("l2", x[i : i + 1], x[near])[0]
            order = np.argsort(row, kind="stable")
            near, row = near[order], row[order]
            links[i] = set(near[thin(row, D.kernel("l2", x[near], x[near]), 2 * degree, rule)].tolist())
    _connect(x, links)
    return [sorted(v) for v in links]


def _reached(links: list[set[int]], start: int = 0) -> np.ndarray:
    seen = np.zeros(len(links), dtype=bool)
    seen[start] = True
    todo = deque([start])
    while todo:
        for j in links[todo.popleft()]:
            if not seen[j]:
                seen[j] = True
                todo.append(j)
    return seen


def _connect(x: np.ndarray, links: list[set[int]]) -> None:
    """Join each row out of reach of row 0 to its nearest reached row."""
    while len(links) and not (seen := _reached(links)).all():
        out, inside = np.flatnonzero(~seen)[0], np.flatnonzero(seen)
        near = inside[D.kernel("l2", x[out : out + 1], x[inside])[0].argmin()]
        links[near].add(int(out))
        links[out].add(int(near))


def build(base: VectorTable, degree: int = 16, pool: int = 64, rule: str = "rnd", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index as a table: a row of each vector with its neighbours' positions in its shard."""
    shards = max(1, -(-base.df.count() // shard_rows))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])
        return pdf.assign(neighbours=build_shard(x, degree, pool, rule), position=np.arange(len(pdf), dtype=np.int32))[["shard", "id", "vector", "neighbours", "position"]]

    rows = base.rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.col("vector").cast("array<float>").alias("vector"))
    return rows.groupBy("shard").applyInPandas(make, INDEX)


def beam(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, width: int, entry: int = 0) -> list[tuple[float, int]]:
    """The ``width`` nearest rows that a best-first walk from the entry comes to."""
    first = float(((x[entry] - q) ** 2).sum())
    seen, todo, best = {entry}, [(first, entry)], [(-first, entry)]
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) >= width and d > -best[0][0]:
            break
        new = [j for j in links[i].tolist() if j not in seen]
        seen.update(new)
        for e, j in zip(((x[new] - q) ** 2).sum(axis=1).tolist(), new):
            if len(best) < width or e < -best[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(best, (-e, j))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted((-d, i) for d, i in best)


def _walk(shared, k: int, width: int):  # noqa: ANN001, ANN202
    """Search of one shard for the queries of a broadcast block."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, q = shared.value
        pdf = pdf.sort_values("position")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])
        links, mine = [np.asarray(v, dtype=np.int64) for v in pdf["neighbours"]], pdf["id"].to_numpy()
        rows = [(i, int(mine[at]), round(d**0.5, knn.PLACES)) for i, v in zip(ids.tolist(), q) for d, at in beam(x, links, v, max(width, k))[:k]]
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "distance"])

    return walk


def search(index: DataFrame, queries: VectorTable, k: int, width: int = 64) -> DataFrame:
    """The k nearest by L2 of what a beam of ``width`` finds in each shard."""
    spark = index.sparkSession
    first = index.select(F.size("vector")).first()
    out = spark.createDataFrame([], knn.RESULT)
    if first is None:
        return knn.top_k(out, k)
    for ids, q in knn._blocks(queries.rows, first[0]):
        walk = _walk(spark.sparkContext.broadcast((ids, q)), k, width)
        out = out.union(index.groupBy("shard").applyInPandas(walk, knn.RESULT))
    return knn.top_k(out, k)


def quality(index: DataFrame) -> DataFrame:
    """Rows, edges, least, mean and most neighbours, and rows that the entry reaches, of each shard."""

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        links = [set(map(int, v)) for v in pdf.sort_values("position")["neighbours"]]
        n = np.array([len(v) for v in links])
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), len(n), int(n.sum()), int(n.min()), float(n.mean()), int(n.max()), int(_reached(links).sum()))], columns=["shard", "n_rows", "n_edges", "least", "mean", "most", "n_reached"])

    return index.groupBy("shard").applyInPandas(look, "shard int, n_rows long, n_edges long, least long, mean double, most long, n_reached long")


def neighbour_graph(base: VectorTable, queries: VectorTable, k: int) -> DataFrame:
    """Exact edges (src, dst, distance) from the stated rows to their k nearest."""
    near = knn.knn_join(base, queries, k, "l2", exclude_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), "distance")

