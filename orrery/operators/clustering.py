"""Clusters in layers, noise and labels by density, from the edges of a neighbour graph.

An edge's weight is its mutual reachability: the largest of its length and both ends' core distances
(to the k-th neighbour). At a threshold, the components of the edges that weigh no more are that layer's
clusters; those of fewer than ``min_size`` rows are noise. Layers nest, so the thresholds give a tree of
clusters, the condensed tree read at these weights. ``labels`` picks from it the clusters that hold the
most excess of mass, rows times the range of density (one over the weight) over which they last: a
cluster, or the best of those it splits into, never both.

The layers are found by Boruvka's method: in a round every component chooses its least edge to
another one, chosen edges join components, and between two components the least edge is left. Edges
are taken by threshold, so one run gives the layers and the minimum spanning forest. A round
aggregates with map-side minima and follows pointers by doubling, and is written down; components at
least halve. What is left of ``REST`` edges or fewer is joined in one task, with the same result.

Edges are ordered by weight, then ends, so all results are fixed by the edges alone. A component is named
by its smallest id.

Defined results: of several edges between two ids the shortest counts; edges from an id to itself, or
with a null, count for nothing; ids without any edge aren't listed; no edges give empty tables;
thresholds must ascend and be positive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Unsupported
from .shared import keep

#: Edges at most that one task joins.
REST = 1 << 12
_DONE = "joins boolean, x long, y long, weight double"


def mutual(graph: DataFrame, k: int) -> DataFrame:
    """(a, b, weight) of a neighbour graph (src, dst, distance): each node's core distance is that of its
    k-th edge, or of its last if it has fewer; nodes that only others have as neighbour add none."""
    edges = graph.dropna(subset=["src", "dst", "distance"]).filter("src <> dst").select("src", "dst", "distance")
    near = F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))
    core = edges.withColumn("r", near).filter(F.col("r") <= k).groupBy("src").agg(F.max("distance").alias("core"))
    core = keep(core.select(F.col("src").alias("id"), "core"), "core")
    single = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("distance").alias("d"))
    with_a = single.join(core.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a", "left")
    with_b = with_a.join(core.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b", "left")
    return with_b.select("a", "b", F.greatest("d", "core_a", "core_b").alias("weight"))


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = sorted((w, u, v, a, b) for t in batches for w, u, v, a, b in zip(*(t.column(c).to_pylist() for c in ("weight", "u", "v", "a", "b"))))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for w, u, v, a, b in edges:
        a, b = sorted((top(a), top(b)))
        if a != b:
            up[b] = a
            out.append((True, u, v, w))
    out += [(False, x, top(x), None) for x in list(up) if top(x) != x]
    yield pa.RecordBatch.from_pylist([dict(zip(("joins", "x", "y", "weight"), r)) for r in out], schema=pa.schema([("joins", pa.bool_()), ("x", pa.int64()), ("y", pa.int64()), ("weight", pa.float64())]))


def _moved(nodes: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``nodes`` with the ids of ``column`` taken to their roots; those that ``to`` doesn't name stay."""
    roots = to.select(F.col("node").alias(column), F.col("root").alias("_to"))
    joined = nodes.join(roots, column, "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_to").select(nodes.columns)


def _least(edges: DataFrame, to: DataFrame) -> DataFrame:
    """The least edge between each two components after a move."""
    ends = _moved(_moved(edges, "a", to), "b", to).filter("a <> b")
    least = ends.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("weight", "u", "v")).alias("e"))
    return least.select(F.col("x").alias("a"), F.col("y").alias("b"), "e.weight", "e.u", "e.v")


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each component's least edge, and (node, root) for every component with one."""
    both = edges.select("a", "b", "weight", "u", "v").union(edges.select("b", "a", "weight", "u", "v"))
    pick = keep(both.groupBy("a").agg(F.min(F.struct("weight", "u", "v", "b")).alias("e")).select("a", "e.*"), "picked")
    # two that chose each other are a root and its child; all else leads to such a pair
    back = pick.select(F.col("a").alias("b"), F.col("b").alias("back"))
    hooked = pick.join(back, "b").select(F.col("a").alias("node"), F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("root"))
    hooked = keep(hooked, "hooked")
    while True:
        # two doublings a write
        twice = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("root").alias("was"), F.col("next").alias("root"))
        further = twice.select(F.col("node").alias("root"), F.col("root").alias("further"))
        hooked = keep(twice.join(further, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("was")).alias("on")), "hooked")
        if not hooked.filter("on").limit(1).count():
            break
    named = hooked.groupBy("root").agg(F.min("node").alias("name"))
    return pick, keep(hooked.join(named, "root").select("node", F.col("name").alias("root")), "roots")


def _joined(edges: DataFrame, rest: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The spanning forest of ``edges`` (a, b, weight, u, v) and (node, root) of nodes that aren't their own;
    nothing without edges."""
    forest: list[DataFrame] = []
    roots: DataFrame | None = None
    while (n := edges.count()) > rest:
        pick, to = _round(edges)
        forest.append(pick.select("u", "v", "weight").distinct())
        new = to.filter("node <> root")
        roots = keep(new if roots is None else _moved(roots, "root", to).union(new), "roots")
        edges = keep(_least(edges, to), "edges")
    if n:
        # no more than ``rest`` rows, which were counted
        done = keep(edges.coalesce(1).mapInArrow(_kruskal, _DONE), "rest")
        forest.append(done.filter("joins").select(F.col("x").alias("u"), F.col("y").alias("v"), "weight"))
        new = done.filter("not joins").select(F.col("x").alias("node"), F.col("y").alias("root"))
        roots = new if roots is None else keep(_moved(roots, "root", new).union(new), "roots")
    return forest, roots


@dataclass(frozen=True)
class Layers:
    """``members`` (layer, id, cluster, n): layers from 0, the finest; a null cluster is noise, n then is
    null too. ``forest`` (a, b, weight): the minimum spanning forest of edges up to the last threshold."""

    members: DataFrame
    forest: DataFrame
    thresholds: tuple[float, ...]

    def tree(self) -> DataFrame:
        """(layer, cluster, n, parent): the cluster of the next layer that holds it; null in the last."""
        nodes = self.members.filter("id = cluster").select("layer", "cluster", "n")
        above = self.members.select((F.col("layer") - 1).alias("layer"), F.col("id").alias("cluster"), F.col("cluster").alias("parent"))
        return nodes.join(above, ["layer", "cluster"], "left")

    def counts(self) -> DataFrame:
        """(layer, threshold, n_clusters, n_noise)."""
        each = self.members.groupBy("layer").agg(F.count(F.when(F.col("id") == F.col("cluster"), 1)).alias("n_clusters"), F.count(F.when(F.col("cluster").isNull(), 1)).alias("n_noise"))
        return each.withColumn("threshold", F.array(*map(F.lit, self.thresholds))[F.col("layer")])

    def layer_of(self, n_clusters: int) -> int | None:
        """The layer with the number of clusters nearest to ``n_clusters``; of several the finest."""
        near = self.counts().orderBy(F.abs(F.col("n_clusters") - n_clusters), "layer").first()
        return near and near["layer"]

    def labels(self) -> DataFrame:
        """(id, label, layer): the picked cluster of each id and the layer it is picked in, or nulls."""
        tree = keep(self.tree(), "tree")
        levels, below = [], None
        for i, t in enumerate(self.thresholds):
            # whole numbers, so that sums don't depend on their order
            span = round(1e9 * (1 / t - 1 / self.thresholds[i + 1])) if i + 1 < len(self.thresholds) else 0
            now = tree.filter(F.col("layer") == i).withColumn("mass", F.col("n").cast("decimal(38,0)") * span)
            if below is None:
                now = now.withColumn("own", F.col("mass").cast("decimal(38,0)")).withColumn("split", F.lit(0).cast("decimal(38,0)"))
            else:
                kids = below.groupBy(F.col("parent").alias("cluster")).agg(
                    F.count("*").alias("kids"), F.sum(F.greatest("own", "split")).alias("best"), F.max("own").alias("kid_own"), F.max("split").alias("kid_split")
                )
                one = F.col("kids") == 1
                now = now.join(kids, "cluster", "left")
                now = now.withColumn("own", (F.col("mass") + F.when(one, F.col("kid_own")).otherwise(0)).cast("decimal(38,0)"))
                now = now.withColumn("split", F.when(one, F.col("kid_split")).otherwise(F.coalesce("best", F.lit(0))).cast("decimal(38,0)"))
            below = keep(now.select("layer", "cluster", "parent", "own", "split"), "level")
            levels.append(below)
        picked, left = [], levels[-1]
        for i in reversed(range(len(levels))):
            picked.append(left.filter("own >= split").select("layer", "cluster"))
            if i:
                gone = left.filter("own < split").select(F.col("cluster").alias("parent"))
                left = keep(levels[i - 1].join(gone, "parent"), "left")
        some = keep(reduce(DataFrame.union, picked), "picked")
        found = self.members.join(some, ["layer", "cluster"]).select("id", F.col("cluster").alias("label"), "layer")
        return self.members.filter("layer = 0").select("id").join(found, "id", "left")


def thresholds(edges: DataFrame, n: int = 16) -> list[float]:
    """At most n weights at equal shares of ``edges`` (a, b, weight), to within a ten-thousandth of them."""
    got = edges.filter("weight > 0").agg(F.percentile_approx("weight", [(i + 1) / n for i in range(n)], 10000)).first()[0]
    return sorted(set(got or []))


def layers(edges: DataFrame, at: Sequence[float], min_size: int = 10, rest: int = REST) -> Layers:
    """Clusters of ``edges`` (a, b, weight) at ascending thresholds."""
    if not at or any(t <= 0 for t in at) or any(s >= t for s, t in zip(at, at[1:])) or min_size < 1:
        raise Unsupported("ascending thresholds over 0, and clusters of one row or more")
    edges = edges.dropna(subset=["a", "b", "weight"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    edges = keep(edges.groupBy("a", "b").agg(F.min("weight").alias("weight")).withColumns({"u": F.col("a"), "v": F.col("b")}), "edges")
    now = keep(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id")), "members")
    forest, layered = [edges.filter("false").select("u", "v", "weight")], []
    for i, t in enumerate(at):
        chosen, roots = _joined(edges.filter(F.col("weight") <= t), rest)
        if chosen:
            forest += chosen
            now = keep(_moved(now, "root", roots), "members")
            edges = keep(_least(edges.filter(F.col("weight") > t), roots), "edges")
        layered.append(now.select(F.lit(i).alias("layer"), "id", "root"))
    every = reduce(DataFrame.union, layered)
    sizes = every.groupBy("layer", "root").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    members = keep(every.join(sizes, ["layer", "root"], "left").select("layer", "id", F.when(F.col("n").isNotNull(), F.col("root")).alias("cluster"), "n"), "layers")
    return Layers(members, reduce(DataFrame.union, forest).select(F.col("u").alias("a"), F.col("v").alias("b"), "weight"), tuple(float(t) for t in at))
