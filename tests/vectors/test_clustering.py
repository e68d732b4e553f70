import numpy as np
import pytest
from orrery.errors import Unsupported
from orrery.operators import clustering, neighbours
from orrery.schema import VectorTable


def blobs(n, seed=0, dim=6):
    """A third of the rows in one dense blob, which two smaller ones stand near, and noise."""
    rng = np.random.default_rng(seed)
    sizes = [n // 3, n // 8, n // 8, n // 5]
    centres = [np.zeros(dim), np.eye(dim)[0] * 2.0, np.eye(dim)[1] * 2.0, np.ones(dim) * 5]
    x = [c + rng.normal(size=(m, dim)) * 0.25 for c, m in zip(centres, sizes)]
    x.append(rng.uniform(-8, 8, size=(n - sum(sizes), dim)))
    return np.concatenate(x)[rng.permutation(n)]


def exact_graph(x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 6)
    np.fill_diagonal(d, np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :k]
    return [(i, int(j), float(d[i, j])) for i in range(len(x)) for j in near[i]]


def plain_mutual(graph, k):
    core, out = {}, {}
    for i, j, d in graph:  # in order of distance
        core.setdefault(i, []).append(d)
    core = {i: v[:k][-1] for i, v in core.items()}
    for i, j, d in graph:
        out[min(i, j), max(i, j)] = max(d, core.get(i, 0), core.get(j, 0))
    return sorted((w, a, b) for (a, b), w in out.items())


def plain(edges, at, min_size):
    """Forest, clusters by layer and picked labels, by joining edges one by one."""
    ids = sorted({i for _, a, b in edges for i in (a, b)})
    root, forest, layers = {i: i for i in ids}, [], []
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    left = list(edges)
    for t in at:
        while left and left[0][0] <= t:
            w, a, b = left.pop(0)
            x, y = sorted((top(a), top(b)))
            if x != y:
                root[y] = x
                forest.append((a, b, w))
        sets = {}
        for i in ids:
            sets.setdefault(top(i), []).append(i)
        layers.append({r: v for r, v in sets.items() if len(v) >= min_size})

    def best(layer, r):
        """(own, split, picked) of the chain of clusters that ends here."""
        span = round(1e9 * (1 / at[layer] - 1 / at[layer + 1])) if layer + 1 < len(at) else 0
        mass = len(layers[layer][r]) * span
        kids = [best(layer - 1, q) for q in layers[layer - 1] if q in set(layers[layer][r])] if layer else []
        if len(kids) == 1:
            own, split, below = mass + kids[0][0], kids[0][1], kids[0][3]
        else:
            own, split, below = mass, sum(max(k[0], k[1]) for k in kids), [p for k in kids for p in k[2]]
        return own, split, [(layer, r)] if own >= split else below, below
    picked = [p for r in layers[-1] for p in best(len(at) - 1, r)[2]]
    labels = {i: (r, la) for la, r in picked for i in layers[la][r]}
    return forest, layers, {i: labels.get(i, (None, None)) for i in ids}


@pytest.mark.parametrize(("n", "rest"), [(2000, clustering.REST), (150, 0)])
def test_against_joining_edges_one_by_one(spark, n, rest):
    x = blobs(n)
    graph = exact_graph(x, 8)
    edges = plain_mutual(graph, 5)
    got_edges = clustering.mutual(spark.createDataFrame(graph, neighbours.EDGES), 5)
    assert {(r.weight, r.a, r.b) for r in got_edges.collect()} == set(edges)
    at = sorted({float(np.quantile([e[0] for e in edges], q)) for q in (0.2, 0.5, 0.7, 0.85, 0.95)})[: 5 if n > 1000 else 2]
    got = clustering.layers(got_edges, at, 10, rest)
    forest, layers, labels = plain(edges, at, 10)
    assert sorted((r.a, r.b, r.weight) for r in got.forest.collect()) == sorted(forest)
    rows = got.members.collect()
    assert {(r.layer, r.id, r.cluster, r.n) for r in rows if r.cluster is not None} == {(la, i, r, len(v)) for la, s in enumerate(layers) for r, v in s.items() for i in v}
    assert len(rows) == len(at) * len(labels)
    assert {r.id: (r.label, r.layer) for r in got.labels().collect()} == labels
    if n > 1000:
        assert len({v for v in labels.values() if v[0] is not None}) >= 3
        counts = {r.layer: r.n_clusters for r in got.counts().collect()}
        assert counts == {la: len(s) for la, s in enumerate(layers)}
        assert counts[got.layer_of(3)] == min(counts.values(), key=lambda c: abs(c - 3))


def test_chain_star_ties_and_odd_rows(spark):
    """A chain whose edges ascend hooks into one long path, a star's edges are all equal."""
    chain = [(i, i + 1, float(i + 1)) for i in range(40)]
    star = [(100, 101 + i, 1.0) for i in range(40)]
    odd = [(5, 5, 0.1), (None, 3, 1.0), (1, 0, 9.0), (200, 201, 3.0), (201, 200, 2.0)]
    edges = spark.createDataFrame([(*e, 7) for e in chain + star + odd], "a long, b long, weight double, u long")
    got = clustering.layers(edges, [20.0, 30.0], 2, 0)
    assert {(r.layer, r.cluster, r.n) for r in got.members.filter("cluster is not null").collect()} == {(0, 0, 21), (1, 0, 31), (0, 100, 41), (1, 100, 41), (0, 200, 2), (1, 200, 2)}
    assert got.forest.count() == 30 + 40 + 1 and got.forest.filter("a = 200").first().weight == 2.0
    assert got.members.filter("cluster is null").count() == 20 + 10
    none = clustering.layers(edges.limit(0), [1.0], 2)
    assert none.members.count() == none.forest.count() == none.labels().count() == 0 and none.layer_of(2) is None
    assert clustering.thresholds(edges.limit(0)) == [] and clustering.thresholds(edges, 2)[-1] == 40.0
    for bad in ([], [2.0, 1.0], [0.0]):
        with pytest.raises(Unsupported):
            clustering.layers(edges, bad)


def table(spark, x):
    return VectorTable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))


def recall(got, truth):
    have = {(r.src, r.dst) for r in got.collect()}
    return len(have & {(a, b) for a, b, _ in truth}) / len(truth)


def test_one_leaf_is_exact_and_descent_improves(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    truth = exact_graph(x, 10)
    base = table(spark, x)
    assert {(r.src, r.dst, r.distance) for r in neighbours.leaf_graph(base, 10, 1500).collect()} == set(truth)
    start = neighbours.leaf_graph(base, 10, 200, 2)
    assert max(start.groupBy("src").count().collect(), key=lambda r: r["count"])["count"] <= 10
    before, end = recall(start, truth), neighbours.graph(base, 10, 200, 2)
    assert before < 0.9 < 0.95 <= recall(end, truth)
    assert end.count() == 15000


def test_graph_of_copies_and_odd_rows(spark):
    rows = [(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, None, 1), (None, [2.0, 0.0], 1), (5, [3.0, 0.0], 1)]
    base = VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, src long"))
    assert {(r.src, r.dst, r.distance) for r in neighbours.graph(base, 1).collect()} == {(1, 3, 1.0), (3, 1, 1.0), (5, 3, 2.0)}
    assert neighbours.graph(VectorTable(base.df.limit(0)), 3).count() == neighbours.graph(base, 0).count() == 0
    with pytest.raises(Unsupported):
        neighbours.leaf_graph(base, 3, 1)
