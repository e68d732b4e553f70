import numpy as np
import pytest
from orrery.errors import DimensionMismatch, DuplicateId, EmptyQuery, NonFinite, NotNormalised, Unsupported
from orrery.functions import distance as D
from orrery.operators import knn, partitioned, quantize
from orrery.operators import graph as graphs
from orrery.operators import predicates as P
from orrery.plans import router
from orrery.schema import VectorTable
from pyspark.sql import functions as F


def vectors(spark, n=600, d=16, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    x = centres[rng.integers(clusters, size=n)] + 0.4 * rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), int(i % 10)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    return VectorTable(df.repartition(5).cache()), x.astype(np.float32).astype(np.float64)


def exact(x, q, k, metric="l2", allowed=None):
    d = np.round(D.kernel(metric, x, x[q][None])[:, 0], 6)
    ids = np.arange(len(x)) if allowed is None else np.flatnonzero(allowed)
    return ids[np.lexsort((ids, d[ids]))][:k].tolist()


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.doc_id)
    return out


@pytest.fixture(scope="module")
def data(spark):
    base, x = vectors(spark)
    return base, x, VectorTable(base.df.filter("vec_id % 50 = 0"))


@pytest.mark.parametrize("metric", D.METRICS)
def test_expression_and_kernel_agree(data, metric):
    base, x, asked = data
    pairs = base.rows.crossJoin(asked.rows.select(F.col("id").alias("qid"), F.col("vector").alias("q")))
    for r in pairs.select("id", "qid", D.distance(metric, F.col("vector"), F.col("q")).alias("d")).collect():
        assert r.d == pytest.approx(D.kernel(metric, x[r.id][None], x[r.qid][None])[0, 0], abs=1e-6)
    assert found(knn.knn_join(base, asked, 7, metric)) == {q: exact(x, q, 7, metric) for q in range(0, 600, 50)}


def test_zero_vectors_and_ties(spark):
    t = VectorTable(spark.createDataFrame([(i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "vec_id long, embedding array<float>"))
    rows = {(r.query_id, r.rank): (r.doc_id, r.distance) for r in knn.knn_join(t, t, 9, "cosine").collect()}
    assert rows[1, 1] == (1, 0.0) and rows[1, 2] == (2, 0.0) and rows[0, 1] == (0, 1.0) and len(rows) == 16
    assert knn.knn_join(t, t, 0).count() == 0
    unit = {r.id: r.vector for r in t.normalised().rows.collect()}
    assert unit[0] == [0.0, 0.0] and unit[1] == [1.0, 0.0]


def test_query_blocks_and_filters(data, monkeypatch):
    base, x, asked = data
    monkeypatch.setattr(knn, "QUERY_BLOCK_BYTES", 8 * 16 * 5)
    assert found(knn.knn_join(base, asked, 5)) == {q: exact(x, q, 5) for q in range(0, 600, 50)}
    own = knn.knn_by_expression(base, asked, 5, D.l1)
    assert found(own)[50] == np.lexsort((np.arange(600), np.round(np.abs(x - x[50]).sum(axis=1), 6)))[:5].tolist()
    label = np.arange(600) % 10
    assert found(knn.filtered_knn(base, asked, 70, P.equals("label", 3))) == {q: exact(x, q, 60, allowed=label == 3) for q in range(0, 600, 50)}
    few = P.every(P.equals("label", 3), P.compare("vec_id", "lt", 40))
    for c in (None, quantize.lloyd(x, 8)):
        assert found(router.filtered_search(base, asked, 9, few, c)) == {q: exact(x, q, 9, allowed=(label == 3) & (np.arange(600) < 40)) for q in range(0, 600, 50)}
    half = found(router.filtered_search(base, asked, 9, P.compare("label", "lt", 5), quantize.lloyd(x, 8), 8))
    assert half == {q: exact(x, q, 9, allowed=label < 5) for q in range(0, 600, 50)}


def test_predicate_contract(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True), (2, float("nan"), None, False), (None, None, "b", None)], "i long, f double, s string, b boolean")
    n = lambda p: df.filter(p(df)).count()
    assert n(P.equals("i", 1)) == 1 and n(P.equals("i", 1.0)) == 0 and n(P.equals("s", 1)) == 0 and n(P.equals("b", True)) == 1
    assert n(P.compare("f", "gt", 0.0)) == 1 and n(P.between("s")) == 2 and n(P.between("none")) == 0 and n(P.every()) == 3 and n(P.some()) == 0
    assert n(P.negate(P.equals("s", "a"))) == 2 and n(P.between("i", 1, 1)) == 1


def test_errors(spark, data):
    base, _, asked = data
    make = lambda *v: VectorTable(spark.createDataFrame([(i, x) for i, x in v], "vec_id long, embedding array<float>"))
    with pytest.raises(DimensionMismatch):
        make((1, [1.0]), (2, [1.0, 2.0])).validated()
    with pytest.raises(NonFinite):
        make((1, [float("nan")])).validated()
    with pytest.raises(DuplicateId):
        make((1, [1.0]), (1, [2.0])).validated()
    with pytest.raises(NotNormalised):
        make((1, [3.0])).validated(unit=True)
    with pytest.raises(EmptyQuery):
        knn.knn_single(base, [], 3)
    with pytest.raises(DimensionMismatch):
        knn.knn_join(base, make((1, [1.0])), 3)
    with pytest.raises(Unsupported):
        D.distance("hamming", F.lit(1), F.lit(2))
    assert base.validated(16) is base


@pytest.mark.parametrize("shape", ["box", "ball"])
def test_trees_are_exact(data, shape):
    base, x, asked = data
    assert found(partitioned.tree_knn(base, asked, 10, depth=4, shape=shape)) == {q: exact(x, q, 10) for q in range(0, 600, 50)}


SEARCHES = {
    "scalar4": lambda b, q, x: quantize.scalar_knn(b, q, 10, 4),
    "scalar8": lambda b, q, x: quantize.scalar_knn(b, q, 10, 8),
    "product": lambda b, q, x: quantize.product_knn(b, q, 10, parts=4, codes=32),
    "rotated product": lambda b, q, x: quantize.product_knn(b, q, 10, parts=4, codes=32, turns=2),
    "lists": lambda b, q, x: partitioned.ivf_knn(b, q, 10, partitioned.centroids_of(b, 12), 4),
    "lists of product codes": lambda b, q, x: partitioned.ivf_product_knn(b, q, 10, partitioned.centroids_of(b, 12), 4, parts=4, codes=32),
    "rabitq": lambda b, q, x: partitioned.ivf_rabitq_knn(b, q, 10, partitioned.centroids_of(b, 12), 4, pool=15),
    "hashes": lambda b, q, x: partitioned.lsh_knn(b, q, 10, tables=16, probes=6),
    "forest": lambda b, q, x: partitioned.forest_knn(b, q, 10, trees=8, depth=4, leaves=3),
    "graph": lambda b, q, x: graphs.search(graphs.build(b, shard_rows=200), q, 10),
    "graph mrng": lambda b, q, x: graphs.search(graphs.build(b, rule="mrng"), q, 10),
    "graph mond": lambda b, q, x: graphs.search(graphs.build(b, rule="mond"), q, 10),
    "graph rrnd": lambda b, q, x: graphs.search(graphs.build(b, rule="rrnd"), q, 10),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_recall(data, name):
    base, x, asked = data
    got = found(SEARCHES[name](base, asked, x))
    hits = [len(set(got.get(q, [])) & set(exact(x, q, 10))) / 10 for q in range(0, 600, 50)]
    assert np.mean(hits) >= 0.9, hits


@pytest.mark.parametrize("search", [quantize.projected_knn, quantize.binary_knn])
def test_cosine_recall(data, search):
    base, x, asked = data
    got = found(search(base, asked, 10, pool=15))
    assert np.mean([len(set(got[q]) & set(exact(x, q, 10, "cosine"))) / 10 for q in range(0, 600, 50)]) >= 0.9


def test_graph_is_connected(data):
    base, _, _ = data
    for r in graphs.quality(graphs.build(base, degree=4, pool=8, shard_rows=150)).collect():
        assert r.n_reached == r.n_rows and r.least >= 1


def test_empty_base(spark, data):
    _, _, asked = data
    none = VectorTable(asked.df.limit(0))
    for f in (lambda: knn.knn_join(none, asked, 3), lambda: partitioned.tree_knn(asked, none, 3), lambda: graphs.search(graphs.build(asked), none, 3)):
        assert f().count() == 0


@pytest.mark.parametrize("metric", ["l2", "l2_squared", "cosine", "inner_product"])
def test_nearest_at_large_norms(metric):
    rng = np.random.default_rng(4)
    x = np.concatenate([1e4 + rng.normal(size=(3000, 3)) * 1e-4, rng.normal(size=(50, 3)), [[1e4, 1e4, 1e4 + 1e-5]], np.zeros((2, 3)), np.full((5, 3), 1e4)])
    ids, q = rng.permutation(len(x)), x[::97]
    nearest = knn.Nearest(np.arange(len(q)), q, 7, metric)
    for lo in range(0, len(x), 800):
        nearest.see(ids[lo : lo + 800], x[lo : lo + 800])
    for j in range(len(q)):
        d = np.sqrt(((x - q[j]) ** 2).sum(axis=1)) if metric == "l2" else ((x - q[j]) ** 2).sum(axis=1) if metric == "l2_squared" else D.kernel(metric, x, q[j : j + 1])[:, 0]
        d = np.round(d, 6) + 0.0
        order = np.lexsort((ids, d))[:7]
        if metric == "l2":
            assert nearest.row[j].tolist() == ids[order].tolist()
        assert np.allclose(nearest.distance[j], d[order], atol=2e-6, rtol=1e-12)
