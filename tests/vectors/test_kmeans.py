import numpy as np
import pytest
from orrery.errors import TooFewVectors
from orrery.operators import kmeans
from orrery.operators.quantize import lloyd
from orrery.schema import VectorTable
from pyspark.sql import functions as F


def clusters(n, d, centres, seed=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))
    return (c[which] + 0.6 * rng.normal(size=(n, d))).astype(np.float32)


def table(spark, x, path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": flat}), path, row_group_size=max(1, len(x) // 8))
    return VectorTable(spark.read.parquet(path))


def cost(x, c):
    return kmeans._nearest(x.astype(np.float64), c)[1].mean()


def test_objective_against_full_lloyd(spark, tmp_path):
    """100,000 vectors of 96 dimensions: within 2 % of Lloyd on all of them in memory."""
    x = clusters(100_000, 96, 64)
    fitted = kmeans.fit(table(spark, x, str(tmp_path / "t.parquet")), 64, rounds=12)
    full = lloyd(x.astype(np.float64), 64, 0, 12)
    assert fitted.rounds[-1][1] == pytest.approx(cost(x, fitted.centroids.lists), rel=1e-6)
    assert fitted.rounds[-1][1] <= 1.02 * cost(x, full)
    assert [r[1] for r in fitted.rounds] == sorted((r[1] for r in fitted.rounds), reverse=True)


def test_more_lists_than_a_driver_sample(spark, tmp_path):
    """25,000 lists in two levels: every list is there, the objective falls, rows go to a near list."""
    x = clusters(60_000, 8, 300)
    base = table(spark, x, str(tmp_path / "t.parquet"))
    fitted = kmeans.fit(base, 25_000, rounds=2)
    c = fitted.centroids
    assert c.lists.shape == (25_000, 8) and len(c.tops) <= 159 and c.first[-1] == 25_000
    assert fitted.rounds[-1][2] > 0.9 * 25_000 and fitted.rounds[-1][3] < 1000
    some = np.random.default_rng(1).choice(len(x), 2000, replace=False)
    by_two, whole = c.assign(x[some].astype(np.float64))[1].mean(), cost(x[some], c.lists)
    assert by_two < 1.35 * whole


def test_two_levels_are_as_good_as_one(spark, tmp_path):
    x = clusters(20_000, 16, 200, 7)
    base = table(spark, x, str(tmp_path / "t.parquet"))
    one, two = kmeans.fit(base, 256, rounds=6), kmeans.fit(base, 256, rounds=6, flat=100)
    assert len(two.centroids.lists) == 256 and two.rounds[-1][1] < 1.2 * one.rounds[-1][1]


def test_large_lists_are_split(spark, tmp_path):
    """A third of the rows round one centre: with a bound on sizes no list is far over it."""
    x = clusters(20_000, 96, 100, 7)
    base = table(spark, x, str(tmp_path / "t.parquet"))
    free, bound = kmeans.fit(base, 50), kmeans.fit(base, 50, most=4.0)
    assert free.rounds[-1][3] > 1.5 * bound.rounds[-1][3] and bound.rounds[-1][3] < 6 * 400 and bound.rounds[-1][1] < 1.15 * free.rounds[-1][1]


def test_partitions_do_not_matter_and_cosine(spark, tmp_path):
    x = clusters(3000, 8, 10, 3)
    base = table(spark, x, str(tmp_path / "t.parquet"))
    other = VectorTable(base.df.repartition(7))
    a, b = (kmeans.fit(t, 20, spherical=True).centroids.lists for t in (base, other))
    assert np.allclose(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1)
    at, n = kmeans.Centroids(a).assign(kmeans.unit(x.astype(np.float64)))[0], np.zeros(20)
    for r in kmeans.update(kmeans._rows(base), kmeans.Centroids(a), spherical=True).collect():
        n[r["list"]] = r["n"]
    assert (n == np.bincount(at, minlength=20)).all()


def test_too_few_vectors_nulls_and_repeats(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(None, [9.0, 9.0]), (77, None)]
    base = VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fitted = kmeans.fit(base, 5)
    assert sorted(fitted.centroids.lists[:, 0].round(6)) == [0, 1, 2, 3, 4] and fitted.rounds[-1][1] == 0
    with pytest.raises(TooFewVectors):
        kmeans.fit(base, 6)
    with pytest.raises(TooFewVectors):
        kmeans.fit(VectorTable(base.df.limit(0)), 1)
    with pytest.raises(TooFewVectors):
        lloyd(np.zeros((3, 2)), 4)
    assert kmeans.fit(VectorTable(base.df.filter(F.col("vec_id") == 3)), 1).centroids.lists.tolist() == [[3.0, 1.0]]
