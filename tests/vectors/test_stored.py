import numpy as np
import pytest
from orrery.operators import knn, stored
from orrery.operators import predicates as P
from orrery.schema import VectorTable
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """100,000 vectors of 96 dimensions around 256 centres, one of them with a third of all rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(256, 96))
    which = np.where(rng.random(100_000) < 1 / 3, 0, rng.integers(0, 256, 100_000))
    x = (centres[which] + 0.6 * rng.normal(size=(100_000, 96))).astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path_factory.mktemp("clustered") / "t.parquet")
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 96).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(100_000), "embedding": flat, "label": which % 10, "row_id_": which}), path, row_group_size=10_000)
    return VectorTable(spark.read.parquet(path))


def asked(base, n=1000):
    return VectorTable(base.df.filter(F.col("vec_id") % n == 0), base.id_col, base.vector_col)


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


@pytest.mark.parametrize("parts", [0, 24])
def test_recall_with_few_rows_looked_at(spark, clustered, tmp_path, parts):
    q = asked(clustered)
    stored.build(clustered, str(tmp_path / "i"), lists=128, parts=parts)
    index = stored.load(spark, str(tmp_path / "i"))
    truth = pairs(knn.knn_join(clustered, q, 10))
    found = stored.search(index, q, 10, probes=16)
    got = pairs(found)
    share = stored.looked_at(index, q, 10, 16)
    print(parts, len(truth & got) / len(truth), share)
    assert len(got) == 1000 and len(truth & got) / len(truth) >= 0.9 and share <= 0.3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_no" in plan


def small(spark, n=300):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), i % 5, "x") for i in range(n)] + [(3, [0.0] * 8, 3, None), (None, [1.0] * 8, 1, "x"), (999, None, 1, "x")]
    return VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, id string"))  # id: a name that clashes


@pytest.mark.parametrize("parts", [0, 4])
def test_filtered_search_returns_all_it_can(spark, tmp_path, parts):
    base = small(spark)
    index = stored.build(base, str(tmp_path / "i"), 16, parts, codes=16)
    q = VectorTable(base.df.filter("vec_id % 50 = 1"))
    rare = P.every(P.equals("label", 2), P.compare("vec_id_", "ge", 0))
    assert stored.search(index, q, 10, 1, rare).count() == 0  # no such field
    rare = P.every(P.equals("label", 2), P.equals("id", "x"))
    for k in (10, 100):
        got = stored.search(index, q, k, 1, rare)
        assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {min(k, 60)}
        if k == 100:
            assert pairs(got) == pairs(knn.filtered_knn(base, q, k, rare))


def test_insert_compact_reconstruct_and_empty(spark, tmp_path):
    base = small(spark)
    index = stored.build(base, str(tmp_path / "i"), 8, 8, codes=64)
    assert index.sizes.sum() == 301
    new = VectorTable(base.df.filter("vec_id < 5").withColumn("vec_id", F.col("vec_id") + 5000))
    index = stored.insert(index, new)
    assert index.sizes.sum() == 307
    q = VectorTable(base.df.filter("vec_id = 1"))
    assert [r.doc_id for r in stored.search(index, q, 2, 8).orderBy("rank").collect()] == [1, 5001]
    less = stored.compact(index, spark.createDataFrame([(1,), (1,)], "id long"), str(tmp_path / "j"))
    assert [r.doc_id for r in stored.search(less, q, 1, 8).collect()] == [5001] and less.sizes.sum() == 306
    both = stored.reconstruct(index).join(base.rows.filter("id > 4").select("id", F.col("vector").alias("v")), "id").collect()
    assert np.mean([np.square(np.subtract(r.vector, r.v)).sum() for r in both]) < 0.1 * np.mean([np.square(r.v).sum() for r in both])
    none = stored.build(VectorTable(base.df.limit(0)), str(tmp_path / "e"), 8)
    assert stored.search(stored.load(spark, none.path), q, 3, 2).count() == 0


def test_main_and_delta_and_radius(spark):
    rng = np.random.default_rng(2)
    x = {i: rng.normal(size=4) for i in range(60)}
    y = {i: rng.normal(size=4) for i in (0, 7, 80)}
    table = lambda d: VectorTable(spark.createDataFrame([(i, v.tolist()) for i, v in d.items()], "vec_id long, embedding array<double>"))
    q = VectorTable(table(x).df.filter("vec_id < 4"))
    want = {i: v for i, v in {**x, **y}.items() if i not in (1, 80)}
    dead = spark.createDataFrame([(1,), (80,), (None,)], "id long")
    got = knn.merged_knn(table(x), table(y), dead, q, 5)
    near = lambda a: sorted((round(float(np.linalg.norm(a - v)), 6), i) for i, v in want.items())
    assert [(r.distance, r.doc_id) for r in got.orderBy("query_id", "rank").collect()] == [p for i in range(4) for p in near(x[i])[:5]]
    assert knn.merged_knn(table(x), VectorTable(table(y).df.limit(0)), dead.limit(0), q, 5).count() == 20
    inside = knn.within(table(x), q, 1.5)
    assert {(r.query_id, r.doc_id) for r in inside.collect()} == {(i, j) for i in range(4) for j, v in x.items() if np.linalg.norm(x[i] - v) <= 1.5}
    assert knn.within(VectorTable(table(x).df.limit(0)), VectorTable(q.df.limit(0)), 1.0).count() == 0
