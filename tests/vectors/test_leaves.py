import numpy as np
import pytest
from orrery import queries
from orrery.errors import DimensionMismatch
from orrery.operators import knn, leaves
from orrery.schema import VectorTable
from pyspark.sql import functions as F


def table(spark, x):
    return VectorTable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3))


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "distance").collect())


@pytest.mark.parametrize("k", [1, 7, 90])
def test_leaves_find_what_a_full_scan_finds(spark, monkeypatch, k):
    """Columns of very different norms, a third of the rows equal, some far away, queries that aren't rows."""
    monkeypatch.setattr(leaves, "LEAF_ROWS", 32)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(700, 2)) * [1e5, 3], np.full((400, 2), 5.0), np.round(rng.normal(size=(100, 2))), [[1e9, 0.0], [np.nan, 1.0]]])
    q = np.concatenate([x[::40], [[3e6, -50.0], [5.0, 5.0], [np.nan, 2.0]]])
    d = np.round(np.sqrt(((q[:, None] - x[None, :-1]) ** 2).sum(axis=2)), 6)
    best = [np.lexsort((np.arange(len(d[i])), d[i]))[:k] for i in range(len(q) - 1)]
    assert rows(leaves.leaf_knn(table(spark, x), table(spark, q), k)) == [(i, r + 1, j, d[i, j]) for i, b in enumerate(best) for r, j in enumerate(b.tolist())]


def test_few_rows_and_errors(spark):
    x = np.arange(10.0).reshape(5, 2)
    base = table(spark, x)
    assert rows(leaves.leaf_knn(base, base, 9)) == rows(knn.knn_join(base, base, 9))
    none = VectorTable(base.df.limit(0))
    assert leaves.leaf_knn(none, base, 3).count() == leaves.leaf_knn(base, none, 3).count() == leaves.leaf_knn(base, base, 0).count() == 0
    with pytest.raises(Exception, match=DimensionMismatch.__name__):
        leaves.leaf_knn(base, table(spark, x[:, :1]), 3).count()


def test_registered_query_compares_a_small_part_of_all_pairs(spark):
    """150,000 orders, 3,000 queries: 450 million pairs; the leaves that queries need hold under a tenth."""
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    x = np.array(orders.select("o_totalprice", F.col("o_custkey").cast("double"), "o_orderkey").collect())
    boxes = leaves._Boxes(x[::25, :2], 6, 10)
    size = np.bincount(boxes.tree.leaf(x[:, :2]), minlength=64)
    q = x[x[:, 2] % 50 == 0][:, :2]
    assert 0 < size[boxes.needed(q, boxes.bound(q))[1]].sum() < 45_000_000
    assert queries.QUERIES["knn_unscaled"](spark, "/root/testdata/sf0.01").count() == 3_000
