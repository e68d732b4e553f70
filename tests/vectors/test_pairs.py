import numpy as np
import pytest
from orrery.errors import Unsupported
from orrery.operators import pairs
from orrery.schema import VectorTable


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return VectorTable(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"))


def plain(x, radius):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 6)
    first = {}
    for i, v in enumerate(x):
        first.setdefault(tuple(v), i)
    reps = sorted(first.values())
    return {(a, b, d[a, b]) for a in reps for b in reps if a < b and d[a, b] <= radius}


def got(df):
    rows = [(r.a, r.b, r.distance) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("radius", "block"), [(0.6, 1024), (1.2, 50), (0.0, 8)])
def test_against_every_pair(spark, radius, block):
    """A third of the rows round one centre, a tenth of them equal."""
    rng = np.random.default_rng(3)
    x = np.concatenate([0.25 * rng.normal(size=(200, 5)), rng.normal(size=(300, 5)) * 1.5])
    x[450:500] = x[:50]
    found, members = pairs.duplicates(table(spark, x), radius, x[rng.choice(500, 12, replace=False)], block)
    assert got(found) == plain(x, radius)
    assert {(r.id, r.member) for r in members.collect()} == {(i - 450 if i >= 450 else i, i) for i in range(500)}


def test_dense_shell_is_dealt_in_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * 0.01
    assert len(got(pairs.duplicates(table(spark, x), 1.0, np.zeros((1, 8)), 64)[0])) == 400 * 399 // 2
    odd = spark.createDataFrame([(1, [0.0, 0.0], 5), (1, [0.0, 0.0], 6), (2, None, 1), (None, [0.0, 0.0], 1), (3, [0.5, 0.0], 2)], "vec_id long, embedding array<double>, a long")
    assert got(pairs.duplicates(VectorTable(odd), 0.5, np.zeros((2, 2)))[0]) == {(1, 3, 0.5)}
    assert pairs.duplicates(VectorTable(odd.limit(0)), 0.5, np.zeros((2, 2)))[0].count() == 0
    with pytest.raises(Unsupported):
        pairs.near_pairs(odd, -1.0, np.zeros((1, 2)))


def test_a_row_is_copied_to_half_of_the_blocks_at_most(spark):
    """A radius that no list tells apart: 2,000 rows in 16 lists went out some 60,000 times."""
    x = np.random.default_rng(2).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n, lo, hi = pairs._ranges(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), blocks := pairs._Blocks(x[:16], x, 2000, 250))
    first, parts, goes = pairs._meetings(n, lo, hi, 1.1, pairs.BLOCK)
    at = blocks.of(blocks.distances(x)[0])
    assert n.tolist() == np.bincount(at, minlength=blocks.n).tolist() and (parts == 1).all()
    assert sum(1 + len(goes[p]) for p in at) <= 2000 * (1 + len(n) / 2)
    met = {(min(i, int(j)), max(i, int(j))) for i, to in enumerate(goes) for j in to}
    assert len(met) == sum(map(len, goes))  # a pair of blocks meets once
    assert all((min(p, q), max(p, q)) in met for p, q in zip(at[:1000], at[1000:]) if p != q)
    assert not any(len(to) for to in pairs._meetings(n, lo, hi, -9.0, pairs.BLOCK)[2])


def test_rows_without_numbers_and_single_precision(spark):
    """They have no pairs and take none away; values that single precision holds and others."""
    x = np.random.default_rng(4).normal(size=(300, 3))
    x[:150] = x[:150].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [float("nan")] * 3), (901, [float("inf"), 0.0, 0.0]), (902, [None, 0.0, 0.0])]
    odd = VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got(pairs.duplicates(odd, 0.4, x[:5], 40)[0]) == plain(x, 0.4)
