import json
import shutil

import numpy as np
import pytest
from orrery.errors import TooFewVectors, Unsupported
from orrery.operators import knn, stored
from orrery.operators import predicates as P
from orrery.schema import VectorTable
from orrery.sources.versions import VersionedTable
from pyspark.sql import functions as F


def vectors(spark, ids, seed=0, d=6, extra="vec_id % 7 AS bucket"):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=d).tolist()) for i in ids]
    return VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", extra))


def ranks(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.distance) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An index of 100 rows in 4 lists, built once; tests change copies."""
    at = tmp_path_factory.mktemp("built") / "i"
    base = vectors(spark, range(100))
    stored.build(base, str(at), 4)

    def copy(to):
        shutil.copytree(at, to)
        return base, stored.load(spark, str(to))

    return copy


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


@pytest.mark.parametrize("parts", [0, 3])
def test_batches_upserts_deletes_are_found_at_once_and_repeats_change_nothing(spark, tmp_path, parts):
    base, newer = vectors(spark, range(200)), vectors(spark, range(150, 260), 1)
    q = vectors(spark, range(12), 2)
    index = stored.build(base, str(tmp_path / "i"), 8, parts, codes=16)
    gone = spark.createDataFrame([(3,), (151,), (None,), (9999,)], "id long")
    want = VectorTable(base.df.filter("vec_id < 150 AND vec_id <> 3").union(newer.df))
    for _ in range(2):  # the second time is a repeat of the batch
        index = stored.change(index, newer, gone, "batch-1")
        assert ranks(stored.search(index, q, 5, 8, pool=60)) == ranks(knn.knn_join(want, q, 5)) and index.sizes.sum() == 259
    versions = VersionedTable(index.path + "/manifest").versions(spark)
    stored.insert(index, newer, "batch-1")
    assert VersionedTable(index.path + "/manifest").versions(spark) == versions
    old = stored.load(spark, index.path, versions[0])  # a reader of the version before
    assert old.sizes.sum() == 200 and ranks(stored.search(old, q, 5, 8, pool=40)) == ranks(knn.knn_join(base, q, 5))


def test_a_small_batch_writes_about_its_own_size(spark, tmp_path):
    base = vectors(spark, range(20_000), d=32)
    index = stored.build(base, str(tmp_path / "i"), 16)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "i" / "data").rglob("*.parquet"))
    before = size()
    stored.change(index, vectors(spark, range(0, 20_000, 100), 3, d=32), batch="b")
    assert size() - before < 0.04 * before


def test_settle_touches_crowded_lists_alone(spark, tmp_path):
    base, q = vectors(spark, range(400)), vectors(spark, range(9), 2)
    index = stored.build(base, str(tmp_path / "i"), 8)
    crowded = index.rows.groupBy("list_no").count().orderBy(F.desc("count")).first()["list_no"]
    doomed = index.rows.filter(F.col("list_no") == crowded).select(F.col("vec_id").alias("id"))
    doomed = doomed.filter("id % 2 = 0")
    index = stored.change(index, gone=doomed)
    left = VectorTable(base.df.join(doomed.withColumnRenamed("id", "vec_id"), "vec_id", "left_anti"))
    before = {(r.segment, r.list) for r in index.lists.collect()}
    settled = stored.settle(index)
    after = {(r.segment, r.list) for r in settled.lists.collect()}
    assert before - after == {(0, crowded)} and len(after) == len(before)
    assert settled.dead()[0] is None and ranks(stored.search(settled, q, 5, 8)) == ranks(knn.knn_join(left, q, 5)) == ranks(stored.search(index, q, 5, 8))
    assert stored.settle(settled).version == settled.version
    stored.reclaim(settled, keep=1)
    assert all("dead" not in f for f in files(tmp_path / "i")) and ranks(stored.search(stored.load(spark, index.path), q, 5, 8)) == ranks(knn.knn_join(left, q, 5))


@pytest.mark.parametrize("step", ["_segment", "_dead_rows", "_publish", "pointer"])
def test_a_crash_at_any_step_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch, built, step):
    newer, q = vectors(spark, range(90, 120), 1), vectors(spark, range(5), 2)
    base, index = built(tmp_path / "i")

    def crash(f, after=True):
        def run(*a, **b):
            if after:
                f(*a, **b)
            raise OSError("lost")

        return run

    with monkeypatch.context() as m:
        if step == "pointer":
            m.setattr(VersionedTable, "point", crash(VersionedTable.point, after=False))
        else:
            m.setattr(stored, step, crash(getattr(stored, step), after=step != "_publish"))
        with pytest.raises(OSError):
            stored.change(index, newer, spark.createDataFrame([(5,)], "id long"), "b")
    same = stored.load(spark, index.path)
    assert same.version == index.version and ranks(stored.search(same, q, 5, 4)) == ranks(knn.knn_join(base, q, 5))
    again = stored.change(same, newer, spark.createDataFrame([(5,)], "id long"), "b")
    want = VectorTable(base.df.filter("vec_id < 90 AND vec_id <> 5").union(newer.df))
    assert ranks(stored.search(again, q, 5, 4)) == ranks(knn.knn_join(want, q, 5))


def test_a_crash_while_building_can_be_built_again(spark, tmp_path, monkeypatch):
    base = vectors(spark, range(60))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stored.build(base, str(tmp_path / "i"), 4)
    with pytest.raises(Unsupported):
        stored.load(spark, str(tmp_path / "i"))
    assert stored.build(base, str(tmp_path / "i"), 4).sizes.sum() == 60
    with pytest.raises(Unsupported):
        stored.build(base, str(tmp_path / "i"), 4)


def test_an_empty_start_and_names_that_clash(spark, tmp_path):
    base = vectors(spark, range(80), extra="vec_id * 2 AS list_no").df.selectExpr("*", "'a' AS row_code", "1 AS row_id", "2.5D AS `odd.name`", "array('x', string(vec_id % 3)) AS tags", "3 AS list", "4L AS segment_no")
    base = VectorTable(base)
    index = stored.build(VectorTable(base.df.limit(0)), str(tmp_path / "i"), 4)
    q = VectorTable(base.df.filter("vec_id < 3"))
    assert stored.search(index, q, 3, 2).count() == 0 and index.sizes.sum() == 0
    with pytest.raises(TooFewVectors):
        stored.insert(index, VectorTable(base.df.limit(2)))
    index = stored.insert(stored.load(spark, index.path), VectorTable(base.df.drop("row_id").withColumn("more", F.lit(1))), "first")
    both = P.every(P.compare("list_no", "ge", 40), P.has_label("tags", "1"))
    got, want = stored.search(index, q, 4, 4, both), knn.filtered_knn(base, q, 4, both)
    assert ranks(got) == ranks(want) and set(base.df.columns) <= set(index.rows.columns) and index.rows.filter("row_id IS NULL").count() == 80


def test_cosine_and_inner_product(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] * rng.uniform(0.5, 2, (4000, 1)) + 0.2 * rng.normal(size=(4000, 16))
    base = VectorTable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    q = VectorTable(base.df.filter("vec_id % 100 = 0"))
    for metric in ("cosine", "inner_product"):
        want = {(r[0], r[2]) for r in ranks(knn.knn_join(base, q, 10, metric))}
        for parts, probes in ((0, 40), (8, 20)):
            index = stored.build(base, str(tmp_path / f"{metric}{parts}{probes}"), 40, parts, metric=metric)
            got = ranks(stored.search(index, q, 10, probes))
            assert len({(r[0], r[2]) for r in got} & want) >= 0.9 * len(want), (metric, parts, probes)
            assert probes < 40 or parts or got == ranks(knn.knn_join(base, q, 10, metric))
    with pytest.raises(Unsupported):
        stored.build(base, str(tmp_path / "x"), 4, metric="angular")


# -- filters by summaries ------------------------------------------------------------------------


def attributed(spark, n=600):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        rows.append((i, rng.normal(size=4).tolist(), int(i % 13) if i % 11 else None, float(rng.choice([-0.0, 0.0, 1.5, np.nan, 7.0])) if i % 5 else None, f"s{i % 3}" if i % 2 else None, bool(i % 2), float(rng.normal()), [str(j) for j in range(i % 4)] if i % 9 else None))
    return VectorTable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int, score double, name string, flag boolean, size float, tags array<string>"))


RULES = [
    P.equals("bucket", 5), P.equals("bucket", 2**40), P.equals("bucket", "5"), P.equals("none", 5), P.equals("vec_id", 77), P.compare("bucket", "lt", 3), P.compare("vec_id", "ge", 550), P.compare("vec_id", "le", -1),
    P.equals("score", 0.0), P.compare("score", "gt", 1.5), P.compare("score", "le", 1.5), P.compare("size", "gt", 1.0), P.compare("size", "lt", -9.0), P.equals("name", "s1"), P.equals("name", "zz"), P.equals("flag", True),
    P.between("vec_id", 100, 140), P.between("bucket", 3, 5), P.between("score"), P.between("tags"), P.between("none"), P.between("size", low=0.5), P.within("bucket", [1, 2, 2, 3]), P.within("vec_id", [4, 8, 4000]), P.within("bucket", []),
    P.has_label("tags", "2"), P.has_label("tags", "9"), P.has_label("tags", "0"), P.negate(P.equals("bucket", 5)), P.negate(P.between("vec_id", 100, 500)), P.negate(P.every()), P.some(), P.every(),
    P.every(P.equals("bucket", 5), P.equals("flag", True), P.compare("vec_id", "lt", 300)), P.some(P.equals("bucket", 5), P.equals("bucket", 6), P.equals("name", "s2")), lambda df: df["vec_id"] % 50 == 1,
]


def test_bounds_hold_and_are_exact_for_counted_values(spark, tmp_path):
    base = attributed(spark)
    index = stored.build(base, str(tmp_path / "i"), 6)
    index = stored.insert(index, VectorTable(attributed(spark, 40).df.withColumn("vec_id", F.col("vec_id") + 1000)), "more")
    rows = index.rows
    each = rows.groupBy("list_no").agg(*[F.count(F.when(rule(rows), 1)).alias(f"n{i}") for i, rule in enumerate(RULES)]).collect()
    for i, rule in enumerate(RULES):
        truth = np.zeros(6, dtype=np.int64)
        for r in each:
            truth[r[0]] = r[f"n{i}"]
        least, most = index.matches(rule)
        assert (least <= truth).all() and (truth <= most).all(), (i, least, truth, most)
        if i in (0, 1, 2, 3, 5, 7, 8, 9, 10, 13, 14, 15, 17, 18, 20, 22, 24, 25, 26, 27, 28, 30, 31, 32):
            assert (least == truth).all() and (truth == most).all(), (i, least, truth, most)


def test_filtered_search_returns_min_k_matches_and_reads_lists_that_can_match(spark, tmp_path):
    """Buckets i mod m, k from 1 to 30, one probe: min(k, matches) rows, and the nearest where all lists
    with matches are read. The plan's scan has the lists that can match and no other pass over rows."""
    base = attributed(spark)
    q = VectorTable(base.df.filter("vec_id % 60 = 7"))
    index = stored.build(base, str(tmp_path / "i"), 12)
    for rule, k in ((RULES[0], 30), (RULES[4], 30), (RULES[16], 30), (RULES[33], 30), (RULES[35], 1)):
        want = base.df.filter(rule(base.df)).count()
        got = stored.search(index, q, k, 1, rule)
        assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {min(k, want)}
    rare = P.equals("vec_id", 77)
    least, most = index.matches(rare)
    able = np.flatnonzero(most)
    assert len(able) < 12 and least.sum() <= 1
    found = stored.search(index, q, 3, 1, rare)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_no" in plan and plan.count("Scan parquet") <= 2
    read = {f.split("list_no=")[1].split("/")[0] for f in found.inputFiles()}
    assert read == {str(p) for p in able}
    assert [r.doc_id for r in found.collect()] == [77] * 10


def test_meta_is_readable(tmp_path, built):
    _, index = built(tmp_path / "i")
    meta = json.loads(index.manifest.filter("kind = 'meta'").first()["note"])
    assert meta["id"] == "vec_id" and meta["attributes"] == ["bucket"]
