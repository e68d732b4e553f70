import numpy as np
import pytest
from orrery.sources import files, ranges
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def read(spark, kind, path, **options):
    return ranges.register(spark).read.format("vectors").options(kind=kind, **options).load(str(path))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(10_000, 7)).astype("<f4")
    (tmp_path / "a.vec").write_bytes(b"VEC1" + np.array([10_000, 7], "<u4").tobytes() + x.tobytes())
    df = read(spark, "vec1", tmp_path / "a.vec", splitRows=900)
    assert df.rdd.getNumPartitions() == 12
    rows = df.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(10_000)) and (np.array([r.embedding for r in rows], dtype=np.float32) == x).all()
    old = files.read_vec1(spark, str(tmp_path / "a.vec"))
    assert old.exceptAll(df).count() == 0


def test_other_kinds_agree_with_whole_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "l").write_bytes(b"LBL1" + np.array([50, *rng.integers(0, 9, 50)], "<u4").tobytes())
    (tmp_path / "n").write_bytes(b"NBR1" + np.array([20, 3], "<u4").tobytes() + rng.integers(0, 99, 60).astype("<i4").tobytes())
    edge = np.concatenate([[0], np.cumsum(rng.integers(0, 5, 40))])
    m = int(edge[-1])
    (tmp_path / "s").write_bytes(b"SPV1" + np.array([40], "<u4").tobytes() + np.array([m], "<u8").tobytes() + edge.astype("<u8").tobytes() + rng.integers(0, 30, m).astype("<u4").tobytes() + rng.random(m).astype("<f4").tobytes())
    for kind, name, whole in (("lbl1", "l", files.read_lbl1), ("nbr1", "n", files.read_nbr1), ("spv1", "s", files.read_spv1)):
        a, b = read(spark, kind, tmp_path / name, splitRows=7), whole(spark, str(tmp_path / name))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


@pytest.mark.parametrize("kind", ["npy", "vec1"])
def test_round_trip_ids_go_on_and_overwrite(spark, tmp_path, kind):
    ranges.register(spark)
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * i / 8).cast("float") for i in range(3)]).alias("embedding"))
    folder = str(tmp_path / "out")
    df.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").write.format("vectors").option("kind", kind).mode("append").save(folder)
    back = read(spark, kind, folder, splitRows=60)
    key = lambda d: sorted((r.vec_id, tuple(r.embedding)) for r in d.collect())
    assert key(back) == key(df)
    if kind == "npy":
        parts = [np.load(p) for p in sorted((tmp_path / "out").glob("*.npy"))]
        assert sum(len(p) for p in parts) == 500 and parts[0].shape[1] == 3
    more = df.filter("vec_id < 10").coalesce(1)
    more.write.format("vectors").option("kind", kind).mode("append").save(folder)
    assert [r.vec_id for r in read(spark, kind, folder, firstId=1000).orderBy(F.desc("vec_id")).limit(1).collect()] == [1509]
    more.write.format("vectors").option("kind", kind).mode("overwrite").save(folder)
    assert key(read(spark, kind, folder)) == key(more) and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_errors_and_empty(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"VEC1" + np.array([9, 4], "<u4").tobytes() + b"\0" * 20)
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "e.npy", np.zeros((0, 4)))
    for kind, name in (("vec1", "a"), ("lbl1", "a"), ("npy", "a"), ("npy", "f.npy"), ("vec1", "none"), ("other", "a")):
        with pytest.raises(PySparkException):
            read(spark, kind, tmp_path / name).collect()
    assert read(spark, "npy", tmp_path / "e.npy").count() == 0
