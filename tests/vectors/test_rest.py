import json
import struct

import numpy as np
import pytest
from orrery.operators import diagnostics as dx
from orrery.operators import evaluation as ev
from orrery.operators import retrieval
from orrery.schema import VectorTable
from orrery.sources import files
from orrery.sources.versions import VersionedTable
from orrery.streaming import changes, upsert
from pyspark.sql import functions as F


def test_files(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "a.vec").write_bytes(b"VEC1" + struct.pack("<II", 2, 3) + x.tobytes())
    assert [(r.vec_id, r.embedding) for r in files.read_vec1(spark, str(tmp_path / "a.vec")).collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    (tmp_path / "a.nbr").write_bytes(b"NBR1" + struct.pack("<II", 1, 2) + np.array([7, 3], "<i4").tobytes())
    assert [tuple(r) for r in files.read_nbr1(spark, str(tmp_path / "a.nbr")).collect()] == [(0, 7, 1), (0, 3, 2)]
    (tmp_path / "a.lbl").write_bytes(b"LBL1" + struct.pack("<I", 2) + np.array([5, 6], "<u4").tobytes())
    assert [tuple(r) for r in files.read_lbl1(spark, str(tmp_path / "a.lbl")).collect()] == [(0, 5), (1, 6)]
    (tmp_path / "a.spv").write_bytes(b"SPV1" + struct.pack("<IQ", 2, 3) + np.array([0, 1, 3], "<u8").tobytes() + np.array([4, 1, 9], "<u4").tobytes() + np.array([0.5, 1, 2], "<f4").tobytes())
    assert [tuple(r) for r in files.read_spv1(spark, str(tmp_path / "a.spv")).collect()] == [(0, 4, 0.5), (1, 1, 1.0), (1, 9, 2.0)]
    (tmp_path / "in.jsonl").write_text('{"id": 1, "vec": [3, 4]}\n\n{"id": 2, "vec": [0, 0]}\n')
    rows = {r.vec_id: r.embedding for r in files.read_json_vectors(spark, str(tmp_path / "in.jsonl")).collect()}
    assert rows[1] == pytest.approx([0.6, 0.8]) and rows[2] == [0, 0]
    files.write_json_vectors(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>").coalesce(1), str(tmp_path / "out"))
    assert json.loads(next(p for p in (tmp_path / "out").glob("*.json") if p.stat().st_size).read_text()) == {"id": 1, "vec": [1.0]}


def test_sparse_and_fusion(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0), (3, "c", 5.0)], "doc_id long, term string, weight double")
    got = [tuple(r) for r in retrieval.sparse_mips(base, spark.createDataFrame([(9, "a", 1.0), (9, "b", 1.0)], base.schema), 5).select("doc_id", "distance").collect()]
    assert got == [(1, -4.0), (2, -1.0)]
    one = spark.createDataFrame([(0, 5, 1), (0, 6, 2)], "query_id long, doc_id long, rank int")
    two = spark.createDataFrame([(0, 6, 1)], one.schema)
    assert [r.doc_id for r in retrieval.reciprocal_rank_fusion([one, two], 3).orderBy("rank").collect()] == [6, 5]
    pool = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])], "query_id long, doc_id long, relevance double, vector array<double>")
    assert [r.doc_id for r in retrieval.mmr(pool, 2).orderBy("rank").collect()] == [1, 3]
    tokens = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "doc_id long, token_vector array<double>")
    assert retrieval.pooled(tokens).first().vector == [2.0, 4.0]
    coded = retrieval.encode(retrieval.pooled(tokens), "vector", [(np.eye(2), np.ones(2))]).first().encoded
    assert coded == [3.0, 5.0]


def test_evaluation(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    schema = "query_id long, doc_id long, rank int"
    truth = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], schema)
    result = spark.createDataFrame([(1, 11, 1), (1, 11, 2), (1, 99, 3), (2, 5, 1)], schema)
    assert {r.query_id: r.recall for r in ev.recall_at(q, truth, result, 3).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {r.query_id: r.precision for r in ev.precision_at(q, truth, result, 3).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {r.query_id: r.reciprocal_rank for r in ev.reciprocal_rank(q, truth, result).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    per = ev.recall_at(q, truth, result, 3)
    assert ev.mean_recall(per, 3).first().mean_recall == pytest.approx(0.166667)
    with pytest.raises(ValueError, match="asked"):
        ev.mean_recall(per, 4)


def test_intrinsic_dimension(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.random((1500, 3)), np.zeros((1500, 5))], axis=1)
    base = VectorTable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    asked = VectorTable(base.df.filter("vec_id % 5 = 0"))
    from orrery.operators import knn

    near = knn.knn_join(base, asked, 20, "l2", exclude_self=True).cache()
    assert 2.3 < dx.lid_aggregates(dx.lid(near)).first().median < 3.8
    assert 2.2 < dx.two_nn_interval(near).first().dimension < 3.9
    n, edge = dx.spectral_outliers(base.rows)
    assert n == 3 and edge > 0
    same = spark.createDataFrame([(1, 2, 0.0, 1), (1, 3, 0.0, 2), (2, 3, 1.0, 1)], "query_id long, doc_id long, distance double, rank int")
    lids = {r.query_id: r.lid for r in dx.lid(same).collect()}
    assert lids[1] == float("inf") and np.isnan(lids[2])


def test_change_log(spark):
    log = spark.createDataFrame([(1, 1, "insert", 1.0), (1, 5, "delete", 0.0), (2, 2, "insert", 2.0), (2, 4, "update", 3.0), (3, 3, "delete", 0.0), (4, 6, "insert", 4.0)], "id long, seq long, op string, value double")
    assert {r.id: r.value for r in changes.live(log).collect()} == {2: 3.0, 4: 4.0}
    assert {r.id for r in changes.tombstones(log).collect()} == {1, 3}
    main = changes.live(log.filter("seq <= 3")).drop("op")
    assert {r.id: r.value for r in changes.merged(main, log.filter("seq > 3")).collect()} == {2: 3.0, 4: 4.0}
    assert tuple(changes.buffer_state(log).first()) == (2, 1)
    assert {r.id: r.level for r in changes.levels(log, first=2, ratio=1, most=3).collect()} == {4: 0, 2: 1}
    assert {r.seq: r.age for r in changes.aged(log, rows_per_slice=2).collect()} == {6: 0, 5: 1, 4: 2, 3: 3, 2: 4, 1: 5}
    assert changes.live(log.limit(0)).count() == 0 and changes.levels(log.limit(0)).count() == 0


def test_upsert_stream(spark, tmp_path):
    schema = "id long, seq long, op string, value double"
    source = str(tmp_path / "in")
    table = VersionedTable(str(tmp_path / "table"))
    spark.createDataFrame([(1, 1, "insert", 1.0), (2, 2, "insert", 2.0)], schema).coalesce(1).write.parquet(source)
    run = lambda: upsert.upsert_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "check")).awaitTermination(120)
    run()
    held = table.current(spark)
    spark.createDataFrame([(1, 4, "delete", 0.0), (2, 1, "update", 9.0), (3, 3, "insert", 3.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r.id: r.value for r in upsert.live(table, spark).collect()} == {2: 2.0, 3: 3.0}
    assert {r.id for r in held.collect()} == {1, 2}  # a version that a reader holds stays as it was
    before = table.versions(spark)
    upsert.apply_batch(table, spark.createDataFrame([(7, 9, "insert", 0.0)], schema), before[-1])  # replayed
    assert table.versions(spark) == before and table.pointer(spark) == before[-1]
    assert table.publish(spark.createDataFrame([(1, 1, "insert", 1.0)], schema)) == before[-1] + 1
    assert table.reclaim(spark, keep=1) == before
    counts = upsert.windowed_counts(spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, op string").select(F.to_timestamp("t").alias("ts"), "op"))
    assert sorted(r.n for r in counts.collect()) == [1, 2]


def test_upsert_after_a_crash(spark, tmp_path):
    schema = "id long, seq long, op string, value double"
    table = VersionedTable(str(tmp_path / "table"))
    batch = lambda i: spark.createDataFrame([(i, i, "insert", float(i))], schema)
    upsert.apply_batch(table, batch(1), 0)
    real, table.point = table.point, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        upsert.apply_batch(table, batch(2), 1)  # written, but the pointer hasn't moved
    table.point = real
    assert {r.id for r in upsert.live(table, spark).collect()} == {1}
    upsert.apply_batch(table, batch(2), 1)
    upsert.apply_batch(table, batch(3), 2)
    upsert.apply_batch(table, batch(9), 1)  # long past
    assert {r.id for r in upsert.live(table, spark).collect()} == {1, 2, 3}


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    (tmp_path / "v.jsonl").write_text("\n".join(json.dumps({"id": i, "vec": v.tolist()}) for i, v in enumerate(x)))
    from orrery import cli

    cli.main(["build", str(tmp_path / "v.jsonl"), "--out", str(tmp_path / "index")])
    cli.main(["search", str(tmp_path / "index"), "--query", json.dumps(x[7].tolist()), "-k", "3"])
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[1].split("\t")[0] == "7" and len(lines) == 4
    cos = x @ x[7] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[7])
    assert [int(r.split("\t")[0]) for r in lines[1:]] == np.argsort(-cos)[:3].tolist()


def test_sparse_products_against_plain_sums(spark):
    import random

    pick = random.Random(4)
    rows = [(pick.randrange(40), f"t{min(pick.randrange(30), pick.randrange(30))}", float(pick.randrange(-2, 5))) for _ in range(600)]
    rows += [(None, "t1", 9.0), (3, None, 9.0)]
    base = spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(5)
    got = {}
    for r in retrieval.sparse_mips(base, base.filter("doc_id < 6"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.doc_id))
    vectors = {}
    for d, t, w in rows:
        if d is not None and t is not None:
            vectors.setdefault(d, {}).setdefault(t, 0.0)
            vectors[d][t] += w
    for q in range(6):
        want = sorted((-sum(w * vectors[d][t] for t, w in vectors[q].items() if t in vectors[d]) + 0.0, d) for d in vectors if vectors[d].keys() & vectors[q].keys())[:7]
        assert [x[1:] for x in sorted(got[q])] == want
    assert retrieval.sparse_mips(base.limit(0), base, 3).count() == 0 and retrieval.sparse_mips(base, base.limit(0), 3).count() == 0
