import random

import corpus_pipeline as cp
import pyarrow as pa
from orrery.llm import decontaminate, packing, pii, quality, simhash
from pyspark.sql import functions as F


def make(tmp_path, spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    rows = [(i, prose(rng.randint(90, 200))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (102, prose(40)), (103, " ".join(w + "$$$ |" for w in prose(90).split()))]
    rows += [(104, prose(60) + " " + item + " " + prose(40)), (105, prose(90) + " mail a.b@c.example.com now"), (106, None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], cols)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return dict(rows), item


def test_pipeline_against_plain_steps(spark, tmp_path):
    texts, item = make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = set(texts) - {102, 103, 106}  # too short, junk, empty
    stage = cp.quality_rules(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns and {r.doc_id for r in stage.select("doc_id").collect()} == kept
    fps = {i: simhash.fingerprint(texts[i].encode()) for i in kept}
    near = {i for i in kept if any(j < i and bin(fps[i] ^ fps[j]).count("1") <= 4 for j in kept)}
    assert 100 in near and len(near) <= 2
    stage = cp.near_dedup(spark, stage, str(tmp_path))
    assert stage.columns == docs.columns and {r.doc_id for r in stage.select("doc_id").collect()} == kept - near
    stage = cp.decontamination(spark, stage, str(tmp_path))
    assert {r.doc_id for r in stage.select("doc_id").collect()} == kept - near - {104}
    stage = cp.personal_data(spark, stage, str(tmp_path))
    got = {r.doc_id: r for r in stage.collect()}
    assert got[105].text == texts[105].replace("a.b@c.example.com", "<EMAIL>") and got[105].n_chars == len(got[105].text)
    assert all(got[i].text == texts[i] for i in got if i != 105) and stage.columns == docs.columns
    tok = packing.WordTokenizer(packing.tokenizer_path())
    want = len(tok.encode(pa.array([r.text.encode() for r in got.values()], pa.binary()))[0])
    packed = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(got)
    assert sum(r.length for r in packed) == want
    assert len({r.sequence_id for r in packed}) == -(-want // 4096)


def test_stages_take_odd_rows(spark, tmp_path):
    make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({c: F.lit(1) for c in ("_key", "_f", "_t", "_d", "_code", "_p", "_terms", "_id", "_kept")})
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert simhash.survivors(odd).columns == odd.columns
    assert len({*cp.STAGES}) == 5 and all(m.__doc__ for m in (decontaminate, packing, pii, quality, simhash))
