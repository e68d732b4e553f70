import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from orrery.llm import oracle, parity, queries
from pyspark.sql import functions as F


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def plain(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(sets[d]), find(d)) for d in ids}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randint(0, 1)] = [rng.choice("pqrstu") + str(rng.randrange(9))] * rng.randint(0, 1)
    return w


def corpus(seed, n=300):
    """Chains of near copies of all sizes, unlike texts, short ones, and a shared passage."""
    rng = random.Random(seed)
    docs, passage = [], [f"b{i}" for i in range(12)]
    while len(docs) < n:
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(int(2 + 400 * rng.random() ** 3))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            base = edited(rng, base, rng.randint(0, 1 + len(base) // 60))
            docs.append(" ".join(base if rng.random() < 0.8 else base + passage))
    docs[5], docs[6], docs[7], docs[8] = None, "", "One", "one"
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "block", "small"), [(1, 512, 32), (2, 3, 2), (3, 4, 0)])
def test_against_every_pair(spark, seed, block, small):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS cell").repartition(3)
    want = plain(docs)
    assert len({c for _, _, c in want}) < len(docs) - 30
    assert got(parity.join(df, block=block, small=small)) == want


def test_query_and_sql_agree(spark, tmp_path):
    docs = [(d, t, "en", "s", len(t or "")) for d, t in corpus(5, 120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = set(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({oracle.SQL['op11_jaccard_join']})").fetchall())
    assert got(queries.op11_jaccard_join(spark, str(tmp_path))) == want == plain([d[:2] for d in docs])


def test_bound_and_bands():
    for s in range(1, 3000):
        want = max(((s * 100 // 90) - s if i == s else 0) for i in (s,))
        assert parity.differences(s) >= want
        # every union that a linked pair may have, with the smaller set of s shingles
        assert all(u - i <= parity.differences(s) for u in range(s, s * 100 // 90 + 1) for i in [-(-90 * u // 100)] if i <= s)
    high = parity.bands(20_000)
    assert all(b >= 100 * a // 90 for a, b in zip(high[1:], high[2:])) and parity.differences(int(high[0])) == 0 < parity.differences(int(high[0]) + 1)


def test_sketches_bound_the_differences():
    rng = random.Random(3)
    words = [str(i) for i in range(600)]
    texts = [" ".join(edited(rng, words, k)) for k in (0, 3, 10, 40)]
    s = parity.Sets(pa.array(texts))
    cells = parity.differences(700) + 1
    bits = s.sketch(np.full(4, cells)).reshape(4, cells)
    for i in range(4):
        for j in range(4):
            far = len(np.setxor1d(s.h[s.first[i] : s.first[i + 1]], s.h[s.first[j] : s.first[j + 1]]))
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= far and (bits[i] != bits[j]).sum() <= far


def test_briefs_bound_the_differences_in_few_bytes(spark):
    rng = random.Random(3)
    words = [str(i) for i in range(900)]
    texts = [" ".join(edited(rng, words[:n], k)) for n in (500, 520, 900) for k in (0, 3, 20)] + [" ".join(f"u{i}" for i in range(510))]
    s = parity.Sets(pa.array(texts))
    flat, n = s.briefs()
    briefs = np.split(flat, np.cumsum(n)[:-1])
    assert {8, 16} <= set(n.tolist())
    for i, x in enumerate(briefs):
        for j, y in enumerate(briefs):
            few = min(len(x), len(y))
            bits = int(np.bitwise_count(parity.folded(x, few) ^ parity.folded(y, few)).sum())
            far = len(np.setxor1d(s.h[s.first[i] : s.first[i + 1]], s.h[s.first[j] : s.first[j + 1]]))
            assert bits <= far
    size = s.size
    assert not parity._may_link(size[0], size[-1], np.bitwise_count(briefs[0] ^ briefs[-1]).sum(), 90)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    sketched = parity.sketches(df, "k").select(*(F.sum(F.size(c)) for c in ("brief", "own", "before"))).first()
    assert 8 * sketched[0] < sketched[1] + sketched[2]  # what a pair that meets by chance carries


def test_a_cell_that_most_documents_share_spreads(spark):
    """Two thirds of all documents are one boiler-plate with a tenth of their own: they share cells
    without a link. And chains of near copies whose first isn't linked to the last."""
    rng = random.Random(9)
    plate = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(plate + [f"x{i}y{j}" for j in range(12)])) for i in range(400)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(400, 600):
        chain = edited(rng, chain, 2)
        docs.append((i, " ".join(chain)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sketched = parity.sketches(df.withColumn("k", F.col("doc_id")), "k")
    rows = parity.cells(sketched)
    most = rows.groupBy("cell").count().agg(F.max("count")).first()[0]
    spread = rows.filter(F.col("cell") == rows.groupBy("cell").count().orderBy(F.desc("count")).first()[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = parity.meetings(spread.repartition(4)).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most > 100 and len(tasks) > 1 and max(t["count"] for t in tasks) < 0.6 * most
    assert got(parity.join(df, block=16, small=8)) == plain(docs)


def test_odd_rows(spark):
    text = " ".join(str(i) for i in range(40))
    rows = [(None, text), (None, text), (4, text + " more"), (9, text), (9, text), (9, "else"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity.join(df).collect()), key=str)
    assert found == sorted([(None, 38, 4), (None, 38, 4), (4, 39, 4), (9, 38, 4), (9, 38, 4), (9, 1, 9), (2, 0, 2), (2, 0, 2)], key=str)
    assert parity.join(df.limit(0)).count() == 0
    long_ = " ".join(str(i % 70_001) for i in range(200_000))
    df = spark.createDataFrame([(1, long_), (2, long_ + " x"), (3, long_[: len(long_) // 4])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in parity.join(df).collect()} == {(1, 1), (2, 1), (3, 3)}
