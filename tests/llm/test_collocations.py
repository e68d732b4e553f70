import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from orrery.llm import collocations, oracle, queries

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(docs, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    c = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    dropped = {(lang, w[i : i + m]) for (lang, w), a in c.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 80 * f[lang, w[i : i + m]]}
    rows = set()
    for lang in n:
        mine = []
        for (x, w), a in c.items():
            if x == lang and (x, w) not in dropped:
                score, k = min((2_000_000 * a // (f[x, w[:k]] + f[x, w[k:]]), k) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), f[x, w[:k]], f[x, w[k:]]))
        rows |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top])}
    return rows


def got(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def texts(n=400, seed=3):
    rng = random.Random(seed)
    words = ["a", "b", "the", "Über", "état", "of the", "new york city", "in the end of", "x\ty", "q", " "]
    out = []
    for _ in range(n):
        t = "".join(words[int(len(words) * rng.random() ** 2)] + rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\t", "; "]) for _ in range(rng.randint(0, 80)))
        out.append((t, rng.choice(["en", "en", "en", "fr", None])))
    return [*out, (None, "en"), ("", "de"), ("alone", "xx"), *out[:3], *out[:3]]


def test_against_plain_counting(spark):
    docs = texts()
    df = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase").repartition(3)
    for least, top, size in ((30, 2000, 300), (5, 7, 1 << 21)):
        assert got(collocations.collocations(df, least=least, top=top, size=size)) == plain(docs, least, top)


def test_query_and_sql_agree(spark, tmp_path):
    docs = [(i, t, x, "s", len(t or "")) for i, (t, x) in enumerate(texts(300, 8))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracle.SQL['op12_collocations']})").fetchall()}
    assert want == plain([d[1:3] for d in docs]) and want
    assert got(queries.op12_collocations(spark, str(tmp_path))) == want


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_intervals_of_random_sequences(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 2, 5, 50, 400):
        ids = rng.integers(0, 4, n)
        want = Counter(tuple(ids[i : i + m]) for m in range(1, most + 1) for i in range(n - m + 1) if ids[i : i + m].all())
        found = {tuple(ids[a : a + m]): c for m, at, count in collocations.lcp_intervals(ids, most) for a, c in zip(at.tolist(), count.tolist())}
        assert found == want


def test_shards_are_cut_and_filters_let_all_frequent_by(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a b c. d e"] * 500, "lang": ["en"] * 500})
    sizes = [s.size for s in collocations._shards([batch], collocations.Shard(None, None, False), 2000)]
    assert sizes == [2500]
    keys = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    for bits in (64, 1 << 12, 1 << 20):
        assert collocations.among(collocations.bitmap(collocations.masks(df, bits), bits), keys).all()
    other = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    assert collocations.among(collocations.bitmap(collocations.masks(df, 1 << 20), 1 << 20), other).mean() < 0.02
    assert not collocations.among(collocations.bitmap(collocations.masks(df.limit(0), 1 << 12), 1 << 12), keys).any()


def test_runs_that_are_frequent_over_shards_are_found(spark):
    """Runs of two and three words, each too rare in any one shard."""
    rng = np.random.default_rng(6)
    docs = [(" ".join(f"w{x}" for x in (rng.zipf(1.3, 50) % 300)), "en") for _ in range(300)]
    texts = collocations._texts(spark.createDataFrame(docs, "text string, lang string").repartition(3), "text", "lang")
    words, total = collocations.frequent_words(texts, 30, 400)
    assert total == 15_000
    often = {m: Counter(tuple(w[i : i + m]) for t, _ in docs for w in [t.split()] for i in range(len(w) - m + 1)) for m in (1, 2, 3)}
    found = (words, collocations.frequent_runs(texts, 2, 30, (words, None), total, 400))
    found = {2: found[1], 3: collocations.frequent_runs(texts, 3, 30, found, total, 400)}
    for m, bits in found.items():
        set_ = int(np.bitwise_count(bits).sum())
        want = sum(n >= 30 for n in often[m].values())
        assert want * 0.999 <= set_ <= want * 1.01 + 1 and want
    k = np.sort(rng.integers(0, 2**30, 1000))
    assert (collocations.unpacked(collocations.packed(k)) == k).all()


def test_counts_past_64_bits_scores(spark):
    big = 2**62
    rows = [("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 5), ("en", None, 0, 2**63 - 1), ("en", "a b c", 3, big // 10 * 8), ("en", "b c", 2, big // 10 * 8), ("en", "c", 1, big)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    found = {r.phrase: r.score for r in collocations.scored(counted).collect()}
    assert found["a b"] == 2_000_000 * (big - 1) // (2 * big + 5) and "b c" not in found


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([("x", "en")], "text string, lang string").limit(0)
    assert collocations.collocations(df).count() == 0
    bad = spark.sql("SELECT CAST(X'61ff20622061ff2062' AS STRING) AS text, 'en' AS lang FROM range(40)")
    assert {r.phrase for r in collocations.collocations(bad).collect()} == {"a� b", "a� b a� b"}
    long_ = spark.createDataFrame([("ab " * 300_000, "en")], "text string, lang string")
    assert got(collocations.collocations(long_)) == plain([("ab " * 300_000, "en")])
