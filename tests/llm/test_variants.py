import random
import re
import zlib
from collections import Counter

import pytest
from orrery.llm import queries, variants


def plain_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(n, times=10):
    out, form = {}, {}
    for w in n:
        others = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_against_every_pair_of_a_table(spark, tmp_path):
    rng = random.Random(4)
    letters = "abÉé÷ÿz"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa", "aaaaaab", "abababab", "babababa"]
    vary = lambda w: (i := rng.randrange(len(w) + 1), rng.choice(["", *letters]), rng.randrange(2))
    docs = []
    for d in range(300):
        ws = []
        for _ in range(rng.randint(0, 60)):
            w = stems[int(len(stems) * rng.random() ** 3)]
            if rng.random() < 0.3:
                i, c, o = vary(w)
                w = w[:i] + c + w[i + o :]
            ws.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((d, rng.choice([" ", ", ", "1"]).join(ws)))
    docs += [(None, "aaaaaaaa aaaaaaaa"), (300, None), (301, ""), (302, docs[7][1]), (302, docs[7][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = plain(plain_words(docs))
    assert any(r[1] for r in want) and len(want) > 200
    assert got(queries.op13_spelling_variants(spark, str(tmp_path))) == want


def test_chains_and_ties(spark):
    n = {"letters": 5000, "lettters": 400, "letterts": 400, "lletterts": 30, "llettertss": 2, "unlinked": 9, "zetters": 400, "zettera": 3}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(variants.variants(df)) == plain(n)


@pytest.mark.parametrize("share", [0.5])
def test_a_third_of_all_words_are_anagrams(spark, share):
    """Words of the same letters meet at one key; they are dealt by the order of their letters."""
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3000)}
    words |= {w[:4] + "x" + w[5:] for w in list(words)[:400]} | {w[:3] + w[4:] for w in list(words)[:400]}
    numbers = variants.numbered(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    rows = variants.meeting_rows(numbers).repartition(16, "meet", "order")
    sizes = [r["count"] for r in rows.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert max(sizes) < 1.3 * sum(sizes) / 16
    most = rows.groupBy("meet").count().agg({"count": "max"}).first()[0]
    assert most > 2000 > 60 > rows.groupBy("meet", "order").count().agg({"count": "max"}).first()[0]


def test_very_long_words_and_empty_tables(spark):
    long_ = "ab" * 60_000
    df = spark.createDataFrame([(long_, 20), (long_[1:], 2), (long_ + "c", 200)], "word string, n long")
    assert {(len(r.word), len(r.form or ""), len(r.root), r.n_near) for r in variants.variants(df).collect()} == {(120_000, 120_001, 120_001, 2), (119_999, 120_000, 120_001, 1), (120_001, 0, 120_001, 1)}
    assert variants.variants(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "Some words words, WORDSES wordses", "a", 3)], "doc_id long, text string, word string, n long")
    assert [(r.word, r.n) for r in variants.words(docs).collect()] == [("wordses", 2)]
