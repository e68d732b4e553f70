import random

import corpus_pipeline as cp
from orrery.llm import near_copies, simhash
from pyspark.sql import functions as F


def plain(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    texts = []
    for _ in range(60):
        w = [word() for _ in range(rng.randint(50, 150))]
        for _ in range(rng.randint(1, 6)):  # a chain: each a change of the one before
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
    base = [word() for _ in range(300)]
    for i in range(60):  # a large group round one text
        texts.append(" ".join(base[:i] + [word()] + base[i + 1 :]))
    rng.shuffle(texts)
    return texts + [None, "", " \n", "one two", "One  two", "two one", "a b c d e", "a b c d e a b c d e"]


def survivors(texts):
    sets = [plain(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def test_stage_matches_brute_force_jaccard(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in cp.near_dedup(spark, df, "").select("doc_id").collect()]
    want = survivors(texts)
    assert sorted(got) == sorted(want)
    by_bits = {r.doc_id for r in simhash.survivors(df).select("doc_id").collect()}
    assert len(by_bits - want) > 10  # near copies that four bits leave
    assert near_copies.survivors(df.limit(0)).count() == 0
    twice = near_copies.survivors(df.union(df).withColumn("doc_id", F.lit(None).cast("long")))
    assert twice.count() == len(want)


def test_stage_goes_through_simhash(spark, monkeypatch):
    """Without MinHash the stage still joins what fingerprints within four bits tell."""
    texts = corpus()
    fps = [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    sets, group = [plain(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or ((fps[i] ^ fps[j]).bit_count() <= 4 and len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    want = {i for i, g in enumerate(group) if i == g}
    assert len(texts) - len(want) > 40
    every = near_copies.meetings
    monkeypatch.setattr(near_copies, "meetings", lambda bands: every(bands.limit(0)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in cp.near_dedup(spark, df, "").select("doc_id").collect()} == want
