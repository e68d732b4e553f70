import random

from orrery.llm import substrings


def brute(docs):
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    seen, out = {}, {}
    for i in order:
        w = (docs[i][1] or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            x = b" ".join(w[s : s + 20])
            if x in seen:
                gone.update(range(s, s + 20))
            else:
                seen[x] = 1
        out[docs[i][0]] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "longer-word-than-eight-bytes", "another-longer-word-than-16-bytes"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(rng.choice([19, 20, 21, 35, 80])) for _ in range(12)]
    docs = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += text(rng.randint(0, 30))
            p = rng.choice(passages)
            cut = rng.randint(0, 3)
            w += p[cut : len(p) - rng.randint(0, 3)] if rng.random() < 0.7 else []
        docs.append((i * 3, " ".join(w)))
    docs += [(1000, docs[7][1]), (1001, "a " * 60), (1002, None), (1003, ""), (1004, "a\n" * 25 + "b"), (1005, "u " * 21 + "v w x y z"), (1006, "p q " * 30 + "s " * 50)]
    rng.shuffle(docs)
    return docs


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_duplicates(df).collect()}
        assert got == brute(docs)


def test_edge_cases(spark):
    t = " ".join(f"x{i}" for i in range(30))
    rows = [(1, t, "k"), (1, t, "k"), (2, "y " + t, None), (None, t + " z", "k"), (2, "other text", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 30, 30), (1, 30, 30), (2, 31, 30), (None, 31, 0), (2, 2, 0)], key=str)
    assert substrings.remove_duplicates(df.limit(0)).count() == 0


def test_factors_name_their_sources(spark):
    docs = dict(corpus(3))
    rows = substrings.remove_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    words = {i: (t or "").split() for i, t in docs.items()}
    n = 0
    for r in rows:
        covered = set()
        for f in r.factors:
            assert f.length >= substrings.WINDOW and (f.source, f.source_start) < (r.doc_id, f.start)
            assert words[f.source][f.source_start : f.source_start + f.length] == words[r.doc_id][f.start : f.start + f.length]
            covered.update(range(f.start, f.start + f.length))
            n += f.length > substrings.WINDOW
        assert len(covered) == r.n_removed == sum(s.end - s.start for s in r.spans)
        starts = [f.start for f in r.factors]
        assert starts == sorted(set(starts))
    assert n > 50


def test_very_long_and_periodic_texts(spark):
    rng = random.Random(6)
    long_ = [f"v{rng.randint(0, 5000)}" for _ in range(300_000)]
    docs = [(1, " ".join(long_)), (2, " ".join(long_[1000:1050] + ["x"] + long_[250_000:250_030])), (3, "ab " * 100_000), (4, "c " + "ab " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_duplicates(df).collect()}
    assert got == brute(docs)
