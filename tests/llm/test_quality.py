import random

import numpy as np
import pyarrow as pa
from orrery.llm import quality
from pyspark.sql import functions as F


def plain(text):
    text = text or ""
    words = text.encode().split()
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {t for t in tri if tri.count(t) > 1}
    covered = {i + j for i, t in enumerate(tri) if t in often for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct_words": len(set(words)),
    }


def texts():
    rng = random.Random(2)
    vocab = ["a", "bé", "long-word-of-many", "###", "|", "x<y", "1", "ñ.", " "]
    return ["", "one", "a\n\na\n a\n", *("".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(200))]


def test_features_match_plain_counting():
    got = quality.features_of(pa.array([t.encode() for t in texts()], pa.binary()))
    for i, t in enumerate(texts()):
        want = plain(t)
        assert {k: int(got[k][i]) for k in want} == want


def test_em_recovers_planted_classes():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.where(rng.random((20_000, 8)) < 0.2, 0, 1)
    for j in range(8):
        flagged = np.where(good, rng.random(20_000) < 0.005, rng.random(20_000) < 0.45)
        votes[flagged, j] = -1
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found = quality.fit(patterns, n)
    kept = post[which.ravel()] >= 0.5
    assert (kept == good).mean() > 0.98
    assert abs(found["prior"] - 0.85) < 0.01
    assert np.allclose(found["right_good"], 0.994, atol=0.003) and np.allclose(found["right_bad"], 0.45 / (0.45 + 0.8 * 0.55), atol=0.03)


def test_accuracies_are_those_of_the_votes():
    """Rules of very different accuracy, poor ones too, are told apart; a plain likelihood agrees."""
    rng = np.random.default_rng(7)
    n, right_good, right_bad = 60_000, np.array([0.99, 0.97, 0.9, 0.8, 0.95, 0.99, 0.7, 0.98]), np.array([0.6, 0.9, 0.2, 0.5, 0.75, 0.3, 0.8, 0.55])
    good = rng.random(n) < 0.7
    right = rng.random((n, 8)) < np.where(good[:, None], right_good, right_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((n, 8)) > 0.1)
    patterns, which, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found = quality.fit(patterns, count)
    assert np.allclose(found["right_good"], right_good, atol=0.03) and np.allclose(found["right_bad"], right_bad, atol=0.05)
    for i in rng.choice(len(patterns), 30):  # Bayes' rule, a rule at a time
        g, b = found["prior"], 1 - found["prior"]
        for v, x, y in zip(patterns[i], found["right_good"], found["right_bad"]):
            g, b = (g * x, b * (1 - y)) if v == 1 else (g * (1 - x), b * y) if v == -1 else (g, b)
        assert abs(g / (g + b) - post[i]) < 1e-5


def test_judge(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(120)) for i in range(300)] + [(1000 + i, " ".join(w + "$$$ | %%%" for w in prose(100).split())) for i in range(30)]
    rows += [(2000 + i, (prose(10) + "\n") * 20) for i in range(30)] + [(5000, None), (5001, ""), (5002, prose(20)), (None, prose(200)), (7, prose(150_000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    judged = quality.judge(df.select("doc_id", quality.features(F.col("text")).alias("f")), "f").collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert len(judged) == len(rows)
    assert kept >= {None, *range(300)} and not kept & {5000, 5001, 5002, *range(1000, 1030), *range(2000, 2030)}
    assert quality.judge(df.limit(0).select(quality.features(F.col("text")).alias("f")), "f").count() == 0


def test_one_bound_on_distinct_words_at_every_length(spark):
    sizes = [(5000, 200), (5001, 200), (100_000, 200), (100_000, 20_000), (1000, 140), (1000, 160)]
    empty = {f.name: 0 for f in quality.FEATURES}
    df = spark.createDataFrame([(i, {**empty, "n_words": n, "n_distinct_words": k}) for i, (n, k) in enumerate(sizes)], quality.T.StructType([quality.T.StructField("i", quality.T.LongType()), quality.T.StructField("f", quality.FEATURES)]))
    votes = [r[0] for r in df.orderBy("i").select(quality.rules(F.col("f"))[7]).collect()]
    assert votes == [quality.BAD, quality.BAD, quality.BAD, quality.ABSTAIN, quality.BAD, quality.ABSTAIN]
