import math
import random
import zlib
from collections import Counter

import pytest
from orrery.llm import lm


def reference(docs):
    """The model by plain counting, with the weights from as many rounds of the same updates."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {i: low(t).split() + ["</end>"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    uni, pair, ctx, triple, ctx2 = (Counter() for _ in range(5))
    grams = lambda t: zip(["<begin>", "<begin>", *t], ["<begin>", *t], t)
    for i, t in tokens.items():
        if not held[i]:
            uni.update(t)
            for g, h, w in grams(t):
                pair[h, w] += 1
                ctx[h] += 1
                triple[g, h, w] += 1
                ctx2[g, h] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    m3, m2 = ({0: 0.0} | {k: 0.5 for k in range(1, 60)} for _ in range(2))

    def parts(g, h, w):
        b3, b2 = ctx2[g, h].bit_length(), ctx[h].bit_length()
        three = m3[b3] * triple[g, h, w] / max(ctx2[g, h], 1)
        two = (1 - m3[b3]) * m2[b2] * pair[h, w] / max(ctx[h], 1)
        return b3, b2, three, two, (1 - m3[b3]) * (1 - m2[b2]) * p1(w)

    for _ in range(60):
        got3, of3, got2, of2 = (Counter() for _ in range(4))
        for i, t in tokens.items():
            for g, h, w in grams(t) if held[i] else ():
                b3, b2, *p = parts(g, h, w)
                x = [y / sum(p) for y in p]
                got3[b3] += x[0]
                of3[b3] += 1
                got2[b2] += x[1]
                of2[b2] += x[1] + x[2]
        clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
        new3, new2 = m3 | {k: clip(got3[k] / of3[k]) for k in of3 if k}, m2 | {k: clip(got2[k] / of2[k]) for k in of2 if k}
        moved = max(abs(x[k] - y[k]) for x, y in ((new3, m3), (new2, m2)) for k in y)
        m3, m2 = new3, new2
        if moved < 1e-4:
            break
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10(p1(w)) for w in t)
        out[i] = (held[i], len(t), sum(uni[w] > 0 for w in t), n, base, sum(math.log10(sum(parts(*x)[2:])) for x in grams(t)))
    return out


def test_matches_plain_counting(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "THE", "the"]
    docs = []
    for i in range(300):
        w, x = [], rng.randrange(60)
        for _ in range(rng.randint(0, 40)):
            x = (x * 7 + rng.randint(0, 3)) % len(vocab)
            w.append(vocab[x])
        docs.append((i, " ".join(w)))
    docs += [(1000, None), (1001, "never-seen-word " * 3), (1002, " ".join(docs[5][1] for _ in range(300)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = reference(docs)
    got = {r.doc_id: r for r in lm.score(df).collect()}
    assert got.keys() == want.keys()
    for i, (held, n, known, train, base, s) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(s, rel=1e-6)
    out = [r for r in got.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_numbers_survive_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 31, 32, 33, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm._keys(lm._squeezed(keys)) == keys).all() and len(keys) == n
        counts = rng.integers(0, 3, n)
        assert (lm._large(lm._small(counts)) == counts).all()


def test_small_blocks_and_slices_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(500, "a b c " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    one = sorted(map(tuple, lm.score(df).collect()))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm, "SLICE_TOKENS", 5000)
    many = sorted(map(tuple, lm.score(df).collect()))
    assert all(x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9) for x, y in zip(one, many)) and len(one) == len(many) == 121


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "a b", None), (1, "a b", "y")], "doc_id long, text string, block string")
    assert lm.score(df).count() == 3
    assert lm.score(df.limit(0)).count() == 0
