import numpy as np
import pytest
import xxhash
from orrery.llm import simhash
from orrery.llm.components import components


def brute_components(fps):
    fps = list(dict.fromkeys(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(rng.integers(1, 8)):
            out.append(x)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
    return [x - 2**64 if x >= 2**63 else x for x in out]


def test_golay_is_perfect():
    code = simhash.Golay()
    assert len(set(code.error.tolist())) == 2048
    words = np.arange(1 << 23)
    assert np.bitwise_count(code.error[code.syndrome(words)]).max() == 3


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(5)
    code = simhash.Golay()
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    kx, wx = simhash.keys_of(x.view(np.int64), code)
    ky, wy = simhash.keys_of(y.view(np.int64), code)
    shared = set(zip(kx.tolist(), wx.tolist())) & set(zip(ky.tolist(), wy.tolist()))
    assert {w for _, w in shared} == set(range(len(x)))


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_match_brute_force(spark, bucket):
    fps = clusters(7, 60) + [0, 1, 3, 7, -1, 0]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").distinct()
    got = {r[0]: r[1] for r in components(simhash.links(df, bucket)).collect()}
    want = brute_components(fps)
    assert {f: got.get(f, f) for f in want} == want


def test_fingerprint_by_definition():
    for text in ["", "one", "A b\tC", "The quick brown fox jumps over the lazy dog the quick brown fox jumps", "é " * 9]:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text.encode()) == want


def test_groups_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, None, "x"), (3, "", "x"), (9, " \n", None), (None, "alone in here with words", "x"), (7, long, "x"), (7, long, "x"), (2, long + " tail", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (None, None), (7, 2), (7, 2), (2, 2)], key=str)
    assert simhash.groups(df.limit(0)).count() == 0
