import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from orrery.llm import decontaminate as dec


def distance(item, words):
    """Fewest edits of the item to any stretch of the words, one cell at a time."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, vocab, words, d):
    w = list(words)
    for _ in range(d):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice(vocab)
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, rng.choice(vocab))
    return w


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of"] * 600
    items = [[rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(25)]
    docs = []
    for i in range(250):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 2:
            x = rng.choice(items)
            w[rng.randint(0, len(w)) : 0] = edited(rng, vocab, x, rng.randint(0, len(x) // 4))
        docs.append(w)
    return items, docs


def test_recall_and_precision(spark):
    items, docs = corpus()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, ", ".join(w).upper() + ".") for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.edits for r in dec.contaminated(df, bench).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            if set(x) & set(d) and (e := distance(x, d)) <= dec.edits_allowed(len(x), dec.SIMILARITY):
                want[i, j] = e
    assert set(got) <= set(want)
    assert all(got[k] >= want[k] for k in got)
    assert len(want) > 80
    assert len(got) >= 0.97 * len(want)


def test_small_blocks_and_edge_cases(spark, monkeypatch):
    items, docs = corpus(5)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "the of")], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(docs)] + [(None, " ".join(items[3]), "y"), (7, None, None)], "doc_id long, text string, item_id string")
    all_ = {tuple(r) for r in dec.contaminated(df, bench).collect()}
    assert any(r[0] is None and r[1] == 3 and r[2] == 0 for r in all_)
    monkeypatch.setattr(dec, "BLOCK_WORDS", 100)
    split = {tuple(r)[:2] for r in dec.contaminated(df, bench).collect()}
    assert len(split ^ {r[:2] for r in all_}) <= 0.05 * len(all_)
    assert dec.contaminated(df.limit(0), bench).count() == 0
    assert dec.contaminated(df, bench.limit(0)).count() == 0


def brute(items, docs):
    out = {}
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            allowed = dec.edits_allowed(len(x), dec.SIMILARITY)
            if len(set(x) & set(d)) and (e := distance(x, d)) <= allowed:
                out[i, j] = e
    return out


def test_recall_on_items_of_any_length(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(20_000)]
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 14, 15, 16, 17, 24, 31, 40, 77, 150, 500]
    items = [[rng.choice(vocab) for _ in range(n)] for n in lengths]
    docs = []
    for _ in range(12):
        for x in items:
            if len(x) <= 150 or rng.random() < 0.2:
                allowed = dec.edits_allowed(len(x), dec.SIMILARITY)
                docs.append([rng.choice(vocab) for _ in range(rng.randint(0, 9))] + edited(rng, vocab, x, allowed + (rng.random() < 0.2)) + [rng.choice(vocab) for _ in range(rng.randint(0, 9))])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got, want = {(r.doc_id, r.item_id): r.edits for r in dec.contaminated(df, bench).collect()}, brute(items, docs)
    assert set(got) <= set(want) and len(want) > 150
    assert len(got) >= 0.95 * len(want)
    assert all(got[k] >= want[k] for k in got) and sum(got[k] > want[k] for k in got) <= 2


def test_windows_are_what_finds_them():
    rng = random.Random(2)
    items = [" ".join(f"a{rng.randint(0, 5000)}" for _ in range(n)) for n in (6, 20, 60)]
    block = dec.Block(list(enumerate(items)), 0.8, 0.99)
    assert 1 < block.repetitions < dec.REPETITIONS
    w = dec.words_of(pa.array([f"x y {t} z".encode() for t in items], pa.binary()))
    assert {(f[0], f[1], f[2]) for f in block.find(w)} == {(0, 0, 0), (1, 1, 0), (2, 2, 0)}
    for t in block.tables:
        t.tables = [(k[:0], o[:0], m & False) for k, o, m in t.tables]
    assert block.find(w) == []  # nothing but the keys leads to a pair


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(dec, "REPETITIONS", 1)
    with pytest.raises(ValueError, match="recall"):
        dec.Block([(0, "a b c d e f g h i j k l m n o p q r s t")], 0.8, 0.99)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=70))
def test_best_stretch(item, words):
    edits, lo, hi = dec.best_stretch(item, words)
    assert edits == distance(item, words)
    ends = lambda t: max(distance(item, t), 0)
    assert ends(words[lo:hi]) == edits and (edits == len(item) or all(distance(item, words[i:j]) > edits for i in range(len(words)) for j in [i + hi - lo - 1] if i <= j <= len(words)))


def test_very_long_item_and_text(spark):
    words = [f"w{i % 997}x{i % 13}" for i in range(20_000)]
    text = " ".join(words)
    block = dec.Block([(0, text)], 0.8, 0.99)
    changed = ["z" if i % 11 == 0 else w for i, w in enumerate(words)]
    w = dec.words_of(pa.array([(" ".join(changed) + " end").encode()], pa.binary()))
    found = block.find(w)
    assert len(found) == 1 and found[0][2] == 1819


def test_words():
    w = dec.words_of(pa.array(["Don't, STOP!\tÉté.".encode()], pa.binary()))
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end)] == ["don", "t", "stop", "Été"]
