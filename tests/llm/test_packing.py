import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from orrery.llm import packing


TEXTS = [
    "", "Hello, world's  end\n\n9 don't Á ﬁ \x1c x\x1fy", "naïve café 東京 3,14 ''s", "a b ́x ΣΑΣ ς", "x" * 5000, "Don't. end., é. É, ß. İ, 3. it's, a.b. <|endoftext|> x<|endoftext|>. K. »,",
    "İstanbul İSTANBUL, ǅ ŉ x<|startoftext|>y <|ENDOFTEXT|> e\u0301 \u0301 \u00a0 a\u00a0b \u3000 \u200b", "<|startoftext|>", "a'S, 's. 'LL.", " . , ., a, 1.",
]


def plain_ids(text):
    from tokenizers import Tokenizer

    global _plain
    _plain = globals().get("_plain") or Tokenizer.from_file(packing.tokenizer_path())
    return _plain.encode(text, add_special_tokens=False).ids + [packing.END_ID]


def ids_of(tok, texts):
    ids, begin = tok.encode(pa.array([t.encode() for t in texts], pa.binary()))
    return [ids[i:j].tolist() for i, j in zip(begin[:-1], begin[1:])]


@pytest.mark.parametrize("slots", [1 << 19, 8, 64])
def test_ids_are_the_tokenizers(slots, monkeypatch):
    monkeypatch.setattr(packing.WordTokenizer, "SLOTS", slots)
    monkeypatch.setattr(packing.WordTokenizer, "IDS", 40 * slots)
    tok = packing.WordTokenizer(packing.tokenizer_path())
    for texts in (TEXTS, TEXTS[::-1], TEXTS[3:4], TEXTS * 2, [], ["end"]):
        assert ids_of(tok, texts) == [plain_ids(t) for t in texts]


PARTS = ["İ", "ß", "Σ", "\u0301", "\u0327", "東", "가", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'", ".", ",", " ", "\n", "\u00a0", "\x1c", "é", "A", "z", "9", "٣", "🙂", "\u200d", "…"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=4))
def test_ids_of_any_text(texts):
    global _tok
    _tok = globals().get("_tok") or packing.WordTokenizer(packing.tokenizer_path())
    assert ids_of(_tok, texts) == [plain_ids(t) for t in texts]


def test_long_text_in_parts(spark, monkeypatch):
    text = "İ word, " * 200_000  # over a megabyte
    assert b"".join(packing._parts(text.encode())) == text.encode() and len(packing._parts(text.encode())) > 1
    got = packing.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("piece").collect()
    want = plain_ids(text)
    assert sum(r.length for r in got) == len(want)
    for r in got:
        part = want[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and r.start == 4096 * r.piece


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(40)}
    used = defaultdict(list)
    for length, start, n, per, first, offset in packing.plan(histogram, 100):
        for i in range(n):
            used[first + i // per].append((offset + i % per * length, length))
    assert sum(len(x) for x in used.values()) == sum(histogram.values())
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 100
    bins = []  # best-fit decreasing, one piece at a time
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [b for b in bins if b >= length]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else 100) - length)
    assert len(used) == len(bins)


def test_pack(spark):
    rows = [(i, "word " * (i % 7 * 1000), "en") for i in range(40)] + [(3, None, "en"), (3, "same", "x"), (3, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    pieces = packing.tokenize(df)
    got = packing.pack(pieces, rows_per_bucket=3).collect()
    assert len(got) == pieces.count()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    empty = [r for r in got if r.doc_id == 3 and r.length == 1]
    assert empty[0].ids_crc32 == zlib.crc32((1).to_bytes(4, "little"))
    assert packing.pack(packing.tokenize(df.limit(0))).count() == 0
