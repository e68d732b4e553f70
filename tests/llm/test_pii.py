import math
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from orrery.llm import pii
from orrery.llm.work import keep

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a@.-+1 20(é4", max_size=40))
def test_base_spans_are_the_plain_patterns(t):
    assert pii.base_spans(t) == plain(t)


def test_known_values():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = "é mail a.b@c.example.com card 4111-1111 1111 1111, ip 10.0.0.256 1.2.3.4 call +1 (319) 555-5132."
    assert [(k, text[s:e]) for k, s, e in pii.base_spans(text)] == [(0, "a.b@c.example.com"), (1, "1.2.3.4"), (2, "4111-1111 1111 1111"), (3, "+1 (319) 555-5132")]
    assert pii.redact(text, [(s, e, k) for k, s, e in pii.base_spans(text)]) == "é mail <EMAIL> card <CARD>, ip 10.0.0.256 <IP> call <PHONE>."


def test_terms_that_reveal(spark):
    rows = [(i, f"note {i} from x{i} Falcon-nine é writes x@y.example.com about w{i} things here", "a") for i in range(6)]
    rows += [(1000 + i, f"plain words number {i} about things here", "b") for i in range(300)]
    rows += [(200, "falcon-nine seen alone", None), (None, "mail z@y.example.com", "c"), (201, None, "c"), (202, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.report(df, keep).collect()}
    assert len(got) == len(rows)
    marked = {i for i, r in got.items() if r.terms}
    assert marked == {0, 1, 2, 3, 4, 5, 200}
    text = dict((r[0], r[1]) for r in rows)
    assert {text[i][t["start"] : t["end"]].lower() for i in marked for t in got[i].terms} <= {"falcon-nine", "writes", "from", "note", "é"}
    assert "falcon-nine" in {text[200][t["start"] : t["end"]] for t in got[200].terms}
    assert pii.report(df.limit(0), keep).count() == 0


def test_copies_are_no_evidence(spark):
    rows = [(i, "the very same words with Secretname and x@y.example.com in all copies") for i in range(20)] + [(99, "words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(r.terms for r in pii.report(df, keep).collect())


def test_rows_that_share_an_id_keep_their_text(spark):
    rows = [(7, "falcon-nine seen", "x"), (7, "KEEP THIS TEXT WHOLE", "x"), (None, "the falcon-nine", None), (None, None, "y"), (None, "falcon-nine seen", "x")]
    rows += [(i, f"falcon-nine writes x@y.example.com as {i}", "z") for i in range(4)] + [(100 + i, f"plain words as {i}", "z") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _places string").repartition(5)
    for most in (pii.MOST, 0):  # beyond the bound of what is broadcast the result is the same
        before, pii.MOST = pii.MOST, most
        try:
            got = pii.sanitised(df, keep)
            assert got.columns == df.columns
            texts = sorted(((r.doc_id, r.text) for r in got.collect() if r.doc_id is None or r.doc_id < 10), key=str)
            spans = sorted((str(r.doc_id), [tuple(t) for t in r.terms]) for r in pii.report(df, keep).collect() if r.doc_id in (None, 7))
        finally:
            pii.MOST = before
        assert texts == sorted([(7, "<TERM> seen"), (7, "KEEP THIS TEXT WHOLE"), (None, "the <TERM>"), (None, None), (None, "<TERM> seen")] + [(i, f"<TERM> <TERM> <EMAIL> as {i}") for i in range(4)], key=str)
        assert spans == sorted([("7", [(0, 11)]), ("7", []), ("None", [(4, 15)]), ("None", []), ("None", [(0, 11)])])


def test_disclosure_by_plain_counting(spark):
    rng = random.Random(5)
    names = ["ann", "bob", "cy", "dee"]
    rows = []
    for i in range(150):
        words = [rng.choice([*names, "of", "to", "at"]) for _ in range(rng.randint(1, 5))] + [f"w{rng.randint(0, 4)}"]
        entity = rng.choice(["p@x.example", "q@x.example", None, None])
        if "ann" in words and rng.random() < 0.8:
            entity = "r@x.example"
        rows.append((i, " ".join([*words, *([entity] if entity else [])])))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])]
    found = {}
    for _, t in rows:  # one document for each context
        words = [w for w in t.split() if "@" not in w]
        found.setdefault(tuple(words), set()).update(w for w in t.split() if "@" in w)
    terms = {w for c in found for w in c if not any(x.isdigit() for x in w)}
    want = set()
    for t in terms:
        for e in {e for s in found.values() for e in s}:
            both, df = sum(t in c and e in s for c, s in found.items()), sum(t in c for c in found)
            share = both / df
            if both >= 2 and share >= 0.4 and math.log2(share / (sum(e in s for s in found.values()) / len(found))) >= 0.5:
                want.add(t)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scanned = keep(pii.scan(docs), "t")
    pairs = keep(pii.candidate_terms(scanned, 2), "t")
    bad = pii.revealing(pairs, pii.document_counts(docs, pairs, scanned), scanned.select("context").distinct().count(), pii.mentions_of(scanned), 0.4, 0.5)
    hashes = dict(zip(sorted(terms), pii.term_words(pa.array([" ".join(sorted(terms)).encode()], pa.binary())).hashes().view(np.int64).tolist()))
    assert want and {r.term for r in bad.collect()} == {hashes[t] for t in want}


def marked_words(df, spark):
    return {r.doc_id: {df[r.doc_id][t["start"] : t["end"]] for t in r.terms} for r in pii.report(spark.createDataFrame(list(df.items()), "doc_id long, text string").repartition(3), keep).collect()}


def test_copies_count_once_in_both_parts(spark):
    texts = {i: f"Marlowe x@y.example.com letter {i} plain words here" for i in range(3)}
    texts |= {100 + i: texts[0] for i in range(50)}
    texts |= {1000 + i: f"letter {i} of plain words here" for i in range(300)}
    got = marked_words(texts, spark)
    assert got[0] == got[2] == got[120] == {"Marlowe"} and not got[1000]


def test_terms_anywhere_in_the_text_without_punctuation(spark):
    filler = lambda i: " ".join(f"w{i}x{j}" for j in range(200))
    forms = ["Quillfeather,", "(quillfeather)", "«Quillfeather»", "“Quillfeather”…"]
    texts = {i: f"Dear {f} {filler(i)} +1 (319) 555-5132" for i, f in enumerate(forms)}
    texts |= {50: "nothing but quillfeather."} | {1000 + i: f"Dear reader {i}" for i in range(300)}
    got = marked_words(texts, spark)
    assert {w.lower() for i in (0, 1, 2, 3, 50) for w in got[i]} == {"quillfeather"} and all(got[i] for i in (0, 1, 2, 3, 50))
