"""Strings that hold other bytes than UTF-8: read with U+FFFD in their place, never an error."""

import pytest
from orrery.llm import chat_format, collocations, parity, pii, secrets, variants
from orrery.llm.work import keep

BAD = "SELECT id AS doc_id, CAST(concat(X'FF61C3', CAST(' mail jo@ex.com password=abcdef123456 spellling' AS BINARY)) AS STRING) AS text, 'en' AS lang, 'src' AS source FROM range(40)"


def test_secrets(spark):
    rows = secrets.report(secrets.scan(spark.sql(BAD))).collect()
    assert len(rows) == 40 and {(s["kind"], s["start"], s["end"]) for r in rows for s in r.base} == {(0, 19, 40)}


def test_pii(spark):
    docs = spark.sql(BAD)
    rows = pii.report(docs, keep).collect()
    assert len(rows) == 40 and {(s["kind"], s["start"], s["end"]) for r in rows for s in r.spans} == {(0, 9, 18)}
    clean = pii.sanitised(docs, keep).select("text").distinct().collect()
    assert len(clean) == 1 and "jo@ex.com" not in clean[0].text and clean[0].text.startswith("�a� mail")


def test_chat_format(spark):
    turns = spark.sql("SELECT 1L AS conv_id, id AS turn, CAST(X'75FF' AS STRING) AS role, CAST(X'61FF62' AS STRING) AS text FROM range(2)")
    row = chat_format.read_back(chat_format.format_turns(turns)).collect()
    assert [(r.conv_id, r.n_turns) for r in row] == [(1, 2)]


@pytest.mark.parametrize("run", [lambda d: parity.join(d), lambda d: collocations.collocations(d), lambda d: variants.variants(variants.words(d))])
def test_others_take_it(spark, run):
    assert run(spark.sql(BAD)).count()
