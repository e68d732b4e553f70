"""Quality rules by weak supervision.

Every rule votes good, bad or abstains on each document. Expectation-maximisation over the
observed vote patterns estimates each rule's accuracy on good and on bad documents, with no
labels, and a document is kept when the posterior probability that it is good reaches the
threshold. The corpus reaches the driver only as counts per vote pattern, at most
3 ** N_RULES rows whatever its size.

Defined results: null text has no words and is rejected by the base rule; null ids are like any
other; repeated rows count as often as they occur; documents of one vote pattern, and those at the
threshold, have one verdict; a very long text is one piece of work; an empty table gives an empty result; columns of the input are
kept by ``judge`` and never clash, as features come in one struct column that the caller names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .ids import fresh
from .work import trim

GOOD, BAD, ABSTAIN = 1, -1, 0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0x100)]] = True
_ALNUM = _LETTER.copy()
_ALNUM[list(b"0123456789")] = True

FEATURES = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_distinct_words", "alnum_chars")])


def _per_doc(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def features_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The features of each text, as arrays."""
    w = tx.Words(texts)
    raw, h, doc = w.buf[: w.size], w.hashes(), w.doc_of_word()
    out = {"n_words": w.counts}
    out["word_chars"] = _per_doc(((raw & 0xC0) != 0x80) & ~tx.SPACE[raw], w.off)
    out["n_symbols"] = _per_doc(_SYMBOL[raw], w.off)
    out["alnum_chars"] = _per_doc(_ALNUM[raw], w.off)
    # words in three-word windows that occur twice or more in their text
    tri = tx.shingle_hashes(h, 3)
    whole = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    key = tx.mix(tri[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, often = np.unique(key, return_inverse=True, return_counts=True)
    at = at[often[which] > 1]
    covered = np.zeros(len(h), dtype=bool)
    for i in range(3):
        covered[at + i] = True
    out["n_repeat_words"] = _per_doc(covered, w.first)
    # lines with a word, and those of them equal to an earlier line
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    data = memoryview(raw)
    for i, (a, b) in enumerate(zip(w.off[:-1].tolist(), w.off[1:].tolist())):
        worded = [x for x in bytes(data[a:b]).split(b"\n") if x and x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], dup[i] = len(worded), len(worded) - len(set(worded))
    out["n_dup_lines"], out["n_lines"] = dup, lines
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int64)])
    out["n_letter_words"] = _per_doc(letters[w.end] > letters[w.start], w.first)
    order = np.unique(tx.mix(h + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
    out["n_distinct_words"] = np.bincount(doc[order], minlength=len(texts)) if len(order) else np.zeros(len(texts), np.int64)
    return out


@F.arrow_udf(FEATURES)
def _features(text: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text], names=["text"])
    parts = [features_of(p.column("text")) for p in tx.pieces(batch)]
    names = [f.name for f in FEATURES]
    trim()
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names], names=names)


def features(text: Column) -> Column:
    """The features of a text as one struct."""
    return _features(text.cast("string"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules(f: Column) -> list[Column]:
    """The votes, from the features. Bounds are those in common use for web text."""
    n = F.greatest(f["n_words"], F.lit(1))
    lines = F.greatest(f["n_lines"], F.lit(1))
    mean = f["word_chars"] / n
    return [
        _vote(f["n_words"] >= 80, f["n_words"] < 50),
        _vote(f["n_repeat_words"] <= 0.2 * n, f["n_repeat_words"] > 0.4 * n),
        _vote(f["n_symbols"] <= 0.1 * n, f["n_symbols"] > 0.4 * n),
        _vote(f["n_dup_lines"] <= 0.1 * lines, f["n_dup_lines"] > 0.3 * lines),
        _vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        _vote(f["alnum_chars"] >= 0.85 * f["word_chars"], f["alnum_chars"] < 0.75 * f["word_chars"]),
        _vote(f["n_letter_words"] >= 0.8 * n, f["n_letter_words"] < 0.6 * n),
        _vote(f["n_distinct_words"] >= 0.3 * n, f["n_distinct_words"] < F.least(0.15 * n, F.sqrt(112.5 * n))),  # vocabularies grow as a power
    ]


N_RULES = 8


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


#: What each accuracy is worth before any vote is seen, in votes that were right and wrong: rules
#: seldom flag good documents, and of bad ones a rule may catch a few or most. A hundred votes don't
#: hold an accuracy against a corpus; they say which of the two classes is the good one.
PRIOR_GOOD, PRIOR_BAD = (98, 2), (2, 2)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, dict]:
    """Posterior probability of good for each vote pattern, and what was estimated.

    ``patterns`` is (patterns, rules) of votes, ``counts`` how many documents have each. The
    model: a document is good with probability ``prior``; a rule that votes on it is right with
    its own accuracy for good and for bad documents; an abstention says nothing. All of these are
    estimated by expectation-maximisation, from the accuracies that the Beta priors expect.
    """
    v, c = np.asarray(patterns, dtype=np.int64), np.asarray(counts, dtype=np.float64)
    up, down = v == GOOD, v == BAD
    right_good, right_bad = (np.full(v.shape[1], r / (r + w)) for r, w in (PRIOR_GOOD, PRIOR_BAD))
    prior, last = 0.8, -np.inf
    post = np.zeros(len(v))
    for _ in range(rounds):
        lg = np.log(prior) + up @ np.log(right_good) + down @ np.log1p(-right_good)
        lb = np.log1p(-prior) + down @ np.log(right_bad) + up @ np.log1p(-right_bad)
        top = np.maximum(lg, lb)
        total = top + np.log(np.exp(lg - top) + np.exp(lb - top))
        post = np.exp(lg - total)
        g, b = c * post, c * (1 - post)
        prior = (g.sum() + 1) / (c.sum() + 2)
        right_good = (g @ up + PRIOR_GOOD[0]) / (g @ (up | down) + sum(PRIOR_GOOD))
        right_bad = (b @ down + PRIOR_BAD[0]) / (b @ (up | down) + sum(PRIOR_BAD))
        now = float(c @ total)
        if abs(now - last) < tolerance * max(1.0, abs(now)):
            break
        last = now
    return post, {"prior": prior, "right_good": right_good, "right_bad": right_bad}


def _code(votes: list[Column]) -> Column:
    code = F.lit(0)
    for vote in votes:
        code = code * 3 + (vote + 1)
    return code.cast("int")


def judge(docs: DataFrame, feature_col: str, threshold: float = 0.5, into: tuple[str, str] = ("p_good", "kept")) -> DataFrame:
    """Add the posterior probability and the verdict to ``docs`` with their features.

    The base rule rejects whatever the posterior. ``docs`` is read twice: once for the vote
    patterns, once for the result; write features down first where they are dear.
    """
    f = F.col(feature_col)
    code = _code(rules(f))
    seen = docs.select(code.alias("code")).groupBy("code").count().collect()  # at most 3 ** N_RULES rows
    codes = np.array([r[0] for r in seen], dtype=np.int64)
    patterns = np.stack([codes // 3 ** (N_RULES - 1 - i) % 3 - 1 for i in range(N_RULES)], axis=1) if len(codes) else np.zeros((0, N_RULES), np.int64)
    post = fit(patterns, np.array([r[1] for r in seen]))[0] if len(codes) else np.zeros(0)
    c, p = fresh(docs, "_code"), fresh(docs, "_p")
    table = docs.sparkSession.createDataFrame([(int(x), float(y)) for x, y in zip(codes, post)], f"{c} int, {p} double")
    joined = docs.withColumn(c, code).join(F.broadcast(table), c, "left").drop(c)
    return joined.withColumns({into[0]: F.col(p), into[1]: ~base_failed(f) & (F.col(p) >= threshold)}).drop(p)
