"""Spelling variants by anagram hashing.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``LENGTH`` letters
or more that occur ``LEAST`` times or more. Two are near when one inserted, deleted or replaced
letter turns one into the other. A word's form is its near word of largest count, of equal ones the
first in code-point order, if that count is ``TIMES`` its own or more; its root is where forms lead.

A word's anagram key is the sum of its letters' values, each the fifth power of the letter's code.
One letter more or less changes the key by that letter's value, an exchange by the difference of
two: so words that are near meet where either's key, as it is or less the value of one of its
letters, is the same. What meets there are anagrams of the same letters; of those the letters'
order is verified, by a hash of the letters left with their places. Rows are dealt by key and order,
so that a group holds the words that are one string less a letter each: at most one of them a place
and letter, whatever share of the words are anagrams of each other. A group is reduced to counts and
its best words; pairs are never written out.

Defined results: null and empty texts have no words; a null doc_id is read as the empty string;
repeated rows count each; a run of any length costs rows of a fixed size in proportion to it; an
empty table gives an empty result; other columns don't matter. Sums are taken modulo 2^64 and orders
compared by 64-bit hashes, so both would have to agree for a false link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .work import keep, lean

LENGTH = 7
LEAST = 2
TIMES = 10
POWER = 5
#: Letters of words that a task handles at a time.
LETTERS = 1 << 18
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-z\\u00C0-\\u00FF]"
ROWS = "meet long, order long, place int, id long, n long"
FOUND = "id long, near long, best_n long, best long"


def slips(run: Column, doc_id: Column, one_in: int = 31) -> Column:
    """The run, in one of ``one_in`` cases without one of its letters: planted misspellings, the same
    ones for the same document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the table; with ``slip``, of its runs after ``slips`` of one in so many."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{RUN}{{{length},}}"), F.lit(0))
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run"))
    word = F.translate("run", UPPER, UPPER.lower())
    each = each.select(slips(word, F.col("doc_id"), slip).alias("word")) if slip else each.select(word.alias("word"))
    return each.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def numbered(counted: DataFrame) -> DataFrame:
    """(id, word, n), ids ascending in code-point order of the words; written down, so they stay."""
    return keep(counted.select("word", "n").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "variant-words")


_VALUE = np.arange(256, dtype=np.uint64) ** np.uint64(POWER)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


def meetings(word: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(meet, order, place, number of the word) of each word as it is, place -1, and less each of its
    letters. Letters after the one taken out move up by a place."""
    letter = np.frombuffer(b"".join(w.encode("latin-1") for w in word.to_pylist()), dtype=np.uint8)
    size = pc.utf8_length(word).to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letter)) - first[of]
    placed = lambda p: tx.mix(letter.astype(np.uint64) * tx.TIMES + p.astype(np.uint64))
    value, here, up = _sums(_VALUE[letter]), _sums(placed(place)), _sums(placed(place - 1))
    lo, hi, i = first[of], first[of + 1], np.arange(len(letter))
    key, whole = value[first[1:]] - value[first[:-1]], here[first[1:]] - here[first[:-1]]
    less = (here[i] - here[lo]) + (up[hi] - up[i + 1])
    return (
        np.concatenate([key, key[of] - _VALUE[letter]]), np.concatenate([whole, less]),
        np.concatenate([np.full(len(size), -1), place]), np.concatenate([np.arange(len(size)), of]),
    )


def meeting_rows(numbers: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b, "word", LETTERS):
                meet, order, place, at = meetings(p.column("word"))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(meet.view(np.int64)), pa.array(order.view(np.int64)), pa.array(place.astype(np.int32)), p.column("id").take(at), p.column("n").take(at)], names=["meet", "order", "place", "id", "n"])

    return numbers.select("id", "word", "n").mapInArrow(run, ROWS)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _group_results(meet: np.ndarray, order: np.ndarray, place: np.ndarray, id_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, near, best_n, best) of the words of whole groups, rows in order of meet, order, place,
    count descending and id. Words of one group and place differ by a replaced letter; the word that
    is the group's string (place -1) differs from all others by an inserted one."""
    out = []
    # replaced: the first of a place is the best of all others, the second its own best
    new = _starts(meet, order, place)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(meet)))
    some = np.repeat((size > 1) & (place[head] >= 0), size)
    best = np.repeat(head, size)
    best[head[size > 1]] += 1
    out.append((id_[some], np.repeat(size - 1, size)[some], n[best[some]], id_[best[some]]))
    # inserted: places of one word count once
    group = np.cumsum(_starts(meet, order)) - 1
    by = np.lexsort((id_, -n, place >= 0, group))
    g, short = group[by], place[by] < 0
    again = np.zeros(len(by), dtype=bool)
    again[1:] = (g[1:] == g[:-1]) & (id_[by][1:] == id_[by][:-1]) & ~short[1:] & ~short[:-1]
    by, g, short = by[~again], g[~again], short[~again]
    lead = np.flatnonzero(short)
    if len(lead):
        count = np.searchsorted(g, g[lead], side="right") - np.searchsorted(g, g[lead]) - 1
        lead, count = lead[count > 0], count[count > 0]
        out.append((id_[by[lead]], count, n[by[lead + 1]], id_[by[lead + 1]]))
        longer = np.repeat(lead, count) + 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        base = by[np.repeat(lead, count)]
        out.append((id_[by[longer]], np.ones(len(longer), np.int64), n[base], id_[base]))
    return tuple(np.concatenate(c) for c in zip(*out))


def near_words(numbers: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of the words that have near words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(c: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _group_results(*c)], names=["id", "near", "best_n", "best"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            edge = np.flatnonzero(_starts(held[0], held[1]))[-1]  # the last group may go on
            if edge:
                yield done([c[:edge] for c in held])
                held = [c[edge:] for c in held]
        if held is not None:
            yield done(held)

    dealt = meeting_rows(numbers).repartition("meet", "order").sortWithinPartitions("meet", "order", "place", F.desc("n"), "id")
    each = dealt.mapInArrow(run, FOUND)
    best = F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("b")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", "b.best_n", (-F.col("b.best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for the words of ``forms`` (id, form): where forms lead at last. Ways double in
    length a round; a form has ``TIMES`` its word's count, so ways are short and have no circles."""
    far = keep(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:
        on = far.select(F.col("id").alias("at"), F.col("root").alias("to"))
        moved = far.join(on, far["root"] == on["at"], "left").select("id", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        moved = keep(moved, "variant-roots")
        if not moved.filter("moved").limit(1).count():
            return moved.select("id", "root")
        far = moved.select("id", "root")


def variants(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counted`` (word, n)."""
    numbers = numbered(counted)
    near = keep(near_words(numbers), "variant-near")
    judged = numbers.join(near, "id", "left").withColumn("has", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    judged = keep(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "variant-forms")
    led = roots(judged.filter("form IS NOT NULL"))
    name = lambda a: judged.select(F.col("id").alias(f"{a}_id"), F.col("word").alias(f"{a}_word"))
    formed = judged.filter("form IS NOT NULL").join(led, "id")
    formed = formed.join(name("f"), F.col("form") == F.col("f_id")).join(name("r"), F.col("root") == F.col("r_id"))
    formed = formed.select("word", F.col("f_word").alias("form"), F.col("r_word").alias("root"), "n", "n_near", "form_n")
    alone = judged.filter("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return formed.unionByName(alone)
