"""Phrase collocations from suffix arrays of word ids.

Texts, A-Z lower-cased, are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at
spaces and tabs. All counts are per language. A phrase of 2 to 4 words that occurs ``LEAST`` times or
more is a candidate; cut after its first k words into parts that occur l and r times, it scores
floor(2,000,000 a / (l + r)) for its own count a, by the lowest-scoring cut. A candidate that stands
inside a longer one that has ``SHARE`` hundredths of its count or more is dropped.

Each task numbers the words of a shard, sorts the shard's suffixes by prefix doubling (by one word,
by two, by more) and reads the phrases off the runs of the array whose common prefix is long enough:
a phrase and its count a run. Counts are merged by key over all shards. That takes four passes, so
that only phrases that can be frequent are merged: of words, of pairs of frequent words, of triples of
frequent pairs, and of all phrases whose parts are frequent. Passes tell each other what is frequent
by bitmaps of hashes of fixed size. These let some rare phrases by, never hold back a frequent one,
and the last pass counts the phrases themselves: neither size nor hash decides a result. On a corpus
with far more frequent phrases than a bitmap has bits, more rows are merged.

Keys of pairs and triples have four bits more than the corpus' words need and go packed, a row a
shard and slice of the keys: sorted, as differences. Slices are so many that one has ``SLICE_KEYS`` keys of words
at most; rows are shards times slices, and no more than keys.

Defined results: null and empty texts have no words, a null language is ``und``; of invalid UTF-8 in
words each bad byte reads as U+FFFD; repeated rows count each; words of a shard are told apart by
64-bit hashes; a very long text makes its shard longer; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .work import keep, lean

MOST_WORDS = 4
LEAST = 30
SHARE = 80
TOP = 2000
#: Words of a shard, but for a longer text.
SHARD = 1 << 20
#: Keys of one slice, at most, and slices at least; both powers of two.
SLICE_KEYS, SLICES = 1 << 22, 1 << 6
#: Bits of a bitmap of frequent keys, a power of two.
FILTER_BITS = 1 << 26
#: Rows that are broadcast at most.
FEW = 1 << 18
#: Parts that a language is dealt over before its best phrases are ranked.
PARTS = 64
CUTS = np.zeros(256, dtype=bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def lcp_intervals(ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, starts, counts) for m from 1 to ``most`` (at most 4): where each different run of m ids first
    stands in the suffix array of ``ids``, as a place in ``ids``, and how often it occurs. Runs hold
    no 0.

    The array is of suffixes by their first ``most`` ids; doubling the sorted length, a suffix's rank
    is that of its first half's rank and the rank where the second half begins.
    """
    there = np.flatnonzero(ids)
    rank, length = {1: ids.astype(np.int64)}, 1
    after = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, len(r)), r.dtype)])
    order = np.argsort(rank[1][there], kind="stable") if most == 1 else None
    while length < most:
        longer = min(2 * length, most)
        pair = rank[length][there] * (int(rank[length].max(initial=0)) + 1) + after(rank[length], longer - length)[there]
        order = np.argsort(pair, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank[longer] = np.zeros(len(ids), np.int64)
        rank[longer][there[order]] = np.cumsum(new)
        length = longer
    array = there[order]
    equal = lambda r: r[array[1:]] == r[array[:-1]]
    common = np.zeros(len(array), dtype=np.int8)  # of each suffix and the one before
    whole = np.ones(len(array), dtype=bool)
    for m in range(1, most + 1):
        whole &= after(ids, m - 1)[array] > 0
        if len(array):
            half = max(n for n in rank if n <= m)
            common[1:] += (common[1:] == m - 1) & equal(rank[half]) & (equal(after(rank[1], m - 1)) if m > half else True)
        edge = np.flatnonzero(common < m)
        size = np.diff(np.append(edge, len(array)))
        yield m, array[edge[whole[edge]]], size[whole[edge]]


class Shard:
    """Hashes of the words of some texts, with a 0 between pieces and in place of words and between
    pairs that can't be frequent; names of the words if asked for, and all words counted by language."""

    def __init__(self, frequent: np.ndarray | None, pairs: np.ndarray | None, named: bool):
        self.frequent, self.pairs, self.named = frequent, pairs, named
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.names: dict[int, tuple[str, str]] = {}
        self.n: Counter[str] = Counter()
        self.size = 0

    def add(self, piece: pa.RecordBatch) -> None:
        w = tx.Words(piece.column("text"), lower=True, blank=CUTS)
        langs = piece.column("lang").cast(pa.binary()).dictionary_encode()
        lang = langs.indices.to_numpy()
        known = [x.decode("utf-8", "replace") for x in langs.dictionary.to_pylist()]
        for c, n in enumerate(np.bincount(lang, w.counts, minlength=len(known)).astype(np.int64).tolist()):
            self.n[known[c]] += n
        of = w.doc_of_word()
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in known], dtype=np.uint64)
        h = tx.mix(w.hashes() ^ seed[lang][of]) | np.uint64(1)
        cuts = np.concatenate([[0], np.cumsum(CUTS[w.buf[: w.size]])])
        new = np.ones(len(h), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (cuts[w.start[1:]] != cuts[w.end[:-1]])
        if self.frequent is not None:
            h[~among(self.frequent, h)] = 0
        if self.pairs is not None and len(h):
            new[1:] |= ~among(self.pairs, pair_keys(h[:-1], h[1:]))
        if self.named:
            for x, i in zip(*(c.tolist() for c in np.unique(h, return_index=True))):
                if x and x not in self.names:
                    self.names[x] = known[lang[of[i]]], w.buf[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace")
        at = np.arange(len(h)) + np.cumsum(new)
        spaced = np.zeros(len(h) + int(new.sum()), np.uint64)
        spaced[at] = h
        self.parts.append(spaced)
        self.size += len(h)

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The different hashes, 0 first, and the sequence as numbers of these."""
        flat = np.concatenate([np.zeros(1, np.uint64), *self.parts])
        return np.unique(flat, return_inverse=True)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tx.mix(a * tx.TIMES + b)


def among(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys can be among those that the bitmap was made of."""
    bit = keys >> np.uint64(64 - (len(bitmap) * 64 - 1).bit_length())
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(parts: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap from its words (at, mask), at most ``bits`` / 64 rows."""
    part = parts.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[part.column("at").to_numpy()] = part.column("mask").to_numpy().view(np.uint64)
    return out


def masks(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(at, mask) of a bitmap with a bit set for the leading bits of each key (long)."""
    bit = keys.select(F.shiftrightunsigned("key", 64 - (bits - 1).bit_length()).alias("bit"))
    return bit.select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("mask"))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def _shards(batches: Iterator[pa.RecordBatch], shard: Shard, size: int) -> Iterator[Shard]:
    for b in batches:
        for p in tx.pieces(b):
            shard.add(p)
            if shard.size >= size:
                yield shard
                shard.clear()
    if shard.size:
        yield shard


def frequent_words(texts: DataFrame, least: int, size: int = SHARD) -> tuple[np.ndarray, int]:
    """A bitmap of the words that occur ``least`` times or more, and how many words there are in all."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, Shard(None, None, False), size):
            hashes, ids = shard.numbered()
            for _, at, count in lcp_intervals(ids, 1):
                key = pa.array(np.append(hashes[ids[at]].view(np.int64), 0), mask=np.append(np.zeros(len(at), bool), True))
                yield pa.RecordBatch.from_arrays([key, pa.array(np.append(count, shard.size))], names=["key", "n"])

    counted = keep(texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("key").isNull()), "frequent-words")
    total = counted.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
    return bitmap(masks(counted.filter("key IS NOT NULL"))), total


def run_keys(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Keys of the runs of m words at the places ``at``."""
    key = hashes[ids[at]]
    for i in range(1, m):
        key = pair_keys(key, hashes[ids[at + i]])
    return key


def packed(keys: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, all lowest bytes first, then all next ones."""
    return np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


def frequent_runs(texts: DataFrame, m: int, least: int, filters: tuple[np.ndarray | None, np.ndarray | None], total: int, size: int = SHARD, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the runs of m words that may occur ``least`` times or more, of a corpus of ``total`` words."""
    slice_bits = max(SLICES.bit_length() - 1, (total // SLICE_KEYS).bit_length())
    key_bits = max(total.bit_length() + 4, (bits - 1).bit_length())  # less than 32 more than those of slices
    low, most = key_bits - slice_bits, min(least, 2**31)
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, Shard(*shared.value, False), size):
            hashes, ids = shard.numbered()
            for n, at, count in lcp_intervals(ids, m):
                if n == m:
                    key = (run_keys(hashes, ids, at, m) >> np.uint64(64 - key_bits)).astype(np.int64)
                    order = np.argsort(key, kind="stable")
                    key, count = key[order], np.minimum(count[order], most).astype("<u1" if least < 256 else "<u4")
                    part = key >> low
                    edge = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(edge[1:], len(part)).tolist()
                    pack = [(packed(key[i:j] & ((1 << low) - 1)), count[i:j].tobytes()) for i, j in zip(edge.tolist(), ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array([k for k, _ in pack], pa.binary()), pa.array([c for _, c in pack], pa.binary())], names=["slice", "keys", "counts"])

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def done() -> pa.RecordBatch:
            k, c = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
            order = np.argsort(k, kind="stable")
            edge = np.flatnonzero(np.diff(k[order], prepend=-1))
            often = k[order][edge][np.add.reduceat(c[order], edge) >= least] if len(edge) else k
            bit = ((now << low) + often) >> (key_bits - (bits - 1).bit_length()) if len(often) else often
            at, mask = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
            head = np.flatnonzero(np.diff(at, prepend=-1))
            mask = np.bitwise_or.reduceat(mask, head) if len(head) else mask
            return pa.RecordBatch.from_arrays([pa.array(at[head]), pa.array(mask.view(np.int64))], names=["at", "mask"])

        for b in batches:
            for s, k, c in zip(*(x.to_pylist() for x in b.columns)):
                if s != now and now is not None:
                    yield done()
                    keys, counts = [], []
                now = s
                keys.append(unpacked(k))
                counts.append(np.frombuffer(c, "<u1" if least < 256 else "<u4").astype(np.int64))
        if now is not None:
            yield done()

    rows = texts.mapInArrow(run, "slice int, keys binary, counts binary").repartition("slice").sortWithinPartitions("slice")
    return bitmap(rows.mapInArrow(merge, "at long, mask long"), bits)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST, size: int = SHARD) -> DataFrame:
    """(lang, phrase, words, n) of every phrase of up to ``most`` words that occurs ``least`` times or
    more, and of each language a row with no phrase for all its words."""
    texts = _texts(docs, text_col, lang_col)
    words, total = frequent_words(texts, least, size)
    pairs = frequent_runs(texts, 2, least, (words, None), total, size)
    triples = frequent_runs(texts, 3, least, (words, pairs), total, size)
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs, triples))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, triples = shared.value
        for shard in _shards(batches, Shard(words, pairs, True), size):
            n = shard.n
            yield _rows(list(n), pa.nulls(len(n), pa.string()), 0, np.fromiter(n.values(), np.int64, len(n)))
            hashes, ids = shard.numbered()
            named = [("", ""), *(shard.names[x] for x in hashes[1:].tolist())]
            lang, name = pa.array([x for x, _ in named]), pa.array([x for _, x in named], pa.string())
            for m, at, count in lcp_intervals(ids, most):
                able = np.ones(len(at), dtype=bool)
                for i in range(m - 2):
                    able &= among(triples, run_keys(hashes, ids, at + i, 3))
                at, count = at[able], count[able]
                columns = [name.take(pa.array(ids[at + i])) for i in range(m)]
                yield _rows(lang.take(pa.array(ids[at])), columns[0] if m == 1 else pc.binary_join_element_wise(*columns, " "), m, count)

    rows = texts.mapInArrow(run, "lang string, phrase string, words int, n long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


def _rows(lang: list | pa.Array, phrase: pa.Array, words: int, n: np.ndarray) -> pa.RecordBatch:
    lang = lang if isinstance(lang, pa.Array) else pa.array(lang, pa.string())
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(n), words, np.int32)), pa.array(n)], names=["lang", "phrase", "words", "n"])


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted rows are few; else joined by key, skewed keys split at run time."""
    return F.broadcast(df) if rows <= FEW else df


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counted: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one stands for, from the table
    of ``phrases``."""
    many = counted.count()
    known = counted.filter("phrase IS NOT NULL")
    grams = known.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    # the largest count of a longer candidate round each phrase
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = grams.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = grams.join(_few(inside, many), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(38,0)") * F.col("longer") < F.lit(share).cast("decimal(38,0)") * F.col("a")))
    cut = left.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.col("words")).alias("rest"))
    of = lambda part, count: _few(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)), many)
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(10,0)) * a div (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def best(found: DataFrame, counted: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    first = found.select("*", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = counted.filter("phrase IS NULL").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, size: int = SHARD) -> DataFrame:
    """Each language's best phrases."""
    counted = keep(phrases(docs, text_col, lang_col, least=least, size=size), "phrases")
    return best(scored(counted, share), counted, top)
