"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Planning works on the histogram of piece lengths, at most ``capacity`` rows whatever the size of
the corpus: best-fit decreasing places whole runs of equal pieces into whole runs of equal
sequences. Every run becomes one plan row, fewer than four per length. Pieces then take their
slots by a join on their rank within their length.

Defined results: null text is empty and gives the end token alone; a null doc_id and repeated rows
are documents of their own; pieces of one length share sequences in any order; bytes that aren't
UTF-8 are read as U+FFFD; a text of over a megabyte is encoded in parts cut at white space; an empty
table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .work import lean

CAPACITY = 4096
END_ID = 1
PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[ord(c) for c in PUNCTUATION]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, lot long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Ids of texts by a tokenizer whose splits never cross white space.

    Each distinct word goes to the tokenizer once. Its ids are remembered under its
    64-bit hash in an open-addressed table of arrays, at most ``SLOTS`` / 2 words and ``IDS`` ids
    (some 50 MB); when either is full the table starts anew. Ids of a whole piece are then gathered
    with array operations, so a repeated word costs no Python step.

    Words that can't be told apart by what the tokenizer does first are made one: A-Z are
    lower-cased, and ASCII punctuation at the end, after a letter, is a word of its own. Left as they
    stand are words with a special token's first two characters, which it cuts at before anything
    else, and with combining marks, which it composes before it lower-cases.
    """

    SLOTS = 1 << 21
    IDS = 1 << 22
    TOGETHER = 64

    def __init__(self, path: str):
        self.inner = _tokenizer(path)
        added = self.inner.get_added_tokens_decoder()
        special = {t.content: i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)}
        self.heads = {t.content.encode()[:2] for t in added.values()}
        self.bar, self.bar_id = next(iter(special.items()), (None, -1))
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(self.SLOTS, dtype=np.uint64)
        self.at = np.zeros(self.SLOTS, dtype=np.int32)
        self.n = np.zeros(self.SLOTS, dtype=np.int32)
        self.ids = np.zeros(self.IDS, dtype=np.uint32)
        self.words = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or minus one less the free slot where its search ended."""
        mask = np.uint64(self.SLOTS - 1)
        slot = (h & mask).astype(np.int64)
        out = np.empty(len(h), dtype=np.int64)
        left = np.arange(len(h))
        while len(left):
            there = self.key[slot]
            hit, free = there == h[left], there == 0
            out[left[hit]] = slot[hit]
            out[left[free]] = -1 - slot[free]
            more = ~(hit | free)
            left, slot = left[more], (slot[more] + 1) & (self.SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Remember distinct hashes that aren't in the table."""
        while len(h):
            slot = -1 - self._find(h)
            self.key[slot] = h  # of several for one slot the last stands
            won = self.key[slot] == h
            self.at[slot[won]], self.n[slot[won]] = at[won], n[won]
            h, at, n = h[~won], at[~won], n[~won]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them in a row."""
        # of words of letters, and runs of punctuation, many go in one text: each has one token that
        # ends a word, unless its lower case splits, which the count of these tokens shows
        plain = [i for i, w in enumerate(words) if w.isalpha() or not PUNCTUATION.isdisjoint(w) and PUNCTUATION.issuperset(w)]
        parts = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        lists = [e.ids for e in self.inner.encode_batch_fast([" ".join([words[i] for i in p]) for p in parts], add_special_tokens=False)] if parts else []
        ids = np.fromiter(chain.from_iterable(lists), np.uint32)
        edge = np.cumsum([0, *map(len, lists)])
        ends = self.ends[ids]
        told = np.diff(np.concatenate([[0], np.cumsum(ends)])[edge])
        good = (told == [len(p) for p in parts]) & ends[edge[1:] - 1] if parts else np.zeros(0, bool)
        if not good.all():
            ids = ids[np.repeat(good, np.diff(edge))]
            plain = [i for p, ok in zip(parts, good) if ok for i in p]
        sizes = np.zeros(len(words), dtype=np.int32)
        sizes[plain] = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        rest = np.ones(len(words), dtype=bool)
        rest[plain] = False
        rest = np.flatnonzero(rest).tolist()
        lists = list(self._one_by_one([words[i] for i in rest]))
        sizes[rest] = [len(x) for x in lists]
        owner, ids = plain + rest, np.concatenate([ids, np.fromiter(chain.from_iterable(lists), np.uint32)])
        # from the order of encoding to that of the words
        begin = np.zeros(len(words), dtype=np.int64)
        begin[owner] = np.cumsum(sizes[owner]) - sizes[owner]
        to = np.cumsum(sizes, dtype=np.int64) - sizes
        return sizes, ids[np.repeat(begin - to, sizes) + np.arange(len(ids))]

    def _one_by_one(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of any words, parted by a special token: it cuts a text before all else."""
        if self.bar is None:
            yield from (e.ids for e in self.inner.encode_batch_fast(words, add_special_tokens=False))
            return
        for lo in range(0, len(words), self.TOGETHER):
            part = words[lo : lo + self.TOGETHER]
            if any(self.bar in w for w in part):
                yield from (e.ids for e in self.inner.encode_batch_fast(part, add_special_tokens=False))
                continue
            ids, at = self.inner.encode(self.bar.join(part), add_special_tokens=False).ids, 0
            for _ in part[:-1]:
                to = ids.index(self.bar_id, at)
                yield ids[at:to]
                at = to + 1
            yield ids[at:]

    def _words(self, texts: pa.Array) -> tx.Words:
        """The words of the texts, as they go to the tokenizer."""
        w = tx.Words(texts)
        raw, w.buf = w.buf, tx.LOWER[w.buf]
        body = raw[: w.size]
        mark = (body == 0xCC) | (body == 0xCD)
        for head in self.heads:
            mark[:-1] |= (body[:-1] == head[0]) & (body[1:] == head[-1])
        stay = np.zeros(len(w.start), dtype=bool)
        if mark.any():
            stay[np.searchsorted(w.start, np.flatnonzero(mark), side="right") - 1] = True
            for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist()):
                w.buf[a:b] = raw[a:b]
        # where the punctuation at the end begins
        last = np.maximum.accumulate(np.where(PUNCT[body], 0, np.arange(w.size, dtype=np.int32)))
        tail = last[w.end - 1] + 1
        a, b = w.buf[np.maximum(tail - 1, 0)], w.buf[np.maximum(tail - 2, 0)]
        letter = LETTER[a] | (b == 0xC3) & (a >= 0x80) & (a < 0xC0) & (a != 0x97) & (a != 0xB7)
        two = letter & ~stay & (tail > w.start) & (tail < w.end)
        parts = 1 + two
        first = np.concatenate([[0], np.cumsum(parts)])
        start, end = np.repeat(w.start, parts), np.repeat(w.end, parts)
        at = first[1:][two] - 1
        start[at] = end[at - 1] = tail[two]
        w.start, w.end, w.first = start, end, first[w.first]
        return w

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, unsigned 32-bit, an ``END_ID`` after each, and where each begins
        among them (one more entry than texts)."""
        w = self._words(texts)
        h = np.maximum(w.hashes(), np.uint64(1))  # zero marks a free slot
        slot = self._find(h)
        new = np.flatnonzero(slot < 0)
        ids, n, at = self.ids, None, None
        if len(new):
            distinct, where = np.unique(h[new], return_index=True)
            data = w.buf.tobytes()
            sizes, flat = self._encode([data[a:b].decode(errors="replace") for a, b in zip(w.start[new[where]].tolist(), w.end[new[where]].tolist())])
            if self.words + len(distinct) > self.SLOTS // 2 or self.used + len(flat) > self.IDS:
                # the words of this piece are looked up among its own; then the table starts anew
                n, at = np.empty(len(h), np.int32), np.empty(len(h), np.int64)
                old = slot >= 0
                n[old], at[old] = self.n[slot[old]], self.at[slot[old]]
                mine = np.searchsorted(distinct, h[new])
                n[new], at[new] = sizes[mine], (self.used + np.cumsum(sizes) - sizes)[mine]
                ids = np.concatenate([self.ids[: self.used], flat])
                self._clear()
            if len(distinct) <= self.SLOTS // 2 and len(flat) <= self.IDS:
                self.ids[self.used : self.used + len(flat)] = flat
                self._insert(distinct, (self.used + np.cumsum(sizes) - sizes).astype(np.int32), sizes)
                self.words, self.used = self.words + len(distinct), self.used + len(flat)
            if n is None:
                slot[new] = self._find(h[new])
        if n is None:
            n, at = self.n[slot], self.at[slot].astype(np.int64)
        # after each text its end token, which stands behind all ids
        n, at = np.insert(n, w.first[1:], 1), np.insert(at, w.first[1:], len(ids))
        begin = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        out = np.append(ids, np.uint32(END_ID))[np.repeat(at - begin[:-1], n) + np.arange(begin[-1])]
        return out, begin[w.first + np.arange(len(w.first))]


def _parts(text: bytes) -> list[bytes]:
    """A long text in parts cut at white space."""
    out, lo = [], 0
    while len(text) - lo > tx.PIECE_BYTES:
        hi = lo + tx.PIECE_BYTES
        hi = next((i for i in range(hi, len(text)) if tx.SPACE[text[i]]), len(text))
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` tokens of each document, end token included.

    ``lot`` numbers a task's pieces, which tells equal rows apart.
    """
    path = path or tokenizer_path()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, made = WordTokenizer(path), 0
        for b in batches:
            for p in tx.pieces(b):
                texts = p.column("text").cast(pa.binary())
                if p.num_rows == 1 and len(texts[0].as_py() or b"") > tx.PIECE_BYTES:
                    each = [tok.encode(pa.array([part], pa.binary()))[0][:-1] for part in _parts(texts[0].as_py())]
                    ids = np.append(np.concatenate(each), np.uint32(END_ID))
                    begin = np.array([0, len(ids)])
                else:
                    ids, begin = tok.encode(texts)
                size = np.diff(begin)
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                data, lo = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (begin[doc] + start)
                crc = [zlib.crc32(data[i:j]) for i, j in zip(lo.tolist(), (lo + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [p.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(made, made + len(doc)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
                )
                made += len(doc)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_from, n, per_sequence, first_sequence, offset).

    Pieces of ``length`` with rank ``rank_from`` and up, ``n`` of them, go ``per_sequence`` at a
    time into sequences from ``first_sequence`` on, from ``offset`` there.
    """
    rows = []
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of (first sequence, how many)
    free: list[int] = []  # sorted keys of room
    made = 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(free, space)
            room[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], free[at]
            else:
                space = capacity
                first, n = made, -(-left // (capacity // length))
                made += n
            per = space // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, full * per, per, first, capacity - space))
                leave(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer than fill one sequence
                rows.append((length, rank, left, left, first + full, capacity - space))
                leave(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            leave(space, first + full, n - full)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 50_000) -> DataFrame:
    """Put ``sequence_id`` and ``offset`` in place of the pieces' ``lot``. ``pieces`` is read twice:
    write it down first."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    buckets = max(16, -(-sum(histogram.values()) // rows_per_bucket))
    # the rank within a length in two steps: within a bucket, and the rows in buckets before it
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "lot"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_within", within).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    slots = spark.createDataFrame(plan(histogram, capacity), "_length long, _from long, _n long, _per long, _first long, _offset long")
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n"))
    i = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(slots), fits)  # fewer than 4 * capacity plan rows
    return placed.select(*[c for c in pieces.columns if c != "lot"], (F.col("_first") + F.floor(i / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_offset") + i % F.col("_per") * F.col("length")).cast("long").alias("offset"))
