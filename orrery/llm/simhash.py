"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each read as a word of the
perfect (23, 12) Golay code. The fuzzy keys of a segment are the codewords that the words within
one bit of it decode to, one to six of them; segments that differ in at most two bits share one,
since some word lies within one bit of both.

Four differing bits over three segments (pigeonhole): either every segment has at most two, and
some triple of fuzzy keys is shared; or one has three or more, one of the others has none, and
that segment's bits with a fuzzy key of the remaining one are shared. Together about 180 keys of
33 to 36 bits per fingerprint find every link.

Fingerprints are joined on the keys and each pair verified. Inside a bucket only a spanning set
of links is emitted, and a bucket too large to compare goes another exact way: its fingerprints
meet at the words within two bits of them, of which two linked ones share one.

Defined results: null text and text without words have fingerprint zero, linked like any other;
equal fingerprints are linked; a null doc_id never becomes a component's id unless it has no
other; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .ids import fresh, with_key
from .work import keep, lean

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a bucket compared with each other; larger buckets meet at shared words instead.
BUCKET = 512
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the text's shingles, unsigned."""
    from xxhash import xxh64_digest

    w = text.lower().split()  # bytes.lower and bytes.split know ASCII alone
    if not w:
        return 0
    if len(w) < shingle:
        return int.from_bytes(xxh64_digest(b" ".join(w), SEED), "big")
    n = len(w) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = w[at : at + _BLOCK + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        h = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), dtype=np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed long."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column("text").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Decoding of 23-bit words to the 12 message bits of the nearest codeword."""

    GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

    def __init__(self) -> None:
        # the code is perfect: each syndrome belongs to one error of at most three bits
        single = np.zeros(23, dtype=np.int64)
        for i in range(23):
            r = 1 << i
            for j in range(22, 10, -1):
                if r >> j & 1:
                    r ^= self.GENERATOR << (j - 11)
            single[i] = r
        self.single = single
        self.error = np.zeros(2048, dtype=np.int64)
        bits = range(23)
        for i in bits:
            self.error[single[i]] = 1 << i
            for j in range(i):
                self.error[single[i] ^ single[j]] = 1 << i | 1 << j
                for k in range(j):
                    self.error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
        part = np.zeros(1 << 12, dtype=np.int64)  # syndromes of the low 12 and the high 11 bits
        high = np.zeros(1 << 11, dtype=np.int64)
        for i in range(12):
            part[1 << i : 2 << i] = part[: 1 << i] ^ single[i]
        for i in range(11):
            high[1 << i : 2 << i] = high[: 1 << i] ^ single[12 + i]
        self.low, self.high = part, high

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.low[word & 0xFFF] ^ self.high[word >> 12]

    def fuzzy(self, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each word of ``width`` bits, (n, 6), the distinct ones first, and how many are distinct."""
        s = self.syndrome(word)[:, None] ^ np.concatenate([[0], self.single[:width]])[None, :]
        near = word[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]
        keys = (near ^ self.error[s]) >> 11  # the code is systematic in the high 12 bits
        keys.sort(axis=1)
        fresh = np.ones(keys.shape, dtype=bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        n = fresh.sum(axis=1)
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :6]
        return np.take_along_axis(keys, order, axis=1), n


def segments(fp: np.ndarray) -> list[np.ndarray]:
    x = fp.view(np.uint64)
    return [(x >> np.uint64(42)).astype(np.int64), (x >> np.uint64(21) & np.uint64(0x1FFFFF)).astype(np.int64), (x & np.uint64(0x1FFFFF)).astype(np.int64)]


def keys_of(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """The keys of every fingerprint, flat, and the number of the fingerprint of each."""
    seg = segments(fp)
    fuzzy = [code.fuzzy(s, width) for s, width in zip(seg, (22, 21, 21))]
    row = np.arange(len(fp))
    out, who = [], []
    six = np.arange(6)
    have = [six[None, :] < n[:, None] for _, n in fuzzy]
    grid = have[0][:, :, None, None] & have[1][:, None, :, None] & have[2][:, None, None, :]
    key = fuzzy[0][0][:, :, None, None] << 24 | fuzzy[1][0][:, None, :, None] << 12 | fuzzy[2][0][:, None, None, :]
    out.append(key[grid])
    who.append(np.broadcast_to(row[:, None, None, None], grid.shape)[grid])
    kind = 1
    for exact in range(3):
        for other in range(3):
            if exact != other:
                key = np.int64(kind) << 40 | seg[exact][:, None] << 12 | fuzzy[other][0]
                out.append(key[have[other]])
                who.append(np.broadcast_to(row[:, None], have[other].shape)[have[other]])
                kind += 1
    return np.concatenate(out), np.concatenate(who)


def key_rows(distinct: DataFrame) -> DataFrame:
    """(key, fp) for every key of every distinct fingerprint."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            fp = b.column("fp").to_numpy()
            for at in range(0, len(fp), 1024):
                part = fp[at : at + 1024]
                key, who = keys_of(part, code)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[who])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys, enough to connect whatever is linked there.

    The later of two linked entries is left out where the entry last linked to the earlier one
    is linked to it too: that nearer pair has a link or a chain of its own.
    """
    x = fp.view(np.uint64)
    last = np.full(len(fp), -1, dtype=np.int64)
    left, right = [], []
    i = np.arange(len(fp) - 1)
    shift = 1
    while len(i):
        i = i[i + shift < len(fp)]
        i = i[key[i] == key[i + shift]]
        j = i + shift
        near = np.bitwise_count(x[i] ^ x[j]) <= MAX_BITS
        a, b = i[near], j[near]
        known = last[a] >= 0
        known[known] = np.bitwise_count(x[last[a[known]]] ^ x[b[known]]) <= MAX_BITS
        a, b = a[~known], b[~known]
        last[a] = b
        left.append(fp[a])
        right.append(fp[b])
        shift += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def bucket_links(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between fingerprints that share a key; (a, a) for those of a bucket that is
    too large. Buckets are streamed in order of key, never held whole beyond ``bucket`` rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_links(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def self_links(f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(f)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edge, len(key)))
            over = size > bucket
            over[0] |= large is not None and key[0] == large
            mask = np.repeat(over, size)
            large = key[-1] if over[-1] else None
            if mask.any():
                yield self_links(np.unique(fp[mask]))
            hold = 0 if over[-1] else size[-1]  # the last bucket may go on in the next batch
            cut = len(key) - hold
            yield done(key[:cut][~mask[:cut]], fp[:cut][~mask[:cut]])
            key, fp = key[cut:], fp[cut:]
        yield done(key, fp)

    dealt = rows.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def midpoint_links(hot: DataFrame) -> DataFrame:
    """Links between fingerprints of oversize buckets, linear in their number.

    Each goes to all 2081 words within two bits of it. Those that meet at a word are within four
    bits of each other, and any two within four bits meet at some word; a star round the first
    one of each word keeps what is connected.
    """

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        i, j = np.triu_indices(64, 1)
        ball = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
        for b in batches:
            fp = b.column("a").to_numpy()
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                mid = (part.view(np.uint64)[:, None] ^ ball[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part, len(ball)))], names=["mid", "a"])

    @lean
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for b in batches:
            if not b.num_rows:
                continue
            mid, fp = b.column("mid").to_numpy(), b.column("a").to_numpy()
            new = np.concatenate([[mid[0] != at], mid[1:] != mid[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(mid)), -1))
            head = np.where(lead >= 0, fp[lead], first if first is not None else 0)
            at, first = mid[-1], head[-1]
            keep_ = head != fp
            yield pa.RecordBatch.from_arrays([pa.array(head[keep_]), pa.array(fp[keep_])], names=["a", "b"])

    meet = hot.mapInArrow(spread, "mid long, a long").repartition("mid").sortWithinPartitions("mid", "a")
    return meet.mapInArrow(star, "a long, b long")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``MAX_BITS`` of each other."""
    found = keep(bucket_links(key_rows(distinct), bucket).distinct(), "simhash-links")
    hot = found.filter("a = b").select("a").distinct()
    return found.filter("a <> b").union(midpoint_links(hot).distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document; ``component_id`` is the smallest doc_id
    that links reach."""
    marked = keep(fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first document of each group alone."""
    key = fresh(docs, "_key")
    keyed, repeated = with_key(docs, key, id_col, text_col)
    keyed = keyed.dropDuplicates([key]) if repeated else keyed
    found = groups(keyed, key, text_col)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return keyed.join(first, key, "left_semi").select(*docs.columns)
