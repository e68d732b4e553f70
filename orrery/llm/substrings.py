"""Duplicate substrings by relative Lempel-Ziv factors over an index of the whole corpus.

The reference is the corpus itself, in blocks: the texts of a few megabytes that a task reads
together. A block's index has the phrases of ``WINDOW`` words that begin at each of its words, with
the earliest place of each. A document is parsed greedily against its own block's index where it is
read, and against those of all other blocks that hold one of its phrases: their entries meet spread
by hash, and each phrase goes back with its earliest place in the corpus as source. A factor begins
at a word whose phrase has an earlier source and runs on as long as the source's next phrase is the
text's next phrase; it has a source, a place there and a length of ``WINDOW`` words at least. Where a
factor ends, the phrases that straddle its end are looked up as well, and one with a source begins
the next factor there and then, so no duplicate window is lost at a boundary. Words inside factors
are the duplicate spans.

Only phrases that may repeat get to the index. The smallest hash among a window's
``GRAM``-word grams is its anchor; equal windows have equal anchors, and a text has one for about
every seven words. Anchors that occur once in the corpus rule their windows out.

A passage that any number of documents share sends one row per block and phrase, and its anchors
are dealt out evenly.

Defined results: null text has no words; repeated rows (equal doc_id and text) stand at one place
and are no duplicates of each other; rows of one doc_id with other texts go in order of their
text's hash; a null doc_id comes first; equal phrases in one text count from the first on; a very
long text is a block of its own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .ids import with_key
from .work import lean

WINDOW = 20
GRAM = 8
#: Larger pieces match more of their phrases before anything is shuffled.
PIECE_BYTES = 4 << 20
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _pair(left: np.ndarray, right: np.ndarray, by: np.uint64 = _A) -> np.ndarray:
    return tx.mix(left * by + right)


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 4- and 8-word grams."""
    two = _pair(h[:-1], h[1:])
    four = _pair(two[:-2], two[2:])
    return four, _pair(four[:-4], four[4:])


def _least(value: np.ndarray, place: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of each value and the one ``apart`` later, and its place; ties go to the first."""
    left, right = value[:-apart], value[apart:]
    first = left <= right
    return np.where(first, left, right), np.where(first, place[:-apart], place[apart:])


def windows(words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, anchor, the anchor's first place and two hashes of each window inside one text."""
    h = words.hashes()
    n = len(h) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, np.zeros(0, np.int64), none, none
    doc = words.doc_of_word()
    four, eight = _grams(h)
    low, place = eight, np.arange(len(eight))
    for apart in (1, 2, 4, 5):  # over 2, 4, 8 and 13 grams
        low, place = _least(low, place, apart)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    a, b, c = eight[at], eight[at + 8], four[at + 16]
    return at, low[at], place[at], _pair(_pair(a, b), c), _pair(_pair(a, b, _B), c, _B)


def _compress(docs: DataFrame) -> DataFrame:
    """(key, doc_id, packed): the texts under zstd, since they cross the network twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [z.compress(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(packed, pa.binary())], names=["key", "doc_id", "packed"])

    return docs.mapInArrow(run, "key long, doc_id long, packed binary")


def _unpack(column: pa.Array) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(p.as_py()) for p in column]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, text) with keys in the order of documents."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_key(docs, "key")[0].select("key", "doc_id", "text")


#: Of an anchor's two low bits one says that it needs no partner to be known to repeat, the other
#: that its partners repeat too.
_ALONE, _FIRST = np.uint64(1), np.uint64(2)
_FLAGS = _ALONE | _FIRST


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, key) of each anchor of each text. Of those that repeat within the block one is flagged
    as the first, the others as alone."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b, limit=PIECE_BYTES):
                w = tx.Words(p.column("text"))
                at, anchor, place, _, _ = windows(w)
                doc = np.searchsorted(w.first, at, side="right") - 1
                new = np.ones(len(at), dtype=bool)
                new[1:] = place[1:] != place[:-1]
                anchor, doc = anchor[new] & ~_FLAGS, doc[new]
                _, one, which, often = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                flag = np.where(often[which] > 1, _ALONE, np.uint64(0))
                flag[one] = np.where(often > 1, _FIRST, np.uint64(0))
                yield pa.RecordBatch.from_arrays([pa.array((anchor | flag).view(np.int64)), p.column("key").take(pa.array(doc))], names=["anchor", "key"])

    return docs.mapInArrow(run, "anchor long, key long")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(key, anchor) of the anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None  # last row: it may go on
        told = False
        for b in batches:
            if not b.num_rows:
                continue
            marked, key = b.column("anchor").to_numpy().view(np.uint64), b.column("key").to_numpy()
            if held is not None:
                marked, key = (np.concatenate(x) for x in zip(held, (marked, key)))
            anchor = marked & ~_FLAGS
            same = anchor[1:] == anchor[:-1]
            hit = marked != anchor
            hit[1:] |= same
            hit[:-1] |= same
            last_hit = bool(hit[-1])
            if held is not None and told:
                hit[0] = False  # given out with the batch before
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(anchor[hit].view(np.int64))], names=["key", "anchor"])
            held, told = (marked[-1:], key[-1:]), last_hit

    alone = F.col("anchor").bitwiseAND(F.lit(int(_ALONE))) == 1
    deal = F.when(alone, F.xxhash64("anchor", "key")).otherwise(F.shiftright("anchor", 2))
    return anchors.repartition(deal).sortWithinPartitions("anchor").mapInArrow(run, "key long, anchor long")


#: Consecutive windows whose sources are consecutive: first word, how many, source's key and word.
RUN = np.dtype([("start", "<u4"), ("n", "<u4"), ("source", "<i8"), ("at", "<u4")])


def _runs(key: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Windows with their sources as packed runs, one entry per key."""
    order = np.lexsort((at, source, start, key))
    key, start, source, at = key[order], start[order], source[order], at[order]
    once = np.ones(len(key), dtype=bool)
    once[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1])
    key, start, source, at = key[once], start[once], source[once], at[once]
    head = np.ones(len(key), dtype=bool)
    head[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
    edge = np.flatnonzero(head)
    out = np.zeros(len(edge), dtype=RUN)
    out["start"], out["n"], out["source"], out["at"] = start[edge], np.diff(np.append(edge, len(key))), source[edge], at[edge]
    owner = key[edge]
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return owner[cut], [out[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(out)])]


def _phrases(docs: DataFrame) -> DataFrame:
    """(w1, key, at, runs): the index entries of each block, and with a null ``w1`` the parse of its
    documents against it.

    An entry is a phrase whose anchor repeats at its earliest place; ``at`` has 32 more bits of the
    phrase's hash above the number of the window's first word. The other windows have their source
    within the block, and go as packed runs, a row per document.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column("key"), pa.array(_unpack(b.column("packed")), pa.binary()), b.column("anchors")], names=["key", "text", "anchors"])
            for p in tx.pieces(texts, limit=PIECE_BYTES):
                w = tx.Words(p.column("text"))
                at, anchor, _, w1, w2 = windows(w)
                doc = np.searchsorted(w.first, at, side="right") - 1
                lists = p.column("anchors")
                shared = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(p.num_rows), np.diff(lists.offsets.to_numpy()))
                mark = lambda a, d: tx.mix(a + d.astype(np.uint64) * _B)
                pick = np.isin(mark(anchor & ~_FLAGS, doc), mark(shared, owner))
                at, doc, w1, w2 = at[pick], doc[pick], w1[pick], w2[pick]
                key = p.column("key").to_numpy()[doc]
                start = at - w.first[doc]
                order = np.lexsort((start, key, w2, w1))
                s1, s2 = w1[order], w2[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
                # rows at the very place of the earliest one are the earliest one
                lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
                k, s = key[order], start[order]
                earliest = (k == k[lead]) & (s == s[lead])
                packed = (s2 >> np.uint64(32) << np.uint64(32)).view(np.int64) | s
                owners, runs = _runs(k[~earliest], s[~earliest], k[lead][~earliest], s[lead][~earliest])
                n, m = int(earliest.sum()), len(runs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(s1[earliest].view(np.int64)), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([k[earliest], owners])),
                        pa.concat_arrays([pa.array(packed[earliest]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(runs, pa.binary())]),
                    ],
                    names=["w1", "key", "at", "runs"],
                )

    return docs.mapInArrow(run, "w1 long, key long, at long, runs binary")


def _sources(phrases: DataFrame) -> DataFrame:
    """(key, place, source, runs): the windows whose phrase starts earlier somewhere, one a row, with
    their own first word above the source's in ``place``; and the runs as they came."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # the earliest place of the phrase that the last batch ended in
        names = ["key", "place", "source", "runs"]
        for b in batches:
            if not b.num_rows:
                continue
            known = b.column("w1").is_null().to_numpy(zero_copy_only=False)
            if known.any():
                key, runs = (b.column(c).filter(pa.array(known)) for c in ("key", "runs"))
                yield pa.RecordBatch.from_arrays([key, pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64()), runs], names=names)
            if known.all():
                continue
            w1, key, at = (b.column(c).filter(pa.array(~known)).to_numpy() for c in ("w1", "key", "at"))
            here = np.stack([w1, at >> 32, key, at & 0xFFFFFFFF], axis=1)
            if lead is not None:
                here = np.concatenate([lead[None, :], here])
            new = np.ones(len(here), dtype=bool)
            new[1:] = (here[1:, :2] != here[:-1, :2]).any(axis=1)
            first = here[np.maximum.accumulate(np.where(new, np.arange(len(here)), 0))]
            later = (here[:, 2:] != first[:, 2:]).any(axis=1)
            lead = first[-1]
            key, start, source, at = here[later, 2], here[later, 3], first[later, 2], first[later, 3]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start << 32 | at), pa.array(source), pa.nulls(len(key), pa.binary())], names=names)

    # parsed runs need no partner: they are dealt by their document
    deal = F.coalesce("w1", F.xxhash64("key", "runs"))
    sort = [F.asc_nulls_first("w1"), F.shiftright("at", 32), F.col("key"), F.col("at")]
    return phrases.repartition(deal).sortWithinPartitions(*sort).mapInArrow(run, "key long, place long, source long, runs binary")


def run_table(row_runs: list[bytes] | None, places: pa.Array | None) -> np.ndarray:
    """What ``sources`` has for a document, as runs (``RUN``)."""
    own = np.frombuffer(b"".join(row_runs or ()), dtype=RUN)
    if places is None or not len(places):
        return own
    place, source = (places.field(c).to_numpy() for c in ("place", "source"))
    out = np.zeros(len(place), dtype=RUN)
    out["start"], out["n"], out["source"], out["at"] = place >> 32, 1, source, place & 0xFFFFFFFF
    return np.concatenate([own, out])


def factors(runs: np.ndarray) -> np.ndarray:
    """The factors of a document, as runs of windows (``RUN``): each begins at the first word that has
    a source and isn't in the factor before, or straddles its end, and goes on while the source does."""
    n = runs["n"].astype(np.int64)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    part = np.repeat(runs, n)
    start, at = part["start"] + step, part["at"] + step
    _, packed = _runs(np.zeros(len(part), np.int64), start, part["source"], at)
    return np.frombuffer(b"".join(packed), dtype=RUN)


def spans(found: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges that factors cover; ranges that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in zip(found["start"].tolist(), (found["start"].astype(np.int64) + found["n"] + WINDOW - 1).tolist()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def sources(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(key, runs, places): the windows of a document that start earlier somewhere, with where.

    ``docs`` has (key, doc_id, text), ``packed`` the same compressed.
    """
    repeated = _repeated(_anchors(docs)).groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    candidates = packed.join(repeated, "key").select("key", "doc_id", "packed", "anchors")
    return _sources(_phrases(candidates)).groupBy("key").agg(F.collect_list("runs").alias("runs"), F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "source"))).alias("places"))


FACTORS = "array<struct<start:long,length:long,source:long,source_start:long>>"


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, its factors, the spans (word ranges) and the
    text left, its words joined by one space. A factor's source is a doc_id, or where doc_ids repeat
    or lack the number of the source in the order of documents."""
    docs = keyed(docs, id_col, text_col)
    # one DataFrame for both joins, with the columns and the filter of either: Spark then shuffles
    # the texts once
    packed = _compress(docs).filter("key IS NOT NULL")
    found = sources(docs, packed)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        factor = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "source", "source_start")]))
        for b in batches:
            left, counts, removed, cut, copied = [], [], [], [], []
            for t, runs, places in zip(_unpack(b.column("packed")), b.column("runs"), b.column("places")):
                w = t.split()
                mine = factors(run_table(runs.as_py(), places.values))
                ranges = spans(mine)
                out, at = [], 0
                for lo, hi in ranges:
                    out += w[at:lo]
                    at = hi
                out += w[at:]
                left.append(b" ".join(out).decode(errors="replace"))
                counts.append(len(w))
                removed.append(len(w) - len(out))
                cut.append([{"start": lo, "end": hi} for lo, hi in ranges])
                copied.append([{"start": s, "length": n + WINDOW - 1, "source": k, "source_start": a} for s, n, k, a in mine.tolist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(copied, factor), pa.array(cut, span), pa.array(left, pa.string())],
                names=["doc_id", "n_words", "n_removed", "factors", "spans", "kept_text"],
            )

    joined = packed.join(found, "key", "left").select("key", "doc_id", "packed", "runs", "places")
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, factors {FACTORS}, spans array<struct<start:long,end:long>>, kept_text string")
