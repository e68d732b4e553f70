"""Near copies by Jaccard similarity of five-word shingles.

Documents are compared as sets of runs of ``SHINGLE`` words, A-Z lower-cased; a text of fewer
words is one shingle, one without words (or null) the empty set, and empty sets are equal. Two
documents are linked when their sets' Jaccard similarity is ``SIMILARITY`` or more.

Candidates come from SimHash first: fingerprints of the same shingles that the Golay keys of
``simhash`` link, those within four bits, and those that are equal. Verified, they join near-exact
copies. A pair at the bound differs in about ten bits, beyond what any affordable number of keys finds,
so MinHash adds the candidates further apart that aren't in one group yet: ``BANDS`` keys of ``ROWS`` minima each, so a pair at the bound is
missed with probability (1 - 0.8 ** 4) ** 24, 3 in a million, and a nearer one less often. Each
candidate is verified on the sets themselves. A bucket's documents first meet its smallest one, so a
large group of near copies costs as many pairs as it has documents. Where a bucket's documents are
then still in several groups, the pairs across them are bounded before they are verified: shingles
that no other such document has can't be shared, and of the others, dealt over ``CELLS`` cells by
their hash, two documents share in each cell no more than the fewer that one of them has there. That
rules out what has been edited too far, and nothing else.

Documents with the same words in the same order are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import text as tx
from .components import components
from .ids import fresh, with_key
from .work import keep, lean

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Rows of keys that are broadcast at most, some 40 MB.
MOST = 1 << 19
#: Parts that the documents of one bucket's smallest are dealt over for verification.
PARTS = 8
#: Cells that a document's shingles are counted in.
CELLS = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles in order, the text of each, and a hash of each whole text."""
    w = tx.Words(texts, lower=True)
    h, doc, n = w.hashes(), w.doc_of_word(), w.counts
    place = np.arange(len(h)) - w.first[doc]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(h + place.astype(np.uint64) * _GOLD), dtype=np.uint64)])
    whole = tx.mix(total[w.first[1:]] - total[w.first[:-1]] + n.astype(np.uint64))
    runs = tx.shingle_hashes(h, SHINGLE)
    at = np.flatnonzero(doc[SHINGLE - 1 :] == doc[: len(runs)]) if len(runs) else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    of = np.concatenate([doc[at], few])
    order = np.argsort(of, kind="stable")
    return np.concatenate([runs[at], whole[few]])[order], of[order], whole


def signatures(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, whole, bands) of every document; no bands for one without words."""
    rng = np.random.default_rng(42)
    turn = rng.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
    turn[1] |= np.uint64(1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b):
                h, of, whole = shingles(p.column("text"))
                start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
                bands = np.zeros((len(start), BANDS), dtype=np.uint64)
                for i in range(BANDS * ROWS if len(start) else 0):
                    least = np.minimum.reduceat((h ^ turn[0, i]) * turn[1, i], start)
                    bands[:, i // ROWS] = tx.mix(bands[:, i // ROWS] * _GOLD + least + np.uint64(i // ROWS + 1))
                size = np.zeros(p.num_rows, dtype=np.int32)
                size[of[start]] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([p.column("key"), pa.array(whole.view(np.int64)), lists], names=["key", "whole", "bands"])

    cols = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "key long, whole long, bands array<long>")


def alike(docs: DataFrame, first: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Pairs (a, b), a < b, that connect the documents of ``first`` (key) whose fingerprints are linked."""
    marked = simhash.fingerprints(docs, key, text_col, SHINGLE).join(first.select(F.col("key").alias("doc_id")), "doc_id", "left_semi")
    marked = keep(marked, "near-fp")
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-distinct")
    equal = marked.join(distinct, "fp").filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    of = lambda side, name: distinct.select(F.col("fp").alias(side), F.col("least").alias(name))
    linked = simhash.links(distinct).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return equal.union(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in one group already."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}"))
    grouped = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return grouped.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole buckets, of rows that come in order of their first column."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on in the next batch
        if cut:
            yield tuple(c[:cut] for c in held)
            held = [c[cut:] for c in held]
    if held is not None:
        yield tuple(held)


def meetings(bands: DataFrame) -> DataFrame:
    """(band, least, key) of the documents that share a band; ``least`` is the smallest of them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, key in _buckets(batches):
            edge = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            size = np.diff(np.append(edge, len(band)))
            some = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(band[some]), pa.array(np.repeat(key[edge], size)[some]), pa.array(key[some])], names=["band", "least", "key"])

    return bands.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "band long, least long, key long")


def open_buckets(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, least, key, group) of the buckets whose documents are in several groups."""
    grouped = met.join(roots, met["key"] == roots["node"], "left").select("band", "least", "key", F.coalesce("root", "key").alias("group"))
    several = grouped.groupBy("band").agg((F.min("group") < F.max("group")).alias("several")).filter("several").select(F.col("band").alias("b"))
    return grouped.join(several, F.col("band") == F.col("b"), "left_semi")


def elsewhere(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, size, cells): how many different shingles each document has, and in each cell how many of
    them another document of ``docs`` has too."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b):
                h, of, _ = shingles(p.column("text"))
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                once = np.ones(len(h), dtype=bool)
                once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, of = h[once], of[once]
                cells = np.zeros((p.num_rows, CELLS), dtype="<u4")
                np.add.at(cells, (of, (h % np.uint64(CELLS)).astype(np.int64)), 1)
                # shingles of several documents of the piece are known to be shared; one of them
                # goes on to tell other pieces
                same = np.zeros(len(h) + 1, dtype=bool)
                same[1:-1] = h[1:] == h[:-1]
                known, go = same[:-1] | same[1:], ~same[:-1]
                keys = p.column("key").to_numpy()
                n, m = int(go.sum()), p.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(h[go].view(np.int64)), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([keys[of[go]], keys])),
                        pa.concat_arrays([pa.array(known[go]), pa.nulls(m, pa.bool_())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([c.tobytes() for c in cells], pa.binary())]),
                    ],
                    names=["shingle", "key", "known", "cells"],
                )

    @lean
    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.frombuffer(b"".join(b.column("cells").to_pylist()), dtype="<u4").reshape(-1, CELLS).copy()
            size, own = cells.sum(axis=1, dtype=np.int64), b.column("own")
            row = np.repeat(np.arange(b.num_rows), own.value_lengths().fill_null(0).to_numpy())
            flat = own.flatten()
            np.subtract.at(cells, (row, flat.field("cell").to_numpy()), flat.field("n").to_numpy().astype("<u4"))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size), pa.array([c.tobytes() for c in cells], pa.binary())], names=["key", "size", "cells"])

    cols = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = keep(cols.mapInArrow(run, "shingle long, key long, known boolean, cells binary"), "near-shingles")
    told = rows.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.max("key").alias("key"))
    cell = F.col("shingle").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")
    own = told.filter("n = 1 AND NOT known").groupBy("key", cell).agg(F.count("*").cast("int").alias("n"))
    own = own.groupBy("key").agg(F.collect_list(F.struct("cell", "n")).alias("own"))  # at most one a cell
    sizes = rows.filter("shingle IS NULL").select("key", "cells").join(own, "key", "left")
    return sizes.mapInArrow(less, "key long, size long, cells binary")


def open_pairs(buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's documents that are in different groups and can be similar enough,
    but for those with the bucket's smallest, which have been compared."""
    need = SIMILARITY / (1 + SIMILARITY)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, least, key, group, size, cells in _buckets(batches):
            edge = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(band)).tolist()):
                mine = np.arange(lo, hi)[key[lo:hi] != least[lo:hi]]
                mine = mine[np.argsort(size[mine], kind="stable")]
                k, g, n = key[mine], group[mine], size[mine]
                cell = np.frombuffer(b"".join(cells[mine]), dtype="<u4").reshape(-1, CELLS)
                shared = cell.sum(axis=1, dtype=np.int64)
                # partners of a document are no larger than what it shares allows; the smaller one of
                # a pair looks for the larger
                to = np.searchsorted(n, shared / need - n + 1e-6, side="right")
                for i in np.flatnonzero(to > np.arange(len(k)) + 1).tolist():
                    for at in range(i + 1, int(to[i]), 1 << 14):
                        j = np.arange(at, min(int(to[i]), at + (1 << 14)))
                        least_ = need * (n[j] + n[i]) - 1e-6
                        pick = (g[j] != g[i]) & (shared[j] >= least_)
                        j, least_ = j[pick], least_[pick]
                        j = j[np.minimum(cell[j], cell[i]).sum(axis=1, dtype=np.int64) >= least_]
                        if len(j):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[j])), pa.array(np.maximum(k[i], k[j]))], names=["a", "b"])

    rows = buckets.join(sizes, "key").select("band", "least", "key", "group", "size", "cells")
    return rows.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "a long, b long").distinct()


def _few(rows: DataFrame) -> DataFrame:
    """Rows to join texts with: broadcast if they are at most ``MOST``, so that the texts stay where
    they are; else joined by key."""
    return F.broadcast(rows) if rows.count() <= MOST else rows


def verified(pairs: DataFrame, docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The pairs (a, b), a < b, whose similarity reaches the bound. Each document ``b`` goes to
    where its ``a`` is, so no text is copied for each pair it is the smaller one of."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            for p in tx.pieces(batch):
                h, of, _ = shingles(p.column("text"))
                edge = np.searchsorted(of, np.arange(p.num_rows + 1))
                left, right = [], []
                for i, (a, b) in enumerate(zip(p.column("a").to_pylist(), p.column("b").to_pylist())):
                    own = np.unique(h[edge[i] : edge[i + 1]])
                    if a == b:
                        at, mine = a, own
                        continue
                    assert at == a, "a pair without its first document"
                    if min(len(own), len(mine)) >= SIMILARITY * max(len(own), len(mine)):
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        if both >= SIMILARITY * (len(own) + len(mine) - both):
                            left.append(a)
                            right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = pairs.withColumn("part", F.pmod(F.hash("b"), F.lit(PARTS)))
    texts = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = _few(keep(dealt.union(dealt.select("a", F.col("a").alias("b"), "part").distinct()), "near-pairs"))
    joined = rows.join(texts, rows["b"] == texts["key"]).select("a", "part", "b", "text")
    return joined.repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(run, "a long, b long")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first document of each group of linked ones alone."""
    key = fresh(docs, "_key")
    keyed, repeated = with_key(docs, key, id_col, text_col)
    keyed = keyed.dropDuplicates([key]) if repeated else keyed
    marked = keep(signatures(keyed, key, text_col), "near-signatures")
    first = keep(marked.groupBy("whole").agg(F.min_by(F.struct("key", "bands"), "key").alias("s")).select("s.key", "s.bands"), "near-first")
    met = keep(meetings(first.select(F.explode("bands").alias("band"), "key")), "near-met")
    roots = keep(components(verified(keep(alike(keyed, first, key, text_col), "near-alike"), keyed, key, text_col)), "near-roots")
    stars = met.filter("least <> key").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    links = verified(keep(apart(stars, roots), "near-apart"), keyed, key, text_col)
    roots = keep(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "near-roots")
    buckets = keep(open_buckets(met, roots), "near-open")
    asked = keyed.join(_few(buckets.select(F.col("key").alias(key)).distinct()), key, "left_semi")
    more = keep(verified(open_pairs(buckets, elsewhere(asked, key, text_col)), keyed, key, text_col), "near-links")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    copies = marked.select("key").join(first.select("key"), "key", "left_anti")
    gone = keep(copies.union(roots.select("node")).select(F.col("key").alias(key)), "near-gone")
    return keyed.join(_few(gone), key, "left_anti").select(*docs.columns)
