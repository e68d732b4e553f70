"""N-gram Jaccard join by parity sketches.

Documents are compared as sets of different runs of ``SHINGLE`` words, A-Z lower-cased; a text of
fewer words is one run, one without words (or null) the empty set, which is linked with nothing. Two
documents are linked where 100 times their sets' intersection is ``PERCENT`` times their union or
more. ``join`` connects all linked documents.

A sketch is a row of 64-bit cells. Each shingle of a set flips one bit of one cell, so the bits in
which two sketches differ are no more than the shingles that the sets don't share, and neither are
the cells. Sizes are cut into bands; where the smaller of two linked sets is in a band, the larger is
there or in the next, and they differ in at most ``differences`` shingles. Sketches of that many cells and one
more have an equal cell (pigeonhole). So a document has a sketch for its own band, and one for the
band before, to meet smaller ones; documents meet where place and content of a cell agree.

Equal sets are one from the start. The documents that meet at a cell are ordered by key and dealt in
that order, so that a cell that very many share spreads over tasks; each is first compared with the
first one there, which joins a group of near copies at the cost of a comparison each. Where several
components meet at a cell even so, all its documents are compared across components. In a cell over
``SMALL`` the documents that can't be linked with anything there leave first: those with more shingles
that no other such document has than a link allows. The others are compared block with block, and no
task holds more than two blocks of ``BLOCK``. Every pair is first compared by briefs and, where these
are near enough, verified on the sets. A brief is the same kind of sketch with a bit or two a shingle in
place of seven, and one for all bands: as many bits as the next power of two, so that the larger of two is
folded to the length of the smaller. Pairs that met by chance cost its few bytes, not those of the cells.

Defined results: rows without an id are documents with ids of null, never the id of a component that
has another; repeated rows and repeated ids are documents of their own; a very long text is one long
row of cells; an empty table gives an empty result; other columns don't matter. Words and shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .ids import fresh, with_key
from .work import keep, lean

SHINGLE = 3
PERCENT = 90
#: Documents of a cell that a task compares with as many others.
BLOCK = 512
#: Documents of a cell whose pairs are written out.
SMALL = 32
#: Rows that are broadcast at most.
FEW = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
SKETCHED = "key long, whole long, n long, band int, own array<long>, before array<long>, brief array<long>"


def differences(smaller: int, percent: int = PERCENT) -> int:
    """The most shingles that linked sets don't share, the smaller one's size given."""
    return 100 * smaller // percent * (100 - percent) // 100


def bands(size: int, percent: int = PERCENT) -> np.ndarray:
    """The largest size of each band up to the one that holds ``size``. Bands begin where linked sets
    can differ; a set's larger partner is in its band or the next."""
    low = next(s for s in range(1, 1000) if differences(s, percent))
    high = [low - 1]
    while high[-1] < size:
        high.append(max(high[-1] + 1, 100 * (high[-1] + 1) // percent))
    return np.array(high, dtype=np.int64)


class Sets:
    """The shingle sets of a piece of texts: ``h`` the different hashes of each text in order, ``of``
    the text of each, ``size`` how many each has, ``whole`` a hash of each set."""

    def __init__(self, texts: pa.Array, shingle: int = SHINGLE):
        w = tx.Words(texts, lower=True)
        words, doc, n = w.hashes(), w.doc_of_word(), w.counts
        runs = tx.shingle_hashes(words, shingle)
        at = np.flatnonzero(doc[shingle - 1 :] == doc[: len(runs)]) if len(runs) else np.zeros(0, np.int64)
        few = np.flatnonzero((n > 0) & (n < shingle))
        short = []
        for i in few.tolist():
            h = words[w.first[i] : w.first[i + 1]]
            short.append(int(tx.shingle_hashes(h, len(h))[0]) ^ len(h))
        h, of = np.concatenate([runs[at], np.array(short, dtype=np.uint64)]), np.concatenate([doc[at], few])
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.h, self.of = h[new], of[new]
        self.size = np.bincount(self.of, minlength=len(n)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(self.h + _GOLD), dtype=np.uint64)])
        self.whole = tx.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64))

    def sketch(self, cells: np.ndarray) -> np.ndarray:
        """Cells of all texts one after another, ``cells[i]`` of text i (0: none)."""
        start = np.concatenate([[0], np.cumsum(cells)])
        there = cells[self.of] > 0
        h, of = self.h[there], self.of[there]
        out = np.zeros(start[-1], dtype=np.uint64)
        cell = start[of] + ((h >> np.uint64(6)) % cells[of].astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(out, cell, np.uint64(1) << (h & np.uint64(63)))
        return out

    def briefs(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts' briefs one after another, and how many each has: a power of two."""
        words = brief_words(self.size)
        start = np.concatenate([[0], np.cumsum(words)])
        out = np.zeros(start[-1], dtype=np.uint64)
        h = tx.mix(self.h)
        word = start[self.of] + ((h >> np.uint64(6)) & (words[self.of] - 1).astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(out, word, np.uint64(1) << (h & np.uint64(63)))
        return out, words


def brief_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the briefs of sets of these sizes: a bit a shingle at least."""
    return 1 << np.ceil(np.log2(np.maximum(-(-np.asarray(size) // 64), 1))).astype(np.int64)


def folded(brief: np.ndarray, words: int) -> np.ndarray:
    """A brief (or a row of each) in ``words`` words: its parts over each other."""
    return np.bitwise_xor.reduce(brief.reshape(*brief.shape[:-1], -1, words), axis=-2)


def sketches(docs: DataFrame, key: str, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, whole, n, band, own, before, brief) of every document: its set's hash, size and band, its
    sketches for that band and the one before, and its brief. Band 0 is of sets that are linked with equal
    ones alone."""

    def lists(cells: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cells)]).astype(np.int32)), pa.array(values.view(np.int64)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b):
                s = Sets(p.column("text"), shingle)
                high = bands(int(s.size.max(initial=1)), percent)
                cells = np.array([0, *(differences(int(x), percent) + 1 for x in high[1:])])
                band = np.searchsorted(high, s.size)
                own, before = cells[band], cells[np.maximum(band - 1, 0)]
                brief, words = s.briefs()
                yield pa.RecordBatch.from_arrays(
                    [p.column("key"), pa.array(s.whole.view(np.int64)), pa.array(s.size), pa.array(band.astype(np.int32)), lists(own, s.sketch(own)), lists(before, s.sketch(before)), lists(words, brief)],
                    names=["key", "whole", "n", "band", "own", "before", "brief"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCHED)


def cells(sketched: DataFrame) -> DataFrame:
    """(cell, key, n): a row a cell of each document's sketches, cells as hashes of band, place and content."""
    each = lambda lower, words: sketched.select("key", "n", (F.col("band") - lower).alias("band"), F.posexplode(words).alias("at", "bits"))
    return each(0, "own").union(each(1, "before")).select(F.xxhash64("band", "at", "bits").alias("cell"), "key", "n")


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Columns of whole runs of rows equal in the first ``by`` columns, and whether they are the
    task's first or last ones. A run that is longer than its batch is gathered."""
    held: list[list[np.ndarray]] = []
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        last = [c[-1] for c in new[:by]]
        here = np.logical_and.reduce([c == x for c, x in zip(new[:by], last)])
        cut = int(np.flatnonzero(~here)[-1]) + 1 if not here.all() else 0  # what is before belongs to whole runs
        if cut or (held and any(held[-1][i][-1] != new[i][0] for i in range(by))):
            held.append([c[:cut] for c in new])
            yield [np.concatenate(x) for x in zip(*held)], first, False
            held, first = [], False
        held.append([c[cut:] for c in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held)], first, True


def meetings(rows: DataFrame) -> DataFrame:
    """(cell, least, key, n, least_n, edge) of the documents that share a cell with others; ``least`` is
    the first of them in the task. Cells at a task's ends may go on elsewhere: ``edge``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, key, n), first, last in _runs(batches, 1):
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(edge, len(cell)))
            ends = np.zeros(len(edge), dtype=bool)
            ends[0], ends[-1] = first, last or ends[-1]
            some = np.repeat((size > 1) | ends, size)
            of = np.repeat(edge, size)[some]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[some], key[of], key[some], n[some], n[of], np.repeat(ends, size)[some])], names=["cell", "least", "key", "n", "least_n", "edge"])

    dealt = rows.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")
    return dealt.mapInArrow(run, "cell long, least long, key long, n long, least_n long, edge boolean")


def _near(a: str, b: str, percent: int) -> F.Column:
    """Sizes of which a link is possible."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def first_pairs(met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of a document and the first one of a cell of its, and of those where a cell is in
    several tasks."""
    stars = met.filter("least <> key").filter(_near("n", "least_n", percent)).select(F.col("least").alias("a"), F.col("key").alias("b"))
    heads = met.filter("edge").groupBy("cell", "least").agg(F.first("least_n").alias("n"))  # two a task at most
    first = heads.groupBy("cell").agg(F.min(F.struct("least", "n")).alias("f"), F.count("*").alias("m")).filter("m > 1").select("cell", "f")
    heads = heads.join(first, "cell").filter("least <> f.least").select(F.col("f.least").alias("a"), F.col("least").alias("b"), "n", F.col("f.n").alias("m"))
    return stars.union(heads.filter(_near("n", "m", percent)).select("a", "b")).distinct()


def _few(df: DataFrame) -> DataFrame:
    """Broadcast where its counted rows are few; else joined by key, skewed keys split at run time."""
    return F.broadcast(df) if df.count() <= FEW else df


def several(rows: DataFrame) -> DataFrame:
    """Rows (cell, key, n, group) of the cells at which more than one group meets."""
    open_ = keep(rows.groupBy("cell").agg((F.min("group") < F.max("group")).alias("open")).filter("open").select("cell"), "parity-cells")
    return rows.join(_few(open_), "cell", "left_semi")


def alone(docs: DataFrame, key: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, n): how many shingles each document has that no other of ``docs`` has."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b):
                s = Sets(p.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(s.h.view(np.int64)), p.column("key").take(pa.array(s.of))], names=["shingle", "key"])

    rows = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shingle long, key long")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.max("key").alias("key")).filter("n = 1")
    return once.groupBy("key").agg(F.count("*").alias("n"))


def small_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of documents of different groups in cells of ``SMALL`` documents at most."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, key, n, group), *_ in _runs(batches, 1):
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            last = np.repeat(np.append(edge[1:], len(cell)), np.diff(np.append(edge, len(cell))))
            left, right, at, shift = [], [], np.arange(len(cell)), 1
            while len(at := at[at + shift < last[at]]):
                x, y = at, at + shift
                some = (group[x] != group[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                left.append(key[x[some]])
                right.append(key[y[some]])
                shift += 1
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    dealt = rows.select("cell", "key", "n", "group").repartition("cell").sortWithinPartitions("cell", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def large_pairs(rows: DataFrame, sketched: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of documents of a cell (cell, key, n, group) that are in different groups and whose
    briefs are near enough. Cells over ``block`` documents are dealt as pairs of blocks."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > block)
    marked = rows.join(_few(keep(sizes, "parity-sizes")), "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    marked = marked.select("cell", "key", "n", "group", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = marked.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "key", "n", "group", "mine")
    joined = dealt.join(sketched.select("key", "brief"), "key")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, i, j, mine, key, n, group, brief), *_ in _runs(batches, 3):
            edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(cell)).tolist()):
                words = min(len(w) for w in brief[lo:hi])  # sizes of a cell are of two bands, next to each other
                bits = np.stack([folded(np.asarray(w, dtype=np.int64).view(np.uint64), words) for w in brief[lo:hi]])
                k, size, g = key[lo:hi], n[lo:hi], group[lo:hi]
                left = np.flatnonzero(mine[lo:hi] == i[lo])
                right = np.flatnonzero(mine[lo:hi] == j[lo])
                for x in left.tolist():
                    y = right[(g[right] != g[x]) & ((right > x) | (i[lo] != j[lo]))]
                    y = y[_may_link(size[x], size[y], np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64), percent)]
                    if len(y):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[x], k[y])), pa.array(np.maximum(k[x], k[y]))], names=["a", "b"])

    ordered = joined.select("cell", "i", "j", "mine", "key", "n", "group", "brief").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _may_link(m: np.ndarray, n: np.ndarray, far: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of m and n shingles that don't share ``far`` at least can be linked. Twice their
    intersection is m + n less what isn't shared, twice their union m + n and that."""
    return (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (100 * (m + n - far) >= percent * (m + n + far))


def _beside(pairs: DataFrame, payload: DataFrame, part: int) -> DataFrame:
    """Rows (a, lead, b, ...) of ``payload`` (key, ...): of each a, and after it of each b that it is
    paired with. An a of very many pairs is dealt over as many parts as its pairs need."""
    many = keep(pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > part), "parity-many").withColumnRenamed("a", "hot")
    dealt = pairs.join(_few(many), F.col("a") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("m") / part), F.lit(1))))
    dealt = dealt.select("a", "part", "b")
    rows = keep(dealt.withColumn("lead", F.lit(False)).union(dealt.select("a", "part", F.col("a").alias("b"), F.lit(True)).distinct()), "parity-dealt")
    joined = _few(rows).join(payload, F.col("b") == F.col("key")).drop("key")
    return joined.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead"), "b").drop("part")


def near(pairs: DataFrame, sketched: DataFrame, percent: int = PERCENT, part: int = BLOCK) -> DataFrame:
    """The pairs (a, b) whose briefs are near enough for a link."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            start, words = batch.column("brief").offsets.to_numpy(), batch.column("brief").flatten().to_numpy().view(np.uint64)
            left, right = [], []
            for i, (a, b, lead, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "lead", "n")))):
                brief = words[start[i] - start[0] : start[i + 1] - start[0]]
                if lead:
                    at, m, first = a, n, brief
                    continue
                assert at == a, "a pair without its first document"
                few = min(len(brief), len(first))
                if _may_link(m, n, int(np.bitwise_count(folded(brief, few) ^ folded(first, few)).sum()), percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return _beside(pairs, sketched.select("key", "n", "brief"), part).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, part: int = BLOCK) -> DataFrame:
    """The pairs (a, b) that are linked, by their sets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            for p in tx.pieces(batch):
                s = Sets(p.column("text"), shingle)
                left, right = [], []
                for i, (a, b, lead) in enumerate(zip(*(p.column(c).to_pylist() for c in ("a", "b", "lead")))):
                    own = s.h[s.first[i] : s.first[i + 1]]
                    if lead:
                        at, mine = a, own
                        continue
                    assert at == a, "a pair without its first document"
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(mine) - both):
                        left.append(a)
                        right.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    texts = docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    return _beside(pairs, texts, part).mapInArrow(run, "a long, b long")


def links(first: DataFrame, docs: DataFrame, key: str, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(node, root) of the documents of ``first`` (as of ``sketches``, of different sets) that have links
    and aren't their component's first."""
    check = lambda pairs: verified(keep(pairs, "parity-near"), docs, key, text_col, shingle, percent)
    met = keep(meetings(cells(first)), "parity-met")
    roots = keep(components(check(near(keep(first_pairs(met, percent), "parity-pairs"), first, percent))), "parity-roots")
    grouped = met.join(_few(roots), F.col("key") == F.col("node"), "left").select("cell", "key", "n", F.coalesce("root", "key").alias("group"))
    left = keep(several(grouped), "parity-open")
    large = keep(left.groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > small).select("cell"), "parity-large")
    more = check(near(keep(small_pairs(left.join(_few(large), "cell", "left_anti"), percent), "parity-pairs"), first, percent))
    left = keep(left.join(_few(large), "cell", "left_semi"), "parity-open")
    asked = docs.join(_few(left.select(F.col("key").alias(key)).distinct()), key, "left_semi")
    own = keep(alone(asked, key, text_col, shingle), "parity-alone").select(F.col("key").alias("k"), F.col("n").alias("own"))
    most = F.floor(F.floor(100 * F.col("n") / percent) * (100 - percent) / 100)
    able = left.join(_few(own), F.col("key") == F.col("k"), "left").filter(F.coalesce("own", F.lit(0)) <= most).select("cell", "key", "n", "group")
    more = more.union(check(large_pairs(keep(several(able), "parity-able"), first, percent, block)))
    return components(keep(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "parity-links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; ``component_id`` is the smallest doc_id that
    links reach."""
    key = fresh(docs, "_key")
    keyed, repeated = with_key(docs, key, id_col, text_col)
    once = keyed.dropDuplicates([key]) if repeated else keyed
    marked = keep(sketches(once, key, text_col, shingle, percent), "parity-sketches")
    classes = marked.filter("n > 0").groupBy("whole").agg(F.min("key").alias("rep"), F.count("*").alias("m")).filter("m > 1")
    classes = keep(classes.select("whole", "rep"), "parity-classes")
    copies = keep(marked.select("key", "whole").join(_few(classes), "whole").filter("key <> rep").select("key"), "parity-copies")
    first = marked.filter("n > 0").join(_few(copies), "key", "left_anti")
    roots = keep(links(first, once, key, text_col, shingle, percent, block, small), "parity-roots")
    rep = marked.select("key", "whole", "n").join(_few(classes), "whole", "left").select("key", "n", F.coalesce("rep", "key").alias("rep"))
    found = rep.join(_few(roots), F.col("rep") == F.col("node"), "left").select("key", "n", F.coalesce("root", "rep").alias("root"))
    if not repeated:
        return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    ids = keyed.select(F.col(key).alias("k"), F.col(id_col).alias("doc_id")).join(found, F.col("k") == F.col("key")).select("doc_id", "n", "root")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
