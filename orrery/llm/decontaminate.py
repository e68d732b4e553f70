"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

An item of L words contaminates a document that holds a stretch of words within
floor((1 - similarity) * L) edits of it. Words are lower-cased and cut at white space and ASCII
punctuation.

1. Windows. An item for which d edits are allowed is cut into d // 2 + 1 parts, so that at least
   one part has one edit at most (pigeonhole): windows of a document need the size of parts,
   whatever the size of the item. The window that begins at every word is taken, but for those that
   hold fewer of the benchmark's words and word pairs than a part leaves so: they can't pass.
2. CGK. A random walk reads a window: at each place it writes down the word that it stands at, and
   moves on to the next word or stays as a random function of place and word says. Sequences at a
   small edit distance come to strings that agree in most places (small Hamming distance). Walks
   from all words of a text are computed together, place by place from the last one.
3. LSH. Each repetition has a walk of its own and samples a few of its places; the words there are a
   window's key, which is looked up in the repetition's table of the items' parts. The number of
   repetitions is the one at which random edits of the items, as many as are allowed, are found with
   the target recall, measured for items of one part, two parts and more; if none reaches it, that
   is an error.
4. Verification. The exact edit distance of the item to its best stretch around the window, by a
   bit-parallel scan whose memory is in proportion to the item.

The benchmark is the stated query set: it is read in blocks of a bounded number of words, each
broadcast and run against all documents, so its own size doesn't matter to any task.

Defined results: null text has no words; null items and items without words contaminate nothing;
items of one to four words allow no edits; very long documents and items are taken whole; of equally
near stretches the shortest, then the first is reported; repeated documents and items each have
rows of their own; empty tables give an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .work import lean, trim

SIMILARITY = 0.8
RECALL = 0.99
#: Words of a part at most, and sampled places of a walk.
LONGEST, PLACES = 40, 3
#: Repetitions are measured up to this many; more are an error.
REPETITIONS = 96
TRIALS = 150
BLOCK_WORDS = 200_000
_BY = np.uint64(0xA0761D6478BD642F)
_PAD = np.uint64(0x2545F4914F6CDD1D)
_KEEP = np.array([c >= 0x80 or chr(c).isalnum() or chr(c) in " \t\n\r\x0b\x0c" for c in range(256)])
FOUND = "doc_id long, item_id long, edits int, start_word long, end_word long"


def words_of(texts: pa.Array) -> tx.Words:
    """Lower-cased words, ASCII punctuation read as white space."""
    return tx.Words(texts, lower=True, blank=~_KEEP)


def edits_allowed(n: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def parts_of(n: int, edits: int) -> list[tuple[int, int]]:
    """(first word, length) of the parts of an item of ``n`` words."""
    m = max(edits // 2 + 1, -(-n // LONGEST))
    cut = [n * i // m for i in range(m + 1)]
    return list(zip(cut, np.diff(cut).tolist()))


def keys(words: np.ndarray, upto: int, sampled: np.ndarray, seed: int) -> np.ndarray:
    """The sampled places, as one key, of the walk that begins at each word.

    The walk from a word through ``place`` and on is the same whoever came there, so what it writes
    from there is computed once, from the last place back. ``words`` end in padding.
    """
    turn = tx.mix(words ^ tx.mix(np.array([seed], dtype=np.uint64)))
    out = np.full(len(words) + 1, _PAD)
    for place in reversed(range(upto)):
        move = (turn & np.uint64(1 << place)) != 0
        new = np.where(move, out[1:], out[:-1])
        if place in sampled:
            new = tx.mix(new * _BY + words)
        out[:-1] = new
    return out[:-1]


def padded(h: np.ndarray, first: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, padding after each, and where each word went."""
    n = np.diff(first)
    at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n) * upto
    out = np.full(len(h) + len(n) * upto, _PAD)
    out[at] = h
    return out, at


class Table:
    """Parts of one length and with one number of edits, and their keys in each repetition."""

    def __init__(self, length: int, edits: int):
        self.length, self.edits, self.number = length, edits, 100 * edits + length
        self.upto = length + length // 2 if edits else length
        self.item, self.offset = [], []
        rng = np.random.default_rng(1000 + self.number)
        # without edits every place is read
        self.sampled = [np.sort(rng.choice(self.upto, PLACES, replace=False)) for _ in range(REPETITIONS)] if edits else [np.arange(length)]

    def of(self, words: np.ndarray, repetition: int) -> np.ndarray:
        return keys(words, self.upto, self.sampled[repetition], self.number * 1000 + repetition)

    def build(self, items: list[np.ndarray], repetitions: int) -> None:
        first = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        words, at = padded(np.concatenate(items), first, self.upto)
        start = at[first[self.item] + np.array(self.offset)]
        self.item, self.offset = np.array(self.item), np.array(self.offset)
        self.tables = []
        for r in range(min(repetitions, len(self.sampled))):
            key = self.of(words, r)[start]
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 18, dtype=bool)
            maybe[key >> np.uint64(46)] = True
            self.tables.append((key[order], order, maybe))

    def look_up(self, words: np.ndarray, known: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, part) of the windows that share a key with a part; ``known`` marks words of the
        benchmark, ``pairs`` those that begin a word pair of it."""
        place, span = np.arange(len(words)), self.length + self.edits
        enough = np.ones(len(words), dtype=bool)
        # an edit takes one word and two pairs at most
        for marks, size, need in ((known, span, self.length - self.edits), (pairs, span - 1, self.length - 1 - 2 * self.edits)):
            if need > 0:
                count = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
                enough &= count[np.minimum(place + size, len(words))] - count[:-1] >= need
        start = np.flatnonzero(enough)
        # the words that walks from there may read
        edge = np.zeros(len(words) + 1, dtype=np.int32)
        edge[start] += 1
        np.add.at(edge, np.minimum(start + self.upto, len(words)), -1)
        read = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        near, begin = words[read], np.searchsorted(read, start)
        out = []
        for r, (key, order, maybe) in enumerate(self.tables):
            code = self.of(near, r)[begin]
            at = np.flatnonzero(maybe[code >> np.uint64(46)])
            lo, hi = np.searchsorted(key, code[at], "left"), np.searchsorted(key, code[at], "right")
            many = hi - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append(np.stack([start[np.repeat(at, many)], order[which]]))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return found[0], found[1]


def _edited(rng: np.random.Generator, words: np.ndarray, d: int) -> np.ndarray:
    out = words.tolist()
    for _ in range(d):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = int(rng.integers(2**63))
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, int(rng.integers(2**63)))
    return np.array(out, dtype=np.uint64)


def repetitions_for(recall: float, items: list[np.ndarray], edits: list[int], tables: list[Table], owners: list[list[tuple[Table, int]]], seed: int = 11) -> int:
    """How many repetitions find edited items with the target recall, by trial.

    Random items of one part, of two, and of more are edited as much as is allowed and put among
    random words. ``owners`` has each item's parts.
    """
    rng = np.random.default_rng(seed)
    kinds = defaultdict(list)
    for i, d in enumerate(edits):
        if d:
            kinds[min(3, len(owners[i]))].append(i)
    most = 1
    for _, of_kind in sorted(kinds.items()):
        missed, total, budget = np.zeros(REPETITIONS, dtype=np.int64), 0, BLOCK_WORDS
        while total < TRIALS and (budget > 0 or total < 10):
            i = of_kind[int(rng.integers(len(of_kind)))]
            edge = [rng.integers(2**63, size=16, dtype=np.uint64) for _ in range(2)]
            text = np.concatenate([edge[0], _edited(rng, items[i], edits[i]), edge[1]])
            budget -= len(text)
            first = REPETITIONS  # the repetition that finds it first
            for table in {t.number: t for t, _ in owners[i]}.values():
                near = np.append(text, np.full(table.upto, _PAD))
                own = np.append(items[i], np.full(table.upto, _PAD))
                offsets = [o for t, o in owners[i] if t is table]
                for r in range(min(first, len(table.sampled))):
                    if np.isin(table.of(near, r), table.of(own, r)[offsets]).any():
                        first = min(first, r)
                        break
            missed[:first] += 1
            total += 1
        enough = np.flatnonzero(missed <= (1 - recall) * total)
        if not len(enough):
            raise ValueError(f"{REPETITIONS} repetitions find {1 - missed[-1] / total:.3f} of the edited items, short of a recall of {recall}")
        most = max(most, int(enough[0]) + 1)
    return most


def scores(pattern: dict[int, int], n: int, text: list[int], anchored: bool = False) -> Iterator[int]:
    """Fewest edits of a pattern of ``n`` words to a stretch that ends at each word of the text, and
    begins anywhere, or at its first word if ``anchored``. Bit ``i`` of ``pattern[w]``: word ``i`` is w."""
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for w in text:
        same = pattern.get(w, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (mask & ~(level | up)), up & level
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1 | anchored) & mask, (less << 1) & mask
        up, down = less | (mask & ~(vertical | more)), more & vertical
        yield score


def pattern_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, w in enumerate(words):
        out[w] |= 1 << i
    return dict(out)


def best_stretch(item: list[int], words: list[int]) -> tuple[int, int, int]:
    """Fewest edits of the item to a stretch of the words, and the stretch; of equal ones the
    shortest, then the first."""
    n = len(item)
    at_end = list(scores(pattern_of(item), n, words))
    edits = min([n, *at_end])
    best = (0, 0, 0) if edits == n else None
    back = pattern_of(item[::-1])
    for end in (i + 1 for i, s in enumerate(at_end) if s == edits):
        lo = max(0, end - n - edits)
        length = next(i + 1 for i, s in enumerate(scores(back, n, words[lo:end][::-1], anchored=True)) if s == edits)
        if best is None or (length, end) < best[:2]:
            best = (length, end, end - length)
            if length == n - edits:
                break  # no stretch is shorter
    return edits, best[2], best[1]


class Block:
    """A block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, recall: float):
        w = words_of(pa.array([t.encode() for _, t in rows], pa.binary()))
        h = w.hashes()
        kept = [i for i in range(len(rows)) if w.counts[i]]
        self.ids = [rows[i][0] for i in kept]
        self.words = [h[w.first[i] : w.first[i + 1]] for i in kept]
        self.edits = [edits_allowed(len(x), similarity) for x in self.words]
        tables: dict[tuple[int, int], Table] = {}
        owners: list[list[tuple[Table, int]]] = []
        for number, (x, d) in enumerate(zip(self.words, self.edits)):
            parts = parts_of(len(x), d)
            owners.append([])
            for offset, length in parts:
                kind = length, d // len(parts)
                if kind not in tables:
                    tables[kind] = Table(*kind)
                tables[kind].item.append(number)
                tables[kind].offset.append(offset)
                owners[-1].append((tables[kind], offset))
        self.tables = list(tables.values())
        self.repetitions = repetitions_for(recall, self.words, self.edits, self.tables, owners)
        for t in self.tables:
            t.build(self.words, self.repetitions)
        self.known, self.pairs = np.zeros(1 << 20, dtype=bool), np.zeros(1 << 22, dtype=bool)
        for x in self.words:
            self.known[x >> np.uint64(44)] = True
            self.pairs[tx.shingle_hashes(x, 2) >> np.uint64(42)] = True

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, item, first word of the item as the window lines up with it), in order."""
        upto = max(t.upto for t in self.tables)
        words, at = padded(h, first, upto)
        known, pairs = np.zeros((2, len(words)), dtype=bool)
        known[at] = self.known[h >> np.uint64(44)]
        pairs[:-1] = known[:-1] & known[1:]
        near = np.flatnonzero(pairs)
        pairs[near] = self.pairs[tx.mix(words[near] * tx.TIMES + words[near + 1]) >> np.uint64(42)]
        out = [np.zeros((3, 0), dtype=np.int64)]
        for t in self.tables:
            place, part = t.look_up(words, known, pairs)
            number = np.searchsorted(at, place)  # of the word
            ok = at[np.minimum(number, len(at) - 1)] == place  # not padding
            number, part = number[ok], part[ok]
            doc = np.searchsorted(first, number, side="right") - 1
            out.append(np.stack([doc, t.item[part], number - t.offset[part] - first[doc]]))
        return np.unique(np.concatenate(out, axis=1), axis=1)

    def find(self, w: tx.Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best stretch of each pair that is found."""
        if not self.words or not len(w.start):
            return []
        h = w.hashes()
        doc, item, start = self.candidates(h, w.first)
        out = []
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else []
        for lo, hi in zip(edge, [*edge[1:], len(doc)]):
            number = int(item[lo])
            a, b = int(w.first[doc[lo]]), int(w.first[doc[lo] + 1])
            if (best := self._best(number, h[a:b], start[lo:hi].tolist())) is not None:
                out.append((int(doc[lo]), number, *best))
        return out

    def _best(self, number: int, words: np.ndarray, starts: list[int]) -> tuple[int, int, int] | None:
        """Edits, start and end of the item's best stretch around the starts, if within its limit."""
        item, limit = self.words[number], self.edits[number]
        best, ranges = None, []
        for s in starts:
            lo, hi = max(0, s - 2 * limit), min(len(words), s + len(item) + 2 * limit)
            if ranges and lo <= ranges[-1][1]:
                ranges[-1][1] = hi
            else:
                ranges.append([lo, hi])
        for lo, hi in ranges:
            part = words[lo:hi]
            if np.isin(item, part).sum() < len(item) - limit:
                continue
            edits, x, y = best_stretch(item.tolist(), part.tolist())
            now = (edits, y - x, lo + x, lo + y)
            if edits <= limit and (best is None or now < best):
                best = now
                if edits == 0:
                    break
        return None if best is None else (best[0], best[2], best[3])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    rows, n = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if r["t"]:
            rows.append((r["i"], r["t"]))
            n += len(r["t"].split())
        if n >= BLOCK_WORDS:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start_word, end_word) of every document and item that it holds."""
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], FOUND)
    for rows in _blocks(benchmark, item_id_col, item_text_col):
        block = spark.sparkContext.broadcast(Block(rows, similarity, recall))

        @lean
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            for b in batches:
                for p in tx.pieces(b):
                    found = block.value.find(words_of(p.column("text")))
                    ids = p.column("doc_id").to_pylist()
                    cols = [[ids[f[0]] for f in found], [block.value.ids[f[1]] for f in found], *([f[i] for f in found] for i in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "edits", "start_word", "end_word"])

        out = out.unionByName(cols.mapInArrow(run, FOUND))
    return out


def _holds(block):  # noqa: ANN001, ANN202
    """Whether a text holds an item of the broadcast block."""

    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        out, at = np.zeros(len(text), dtype=bool), 0
        for p in tx.pieces(batch):
            for f in block.value.find(words_of(p.column("text"))):
                out[at + f[0]] = True
            at += p.num_rows
        trim()
        return pa.array(out)

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones. Rows are judged where they are read; nothing is shuffled."""
    spark = docs.sparkSession
    for rows in _blocks(benchmark, item_id_col, item_text_col):
        block = spark.sparkContext.broadcast(Block(rows, similarity, recall))

        docs = docs.filter(~_holds(block)(F.col(text_col).cast("string")))
    return docs
