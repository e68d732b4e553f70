"""Language-model scores by deleted interpolation.

A text is its words and one end token. The model mixes maximum-likelihood trigram and bigram
estimates with the smoothed unigram one,

    P3(w | g h) = m3[b(c(g, h))] * c(g, h, w) / c(g, h) + (1 - m3) * P2(w | h)
    P2(w | h)   = m2[b(c(h))] * c(h, w) / c(h) + (1 - m2) * P1(w)
    P1(w)       = (c(w) + A) / (N + A * (V + 1)),

where b buckets a context's count by powers of two (a context never seen has weight 0), and the
weights m3[b] and m2[b] are learned by expectation-maximisation on the documents left out of the
counts.

Texts are packed into blocks of a few megabytes. A block asks for the counts of its distinct tokens,
bigrams and trigrams; questions meet in slices of the hash space that the number of tokens sets, so
that each stays of one size, and every block asks once for a key however often it has it. A question
is the sorted keys of one block in one slice, their differences compressed. There are as many rows
as blocks times slices, but never more than keys, so that the shuffle stays in proportion to the
corpus. Answers go back to the block, which scores its texts. All counts are over the whole corpus
and nothing of it reaches the driver but sums.

Tokens and bigrams are told apart by 64 bits of hash, trigrams by 56.

Defined results: null text is the end token alone; a null doc_id is held out; repeated rows are
texts of their own; equal texts have equal scores; a very long text is a block of its own; with no
training text every count is zero; with no held-out text the weights stay at one half; an empty
table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .work import keep, lean

A = 0.1
BLOCK_BYTES = 6 << 20
SLICE_TOKENS = 2_000_000
BUCKETS = 40
KINDS = 3  # tokens, bigrams, trigrams
_END, _BEGIN, _BY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0xA0761D6478BD642F)
_COARSE = ~np.uint64(0xFF)

BLOCK = "block long, held boolean, ids array<long>, sizes array<long>, packed binary, tokens long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts packed into blocks, training and held-out ones apart."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        base, made = TaskContext.get().partitionId() << 32, 0
        z = zstandard.ZstdCompressor(level=3)
        open_: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def close(held: bool) -> pa.RecordBatch:
            nonlocal made
            texts = [t for _, t in open_[held]]
            n = sum(len(t.split()) for t in texts) + len(texts)
            row = [base | made, held, [i for i, _ in open_[held]], [len(t) for t in texts], z.compress(b"".join(texts)), n]
            made, open_[held], size[held] = made + 1, [], 0
            types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["block", "held", "ids", "sizes", "packed", "tokens"])

        for b in batches:
            for doc, held, text in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text").cast(pa.binary())):
                text = text.as_py() or b""
                open_[held].append((doc, text))
                size[held] += len(text) + 8
                if size[held] >= BLOCK_BYTES:
                    yield close(held)
        for held in (False, True):
            if open_[held]:
                yield close(held)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.withColumn("held", held_out(F.col("doc_id"))).mapInArrow(run, BLOCK)


def block_tokens(packed: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, bigrams, trigrams, and where each text begins among them (one more entry than texts)."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=sum(sizes)) if sum(sizes) else b""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    hashes, counts = [], []
    at = 0
    while at < len(sizes):  # pieces bound what hashing needs at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tx.PIECE_BYTES, side="right")) - 1)
        part = pa.array([data[offsets[i] : offsets[i + 1]] for i in range(at, to)], pa.binary())
        w = tx.Words(part, lower=True)
        hashes.append(w.hashes())
        counts.append(w.counts)
        at = to
    h, n = np.concatenate(hashes), np.concatenate(counts)
    token = np.insert(h, np.cumsum(n), _END)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    bigram = tx.mix(_before(token, first, _BEGIN) * _BY + token)
    return token, bigram, tx.mix(_before(bigram, first, _BEGIN) * _BY + token) & _COARSE, first


def _before(x: np.ndarray, first: np.ndarray, begin) -> np.ndarray:  # noqa: ANN001
    """The entry before each one, ``begin`` where a text begins."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = begin
    return out


def _slice(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slice of the hash space, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def questions(packed_blocks: DataFrame, slices: int) -> DataFrame:
    """(slice, block, keys, counts): the distinct keys of each block in a slice, ascending, with how
    often training texts have them there. Slices of tokens come first, then those of bigrams and of
    trigrams, ``slices`` each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, held, sizes, packed in zip(*(b.column(c).to_pylist() for c in ("block", "held", "sizes", "packed"))):
                for kind, keys in enumerate(block_tokens(packed, sizes)[:KINDS]):
                    keys.sort()
                    new = np.ones(len(keys), dtype=bool)
                    new[1:] = keys[1:] != keys[:-1]
                    at = np.flatnonzero(new)
                    n = np.zeros(len(at), np.int64) if held else np.diff(np.append(at, len(keys)))
                    keys = keys[at]
                    at = _slice(keys, slices)
                    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    ends = np.append(edge[1:], len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(kind * slices + at[edge]), pa.array(np.full(len(edge), block)),
                            pa.array([_squeezed(keys[i:j]) for i, j in zip(edge, ends)], pa.binary()),
                            pa.array([_small(n[i:j]) for i, j in zip(edge, ends)], pa.binary()),
                        ],
                        names=["slice", "block", "keys", "counts"],
                    )

    return packed_blocks.select("block", "held", "sizes", "packed").mapInArrow(run, "slice long, block long, keys binary, counts binary")


#: Fewer bytes than this aren't compressed.
_FEW = 256


def _small(n: np.ndarray) -> bytes:
    """Numbers, compressed where there are many: byte by byte, so that those that are alike meet."""
    import zstandard

    if 8 * len(n) < _FEW:
        return b"\0" + n.astype("<i8").tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1, write_content_size=True).compress(n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _large(b: bytes) -> np.ndarray:
    import zstandard

    if b[:1] == b"\0":
        return np.frombuffer(b, dtype="<i8", offset=1)
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _squeezed(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return _small(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(_large(b).view(np.uint64), dtype=np.uint64)


def answers(asked: DataFrame, slices: int) -> DataFrame:
    """(slice, block, counts, n_distinct): corpus counts of the keys of each question; ``n_distinct``,
    on one question of each slice, is how many keys training texts have."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []

        def close() -> pa.RecordBatch:
            keys = [_keys(r[1]) for r in rows]
            sizes = [len(k) for k in keys]
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")  # runs that are in order are merged
            keys = keys[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            total = np.add.reduceat(np.concatenate([_large(r[2]) for r in rows])[order], np.flatnonzero(new))
            each = np.empty(len(keys), dtype=np.int64)
            each[order] = total[np.cumsum(new) - 1]
            out = np.split(each, np.cumsum(sizes)[:-1])
            n = [int((total > 0).sum())] + [0] * (len(rows) - 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([here] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([_small(o) for o in out], pa.binary()), pa.array(n, pa.int64())],
                names=["slice", "block", "counts", "n_distinct"],
            )

        for b in batches:
            for part, block, keys, counts in zip(*(b.column(c).to_pylist() for c in ("slice", "block", "keys", "counts"))):
                if here != part:
                    if rows:
                        yield close()
                    here, rows = part, []
                rows.append((block, keys, counts))
        if rows:
            yield close()

    dealt = asked.repartition(KINDS * slices, "slice").sortWithinPartitions("slice", "block")
    return dealt.mapInArrow(run, "slice long, block long, counts binary, n_distinct long")


def _counts_of(told: list[dict], slices: int) -> list[np.ndarray]:
    """Counts of the block's distinct keys in ascending order, by kind."""
    told = sorted(told, key=lambda a: a["slice"])
    return [np.concatenate([_large(a["counts"]) for a in told if a["slice"] // slices == kind]) for kind in range(KINDS)]


class Counts:
    """c(w), c(h), c(h, w), c(g, h) and c(g, h, w) of each token of a block, and where its texts begin."""

    def __init__(self, row: dict, slices: int):
        *keys, self.first = block_tokens(row["packed"], row["sizes"])
        told = _counts_of(row["told"], slices)
        self.word, self.pair, self.triple = (n[np.unique(k, return_inverse=True)[1]] for n, k in zip(told, keys))
        ends = self.word[self.first[1:] - 1][0]  # as many training texts begin as end
        self.context, self.context2 = _before(self.word, self.first, ends), _before(self.pair, self.first, ends)

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter((self.word, self.context, self.pair, self.context2, self.triple))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen in training, else by powers of two."""
    return np.where(context > 0, np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1), 0)


COUNTS = ["word", "context", "pair", "context2", "triple"]
#: Blocks that a task scores, about.
TASK_BLOCKS = 4


def _answered(packed_blocks: DataFrame, told: DataFrame, n_blocks: int) -> DataFrame:
    parts = max(1, n_blocks // TASK_BLOCKS)
    per = told.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("slice", "counts")).alias("told"))
    return packed_blocks.repartition(parts, "block").join(per, "block").select("held", "ids", "sizes", "packed", "told")


def held_out_counts(answered: DataFrame, slices: int) -> DataFrame:
    """(word, context, pair, context2, triple, n): how often held-out tokens have such counts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                all_ = np.stack([*Counts(row, slices)], axis=1)
                order = np.lexsort(all_.T)
                new = np.ones(len(order), dtype=bool)
                new[1:] = (all_[order[1:]] != all_[order[:-1]]).any(axis=1)
                at = np.flatnonzero(new)
                seen = all_[order[at]]
                yield pa.RecordBatch.from_arrays([*(pa.array(seen[:, i]) for i in range(len(COUNTS))), pa.array(np.diff(np.append(at, len(order))))], names=[*COUNTS, "n"])

    each = answered.filter("held").mapInArrow(run, ", ".join(f"{c} long" for c in [*COUNTS, "n"]))
    return each.groupBy(*COUNTS).agg(F.sum("n").alias("n"))


def _bucket(context: Column) -> Column:
    """``bucket`` as a Column."""
    return F.when(context > 0, F.least(F.length(F.bin(context)), F.lit(BUCKETS - 1))).otherwise(0).cast("int")


def learn(counts: DataFrame, n_tokens: int, n_distinct: int, rounds: int = 60, tolerance: float = 1e-4) -> tuple[list[float], list[float]]:
    """Weights of the trigram and of the bigram estimate by bucket, by expectation-maximisation.

    ``counts`` are read once a round, which is an aggregation to at most ``BUCKETS`` ** 2 rows.
    Buckets without held-out tokens keep the starting weight of one half.
    """
    m3, m2 = ([0.0] + [0.5] * (BUCKETS - 1) for _ in range(2))
    low = (F.col("word") + A) / F.lit(n_tokens + A * (n_distinct + 1))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    ready = counts.select("n", _bucket(F.col("context2")).alias("b3"), _bucket(F.col("context")).alias("b2"), share("triple", "context2").alias("r3"), share("pair", "context").alias("r2"), low.alias("r1"))
    weight = lambda m, b: F.element_at(F.array(*[F.lit(w) for w in m]), F.col(b) + 1)
    for _ in range(rounds):
        w3, w2 = weight(m3, "b3"), weight(m2, "b2")
        two, one = (1 - w3) * w2 * F.col("r2"), (1 - w3) * (1 - w2) * F.col("r1")
        part = ready.select("b3", "b2", "n", (w3 * F.col("r3")).alias("p3"), two.alias("p2"), one.alias("p1")).withColumn("p", F.col("p3") + F.col("p2") + F.col("p1"))
        got = part.groupBy("b3", "b2").agg(*[F.sum(F.col("n") * F.col(p) / F.col("p")).alias(p) for p in ("p3", "p2", "p1")]).collect()
        new3, new2 = list(m3), list(m2)
        for b in range(1, BUCKETS):
            in3, in2 = [r for r in got if r["b3"] == b], [r for r in got if r["b2"] == b]
            if all_ := sum(r["p3"] + r["p2"] + r["p1"] for r in in3):
                new3[b] = min(max(sum(r["p3"] for r in in3) / all_, 1e-6), 1 - 1e-6)
            if all_ := sum(r["p2"] + r["p1"] for r in in2):
                new2[b] = min(max(sum(r["p2"] for r in in2) / all_, 1e-6), 1 - 1e-6)
        moved = max(abs(x - y) for x, y in zip(new3 + new2, m3 + m2))
        m3, m2 = new3, new2
        if moved < tolerance:
            break
    return m3, m2


def _score(answered: DataFrame, slices: int, weights: tuple[list[float], list[float]], n_tokens: int, n_distinct: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m3, m2 = (np.array(m) for m in weights)
        for b in batches:
            for row in b.to_pylist():
                c = Counts(row, slices)
                low = (c.word + A) / (n_tokens + A * (n_distinct + 1))
                w = m2[bucket(c.context)]
                p = w * c.pair / np.maximum(c.context, 1) + (1 - w) * low
                w = m3[bucket(c.context2)]
                p = w * c.triple / np.maximum(c.context2, 1) + (1 - w) * p
                at = c.first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array([row["held"]] * len(at)), pa.array(np.diff(c.first)), pa.array(np.add.reduceat((c.word > 0).astype(np.int64), at)),
                        pa.array(np.add.reduceat(np.log10(low), at)), pa.array(np.add.reduceat(np.log10(p), at)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return answered.mapInArrow(run, SCORES)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's log10 probability under the model and under the unigram base."""
    packed = keep(blocks(docs, id_col, text_col), "lm-blocks")
    train, every, n, n_held = packed.agg(F.sum(F.when(~F.col("held"), F.col("tokens"))), F.sum("tokens"), F.count("*"), F.count(F.when(F.col("held"), 1))).first()
    slices = max(4, math.ceil((every or 0) / SLICE_TOKENS))
    told = keep(answers(questions(packed, slices), slices), "lm-answers")
    distinct = told.filter(F.col("slice") < slices).agg(F.sum("n_distinct")).first()[0] or 0
    held_blocks = packed.filter("held")
    held_told = told.join(F.broadcast(held_blocks.select("block")), "block") if n_held <= MOST else told.join(held_blocks.select("block"), "block")
    held = keep(held_out_counts(_answered(held_blocks, held_told, n_held), slices), "lm-held")
    weights = learn(held, train or 0, distinct)
    return _score(_answered(packed, told, n), slices, weights, train or 0, distinct).withColumn("train_tokens", F.lit(train or 0).cast("long"))


#: Block numbers that are broadcast at most.
MOST = 1 << 20
