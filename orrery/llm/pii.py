"""Personal data: known forms, and terms that give protected entities away.

``scan`` finds e-mail addresses, IP addresses, card and phone numbers. The information-theoretic
part then treats each value found as a protected entity and asks how much a term reveals it:
for a term t in documents with entity e, P(e | t) is estimated as the independent documents that
hold both over those that hold t, and the disclosure is log2(P(e | t) / P(e)) bits. Terms over
both thresholds are reported wherever they occur, to be generalised. A term is a word anywhere in
the text, without the punctuation round it.

Copies of a document are no independent evidence: all counts are of distinct texts, known forms
left out, so a term needs three different documents with the entity.

Defined results: null text is empty; text that isn't UTF-8 is read
with U+FFFD for its bad bytes, which offsets count; a null doc_id has its spans like any other row; rows that
share a doc_id each get those of their own text; a very long text is handled whole, by itself;
terms of equal disclosure are all reported; an empty table gives an empty result; ``scan`` and
``report`` drop other columns, ``sanitised`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .ids import fresh
from .work import lean, trim

KINDS = ["email", "ip", "card", "phone", "term"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

SPANS = "array<struct<kind:int,start:long,end:long,entity:string>>"
_NO_TERM, _PUNCT, _LATIN = (np.zeros(256, dtype=bool) for _ in range(3))
_NO_TERM[list(b"0123456789@")] = True
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_LATIN[[0xA1, 0xAB, 0xB7, 0xBB, 0xBF]] = True  # second bytes of inverted marks, middle dot and guillemets


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the known forms, by kind, then start."""
    out = []
    at = text.find("@")
    free = 0  # where the last match ended
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, lo, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _entity(kind: int, value: str) -> str:
    plain = value.lower() if kind < 2 else _NOT_DIGIT.sub("", value)
    return f"{kind}:{hashlib.sha256(plain.encode()).hexdigest()[:24]}"


class Pieces:
    """Known forms, terms and context of each text of a piece.

    A text's context is a hash of its words without those of known forms, so that copies share it
    whatever address they give. Terms are words without digits or @.
    """

    def __init__(self, texts: pa.Array):
        self.words = w = term_words(texts)
        self.spans = []
        known = np.zeros(len(w.start), dtype=bool)
        for i, t in enumerate(texts.cast(pa.string())):
            t = t.as_py() or ""
            found = base_spans(t)
            self.spans.append(found)
            for _, s, e in found:
                lo = w.off[i] + len(t[:s].encode())
                hi = lo + len(t[s:e].encode())
                known[np.searchsorted(w.end, lo, side="right") : np.searchsorted(w.start, hi)] = True
        self.hash, self.doc = w.hashes(), w.doc_of_word()
        marks = np.concatenate([[0], np.cumsum(_NO_TERM[w.buf[: w.size]])])
        self.term = ~known & (marks[w.end] == marks[w.start])
        free = np.concatenate([[0], np.cumsum(~known)])
        place = (free[:-1] - free[w.first[self.doc]]).astype(np.uint64)
        each = np.where(known, np.uint64(0), tx.mix(self.hash + place * np.uint64(0x9E3779B97F4A7C15)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        self.context = (total[w.first[1:]] - total[w.first[:-1]]).view(np.int64)


def term_words(texts: pa.Array) -> tx.Words:
    """The lower-cased words without the punctuation round them; those of punctuation alone are left out."""
    w = tx.Words(texts, lower=True)
    while True:
        a, b, c = (w.buf[np.minimum(w.start + i, w.size)] for i in range(3))
        skip = _PUNCT[a] + 2 * ((a == 0xC2) & _LATIN[b]) + 3 * ((a == 0xE2) & (b == 0x80) & (c >= 0x90) & (c <= 0xBA))
        skip[w.start >= w.end] = 0
        if not skip.any():
            break
        w.start = w.start + skip
    while True:
        a, b, c = (w.buf[np.maximum(w.end - i, 0)] for i in (1, 2, 3))
        skip = _PUNCT[a] + 2 * ((b == 0xC2) & _LATIN[a]) + 3 * ((c == 0xE2) & (b == 0x80) & (a >= 0x90) & (a <= 0xBA))
        skip[w.start >= w.end] = 0
        if not skip.any():
            break
        w.end = w.end - skip
    some = w.start < w.end
    w.start, w.end = w.start[some], w.end[some]
    w.first = np.searchsorted(w.start, w.off)
    return w


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its spans, its context, and where it has spans its distinct terms."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string())]))
        for b in batches:
            for p in tx.pieces(b):
                x = Pieces(p.column("text"))
                spans, terms = [], []
                for i, (t, found) in enumerate(zip(p.column("text"), x.spans)):
                    t = t.as_py() or ""
                    spans.append([{"kind": k, "start": s, "end": e, "entity": _entity(k, t[s:e])} for k, s, e in found])
                    mine = slice(x.words.first[i], x.words.first[i + 1])
                    terms.append(np.unique(x.hash[mine][x.term[mine]]).view(np.int64) if found else [])
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(spans, span), pa.array(x.context), pa.array(terms, pa.list_(pa.int64()))], names=["doc_id", "spans", "context", "terms"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}, context long, terms array<long>")


#: Hashes that are broadcast at most, 8 MiB; beyond it tasks take every hash for one of them, and a
#: join on the hash decides.
MOST = 1 << 20


def broadcast_set(hashes: DataFrame, col: str):  # noqa: ANN201
    """The distinct hashes of a column for tasks to test words with, or None where there are more
    than ``MOST``."""
    distinct = hashes.select(F.col(col).alias("h")).distinct().limit(MOST + 1).toArrow()["h"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(np.sort(distinct).tobytes()) if len(distinct) <= MOST else None


def _within(h: np.ndarray, shared) -> np.ndarray:  # noqa: ANN001
    """Which hashes (signed) are in a broadcast set; all where there is none."""
    if shared is None:
        return np.ones(len(h), dtype=bool)
    known = np.frombuffer(shared.value, dtype=np.int64)
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def mentions_of(scanned: DataFrame) -> DataFrame:
    """(entity, entity_df): in how many independent documents each entity is."""
    return scanned.select("context", F.explode("spans.entity").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("entity_df"))


def candidate_terms(scanned: DataFrame, min_contexts: int = 3) -> DataFrame:
    """Pairs of term and entity that enough independent documents hold together."""
    often = mentions_of(scanned).filter(F.col("entity_df") >= min_contexts).select("entity")
    near = scanned.select("context", "terms", F.explode(F.array_distinct("spans.entity")).alias("entity")).join(often, "entity", "left_semi")
    once = near.dropDuplicates(["entity", "context"]).select("entity", F.explode("terms").alias("term"))
    return once.groupBy("term", "entity").agg(F.count("*").alias("together")).filter(F.col("together") >= min_contexts)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def document_counts(docs: DataFrame, terms: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df): how many independent documents have each of the terms. Texts are counted where
    they are read, so a term costs one row a piece however common it is; only those whose context
    is another's too are told apart by it."""
    wanted = broadcast_set(terms, "term")
    copied = broadcast_set(scanned.groupBy("context").count().filter("count > 1"), "context")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else np.frombuffer(wanted.value, dtype=np.int64)
        sums = np.zeros(0 if known is None else len(known), dtype=np.int64)

        def rows(term: np.ndarray, context: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            context = pa.nulls(len(term), pa.int64()) if context is None else pa.array(context)
            return pa.RecordBatch.from_arrays([pa.array(term), context, pa.array(n)], names=["term", "context", "n"])

        for b in batches:
            for p in tx.pieces(b):
                x = Pieces(p.column("text"))
                at = np.flatnonzero(x.term)
                at = at[_within(x.hash[at].view(np.int64), wanted)]
                term, context = x.hash[at].view(np.int64), x.context[x.doc[at]]
                order = np.lexsort((context, term))
                term, context = term[order], context[order]
                new = np.ones(len(term), dtype=bool)
                new[1:] = (term[1:] != term[:-1]) | (context[1:] != context[:-1])
                term, context = term[new], context[new]
                told = _within(context, copied)
                if told.any():
                    yield rows(term[told], context[told], np.ones(told.sum(), np.int64))
                if known is None:
                    yield rows(*(lambda t, n: (t, None, n))(*np.unique(term[~told], return_counts=True)))
                elif len(known):
                    sums += np.bincount(np.searchsorted(known, term[~told]), minlength=len(known))
        if sums.any():  # a row per term and task
            yield rows(known[sums > 0], None, sums[sums > 0])

    counts = _texts(docs, id_col, text_col).mapInArrow(run, "term long, context long, n long")
    if wanted is None:
        counts = counts.join(terms.select("term").distinct(), "term", "left_semi")
    each = counts.groupBy("term", "context").agg(F.when(F.col("context").isNull(), F.sum("n")).otherwise(1).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("df"))


def revealing(pairs: DataFrame, held: DataFrame, n_docs: int, mentions: DataFrame, min_share: float = 0.5, min_bits: float = 4.0) -> DataFrame:
    """Terms whose disclosure of some entity is over both thresholds.

    ``held`` has how many independent documents hold each term (df), ``mentions`` each entity
    (entity_df), ``n_docs`` is their number: all counts are of distinct contexts.
    """
    share = F.col("together") / F.col("df")
    bits = F.log2(share / (F.col("entity_df") / F.lit(max(n_docs, 1))))
    return pairs.join(held, "term").join(mentions, "entity").withColumns({"share": share, "bits": bits}).filter((F.col("share") >= min_share) & (F.col("bits") >= min_bits))


def revealing_terms(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = 3) -> DataFrame:
    """(term) of all terms over the thresholds, as hashes; ``keep`` writes a table down."""
    scanned = keep(scan(docs, id_col, text_col), "pii-scan")
    pairs = keep(candidate_terms(scanned, min_contexts), "pii-pairs")
    held = document_counts(docs, pairs, scanned, id_col, text_col)
    return keep(revealing(pairs, held, scanned.select("context").distinct().count(), mentions_of(scanned)).select("term").distinct(), "pii-terms")


def _term_places(texts: pa.Array, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Text, hash, start and end (in code points) of each word that may be in the set."""
    w = term_words(texts)
    h = w.hashes().view(np.int64)
    at = np.flatnonzero(_within(h, shared))
    doc = w.doc_of_word()[at]
    points = np.concatenate([[0], np.cumsum((w.buf[: w.size] & 0xC0) != 0x80)])
    base = points[w.off[doc]]
    return doc, h[at], points[w.start[at]] - base, points[w.end[at]] - base


PLACES = "array<struct<start:long,end:long>>"


def with_places(docs: DataFrame, terms: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the places of the terms in each text, found in the row itself.

    Where there are too many terms to broadcast, each distinct text is looked up once, by a join on
    the words, and rows take the places of their text, which a 128-bit hash names.
    """
    shared = broadcast_set(terms, "term")
    if shared is not None:

        @F.arrow_udf(PLACES)
        def places(text: pa.Array) -> pa.Array:
            out = []
            for p in tx.pieces(pa.RecordBatch.from_arrays([text], names=["text"])):
                doc, _, start, end = _term_places(p.column("text"), shared)
                offsets = np.searchsorted(doc, np.arange(p.num_rows + 1)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])))
            trim()
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

        return docs.withColumn(into, places(F.col(text_col).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in tx.pieces(b):
                doc, term, start, end = _term_places(p.column("text"), None)
                yield pa.RecordBatch.from_arrays([p.column("body").take(pa.array(doc)), pa.array(term), pa.array(start), pa.array(end)], names=["body", "term", "start", "end"])

    body, part, other = fresh(docs, "_body"), fresh(docs, "_part"), fresh(docs, "_place")
    texts = docs.select(F.md5(F.col(text_col).cast("string")).alias("body"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").dropDuplicates(["body"])
    hits = texts.mapInArrow(run, "body string, term long, start long, end long").join(terms.select("term").distinct(), "term", "left_semi")
    per = hits.groupBy("body").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(into))
    # copies of one text are dealt over parts, and so are its places
    per = per.select(F.col("body").alias(other), into, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias(part + "_"))
    left = docs.withColumns({body: F.md5(F.col(text_col).cast("string")), part: F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")})
    joined = left.join(per, (F.col(body) == F.col(other)) & (F.col(part) == F.col(part + "_")), "left").drop(body, part, other, part + "_")
    return joined.withColumn(into, F.coalesce(into, F.array().cast(PLACES)))


#: Parts that the copies of one text are dealt over.
PARTS = 16


def _free(known: list[tuple[int, int, int]], places: list[dict]) -> list[tuple[int, int]]:
    return [(x["start"], x["end"]) for x in places if not any(s < x["end"] and x["start"] < e for _, s, e in known)]


def report(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its known spans and the spans of revealing terms outside them."""
    docs = docs.withColumn(text_col, F.make_valid_utf8(F.col(text_col).cast("string")))
    terms = revealing_terms(docs, keep, id_col, text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.string())]))
        place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans, free = [], []
            for t, places in zip(b.column("text"), b.column("places")):
                t = t.as_py() or ""
                known = base_spans(t)
                spans.append([{"kind": k, "start": s, "end": e, "entity": _entity(k, t[s:e])} for k, s, e in known])
                free.append([{"start": s, "end": e} for s, e in _free(known, places.as_py() or [])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, span), pa.array(free, place)], names=["doc_id", "spans", "terms"])

    return with_places(_texts(docs, id_col, text_col), terms, "places").mapInArrow(run, f"doc_id long, spans {SPANS}, terms {PLACES}")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stands."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = end
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with known personal data replaced by its kind and revealing terms generalised, each
    row by what its own text holds."""
    docs = docs.withColumn(text_col, F.make_valid_utf8(F.col(text_col).cast("string")))
    found = fresh(docs, "_places")
    placed = with_places(docs, revealing_terms(docs, keep, id_col, text_col), found, text_col)

    @F.arrow_udf("string")
    def redacted(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, more in zip(text, places):
            t = t.as_py()
            if t is None:
                out.append(None)
                continue
            known = base_spans(t)
            out.append(redact(t, [(s, e, k) for k, s, e in known] + [(s, e, 4) for s, e in _free(known, more.as_py() or [])]))
        return pa.array(out, pa.string())

    return placed.withColumn(text_col, redacted(F.col(text_col).cast("string"), found)).select(*docs.columns)
