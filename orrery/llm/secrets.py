"""Secret scan with corpus-wide ownership frequency.

``scan`` finds candidates in every text: three known forms (assigned, access key, hex run) and
a general one, long tokens of letters and digits of high entropy. ``ownership`` counts, for the
hash of each candidate value, the distinct repositories, owners and texts that hold it. A value
that several repositories or owners hold, or that stands in many different texts of one, is a
widely copied example; one that a single owner holds in a few texts looks live. The known forms are
always reported, with that class; a general candidate is reported only where its ownership says
that it is live.

Secret values leave the scan only as hashes. What ownership says goes back to a row by its text, so
a row gets the spans of its own text whatever its id.

Defined results: null text is empty; text that isn't UTF-8 is read
with U+FFFD for its bad bytes, which offsets count; rows without an owner (or repository) count as one owner, told
apart from any name, the empty one included; repeated rows and copies of a text raise no count of
uses; candidates of one value have one class; very long texts are handled whole; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import lean

KINDS = ["assign", "access", "hex", "general"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GENERAL = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
MIN_BITS = 3.2

#: A live value stands in at most so many repositories, owners and different texts.
MAX_REPOS, MAX_OWNERS, MAX_USES = 1, 1, 10
#: Parts that the copies of one text are dealt over.
PARTS = 16

SCANNED = "doc_id long, repo string, owner string, body string, part int, spans array<struct<kind:int,start:long,end:long,value:string>>"


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the known forms, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def general_spans(text: str, known: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out = []
    for m in _GENERAL.finditer(text):
        v = m[0]
        if _DIGIT.search(v) and _LETTER.search(v) and not any(a < m.end() and m.start() < b for _, a, b, _ in known) and entropy(v) >= MIN_BITS:
            out.append((3, m.start(), m.end(), v))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row per document with its candidate spans; their values are SHA-256 prefixes. ``body``
    names the text of a row with spans, ``part`` deals the rows of one text out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        made = 0
        for b in batches:
            spans, bodies = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                known = base_spans(t)
                found = known + general_spans(t, known)
                bodies.append(hashlib.blake2b(t.encode(), digest_size=16).hexdigest() if found else None)
                spans.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, s, e, v in found])
            part = pa.array((np.arange(made, made + b.num_rows) % PARTS).astype(np.int32))
            made += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("repo"), b.column("owner"), pa.array(bodies, pa.string()), part, pa.array(spans, kind)], names=["doc_id", "repo", "owner", "body", "part", "spans"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return cols.mapInArrow(run, SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct repositories, owners and texts of each candidate value."""
    texts = scanned.filter("body IS NOT NULL").groupBy("body", "repo", "owner").agg(F.any_value(F.array_distinct("spans.value")).alias("values"))
    # a row per text and holder, so copies count once; then per holder, so a value on a third of
    # all rows comes to few before it meets in one place
    holders = texts.select("repo", "owner", F.explode("values").alias("value")).groupBy("value", "repo", "owner").agg(F.count("*").alias("n"))
    named = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    return holders.groupBy("value").agg(named("repo").alias("n_repos"), named("owner").alias("n_owners"), F.sum("n").alias("n_uses"))


def live_values(scanned: DataFrame, max_repos: int = MAX_REPOS, max_owners: int = MAX_OWNERS, max_uses: int = MAX_USES) -> DataFrame:
    """(value) of those that ownership says are live."""
    return ownership(scanned).filter((F.col("n_repos") <= max_repos) & (F.col("n_owners") <= max_owners) & (F.col("n_uses") <= max_uses)).select("value")


def classify(scanned: DataFrame, **bounds: int) -> DataFrame:
    """Each candidate span of each different text with its class, ``live`` or ``example``."""
    texts = scanned.filter("body IS NOT NULL").groupBy("body").agg(F.any_value("spans").alias("spans"))
    spans = texts.select("body", F.explode("spans").alias("s")).select("body", "s.*")
    live = live_values(scanned, **bounds).withColumn("class", F.lit("live"))
    return spans.join(live, "value", "left").withColumn("class", F.coalesce("class", F.lit("example")))


def report(scanned: DataFrame, **bounds: int) -> DataFrame:
    """Each document with its known spans (``base``), the live general ones (``added``), and how
    many of its spans are live. ``scanned`` is read three times: write it down first."""
    live = classify(scanned, **bounds).filter(F.col("class") == "live")
    added = F.collect_set(F.when(F.col("kind") == 3, F.struct("start", "end", "kind")))
    per = live.groupBy("body").agg(F.array_sort(added).alias("added"), F.count("*").alias("n_live"))
    per = per.select("body", "added", "n_live", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    base = F.transform(F.filter("spans", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    none = F.array().cast("array<struct<start:long,end:long,kind:int>>")
    joined = scanned.withColumn("base", base).select("doc_id", "body", "part", "base").join(per, ["body", "part"], "left")
    return joined.select("doc_id", "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"))
