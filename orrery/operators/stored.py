"""Inverted lists as a stored table that takes changes.

An index is a folder. ``data`` holds segments, Parquet partitioned by list: each row's id, vector,
product code (where the index has codes) and attributes, under the caller's names. ``dead`` holds the
rows that later changes replaced or deleted, by segment and list. ``model`` is the centroids and
codebooks, and ``manifest`` says what stands: a row a segment and list with its rows, its dead ones and
a summary of its attributes (``summaries``), the batches applied, and where the model is. A manifest is
a version of a small table; a change writes its segment and then moves the pointer to a new manifest,
so readers see the whole change or nothing of it, and what a crash leaves behind is named nowhere.

A change writes as much as it brings: rows it replaces are marked dead in a segment of their own, found
by a scan of the ids alone. A batch that carries its name and has been applied changes nothing. Lists
with many dead rows or segments are rewritten, and those alone, by ``settle``.

A search filters on the partition column and names the lists' folders, so files of other lists are
neither listed nor read. A query probes its nearest lists, and more than it was told to until these
hold k rows that pass the predicate for certain, or all that may: how many rows of a list pass, at
least and at most, follows from the summaries, without a pass over rows. So min(k, matches) rows
always come back.

The model is fitted on all rows (``kmeans.fit``), codebooks on a bounded sample (``quantize.SAMPLE``).

Defined results: rows without an id or a vector aren't indexed; inserted rows with equal ids are rows
of their own, of equal distances the smaller id comes first; an empty table gives an empty index and
empty results, and its model is fitted on the first rows that come; fewer different vectors than lists
raise ``TooFewVectors``; columns that the index doesn't have are left out, missing ones are null. One
writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import Unsupported
from ..functions import distance as D
from ..schema import VectorTable
from ..sources.versions import VersionedTable
from . import kmeans, knn
from .kmeans import Centroids
from .predicates import Predicate, bounds
from .quantize import ProductQuantiser, sample
from .summaries import Known, summarise, summarised

MODEL = "kind string, no long, vector array<double>"
METRICS = ("l2", "cosine", "inner_product")
#: Times the mean size from which a list is split when the model is fitted.
MOST = 4.0
#: Rows that are broadcast at most.
FEW = 1 << 18
#: Queries whose distances to all centroids are computed at a time: 64 MiB of them.
TILE = 1 << 23
LIST, DEAD, BATCH, META = "list", "dead", "batch", "meta"


@dataclass(frozen=True)
class StoredIndex:
    """An index at one of its versions."""

    spark: SparkSession
    path: str
    version: int
    meta: dict
    model: Centroids | None
    codes: ProductQuantiser | None = field(repr=False, default=None)

    @property
    def centroids(self) -> np.ndarray:
        return np.zeros((0, 0)) if self.model is None else self.model.lists

    @cached_property
    def manifest(self) -> DataFrame:
        return VersionedTable(f"{self.path}/manifest").read(self.spark, self.version)

    @property
    def lists(self) -> DataFrame:
        return self.manifest.filter(F.col("kind") == LIST)

    @property
    def rows(self) -> DataFrame:
        """All live rows under the caller's names, with the list and the segment of each."""
        return self.read()

    def read(self, lists: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The live rows of some lists, or of all."""
        m, seg, lst = self.meta, self.meta["segment"], self.meta["list"]
        some = self.lists if lists is None else self.lists.filter(F.col("list").isin(lists))
        folders = some.select("segment").distinct() if lists is None else some.select("segment", "list").distinct()
        paths = [f"{self.path}/data/{seg}={r[0]}" + ("" if lists is None else f"/{lst}={r[1]}") for r in sorted(folders.collect())]
        schema = StructType.fromJson(m["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema).select(*_named(columns or schema.names))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        rows = rows if lists is None else rows.filter(F.col(lst).isin(lists))
        gone, few = self.dead(lists)
        keep = columns or schema.names
        if gone is None:
            return rows.select(*_named(keep))
        names = {n: _fresh(schema.names, n) for n in ("dead_id", "dead_segment", "dead_list")}
        gone = gone.select(*[F.col(n).alias(new) for n, new in names.items()])
        gone = F.broadcast(gone) if few else gone
        same = (F.col(f"`{m['id']}`") == F.col(names["dead_id"])) & (F.col(seg) == F.col(names["dead_segment"])) & (F.col(lst) == F.col(names["dead_list"]))
        return rows.select(*_named(dict.fromkeys([*keep, m["id"], seg, lst]))).join(gone, same, "left_anti").select(*_named(keep))

    def dead(self, lists: list[int] | None = None) -> tuple[DataFrame | None, bool]:
        """(dead_id, dead_segment, dead_list) of the dead rows of some lists, or of all; whether they are few."""
        some = self.manifest.filter(F.col("kind") == DEAD)
        folders = (some if lists is None else some.filter(F.col("list").isin(lists))).select("segment", "list", "rows").collect()
        if not folders:
            return None, True
        paths = [f"{self.path}/dead/change={r['segment']}/dead_list={r['list']}" for r in folders]
        gone = self.spark.read.schema("dead_id long, dead_segment long, change long, dead_list int").option("basePath", f"{self.path}/dead").parquet(*paths).drop("change")
        return gone, sum(r["rows"] for r in folders) <= FEW

    def matches(self, predicate: Predicate | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many live rows of each list pass, at least and at most, from the manifest alone."""
        out = np.zeros((2, len(self.centroids)), dtype=np.int64)
        known = Known(self.meta["types"], self.meta["summarised"], F.col("rows"), F.col("fields"))
        least, most = (F.col("rows"), F.col("rows")) if predicate is None else bounds(predicate, known)
        each = self.lists.select("list", F.greatest(F.lit(0), least - F.col("dead")).alias("least"), F.least(most, F.col("rows") - F.col("dead")).alias("most"))
        for r in each.groupBy("list").agg(F.sum("least"), F.sum("most")).collect():  # a row a list
            out[:, r[0]] = r[1], r[2]
        return out[0], out[1]

    @cached_property
    def sizes(self) -> np.ndarray:
        """Live rows of each list."""
        return self.matches()[0]


# -- writing -----------------------------------------------------------------------------------


def _named(names) -> list[Column]:  # noqa: ANN001
    return [F.col(f"`{n}`") for n in names]


def _fresh(names, name: str) -> str:  # noqa: ANN001
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    return kmeans.unit(x) if metric == "cosine" else x


def _indexable(base: VectorTable) -> VectorTable:
    return VectorTable(base.df.dropna(subset=[base.id_col, base.vector_col]), base.id_col, base.vector_col)


def _placed(index: StoredIndex, base: VectorTable) -> DataFrame:
    """The rows of a table as the index stores them, but for the segment."""
    m, model, codes = index.meta, index.model, index.codes

    @F.pandas_udf("list int, code binary")
    def place(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"list": pd.Series([], dtype="int32"), "code": pd.Series([], dtype=object)})
        x = _prepared(np.stack([np.asarray(a, dtype=np.float64) for a in v]), m["metric"])
        at = model.assign(x)[0]
        code = [None] * len(x) if codes is None else [c.tobytes() for c in codes.encode(x - model.lists[at])]
        return pd.DataFrame({"list": at.astype(np.int32), "code": pd.Series(code, dtype=object)})

    there = set(base.df.columns)
    kinds = {f.name: f.dataType for f in StructType.fromJson(m["schema"])}
    rest = [(F.col(f"`{a}`").cast(kinds[a]) if a in there and a not in (base.id_col, base.vector_col) else F.lit(None).cast(kinds[a])).alias(a) for a in m["attributes"]]
    id_, vector = F.col(f"`{base.id_col}`").cast("long").alias(m["id"]), F.col(f"`{base.vector_col}`").cast(kinds[m["vector"]]).alias(m["vector"])
    at = _fresh([m["id"], m["vector"], *m["attributes"]], "place")
    rows = _indexable(base).df.select(id_, vector, *rest)
    rows = rows.withColumn(at, place(F.col(f"`{m['vector']}`").cast("array<double>")))
    return rows.select(m["id"], m["vector"], F.col(at)["code"].alias(m["code"]), *[f"`{a}`" for a in m["attributes"]], F.col(at)["list"].alias(m["list"]))


MANIFEST = ("kind", "note", "segment", "list", "rows", "dead", "fields")


def _entries(df: DataFrame, kind: str, fields_type, **values: Column) -> DataFrame:  # noqa: ANN001
    """Rows of a manifest."""
    kinds = {"kind": "string", "note": "string", "segment": "long", "list": "int", "rows": "long", "dead": "long", "fields": fields_type}
    values["kind"] = F.lit(kind)
    return df.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in MANIFEST])


def _segment(index: StoredIndex, rows: DataFrame, number: int) -> DataFrame:
    """Write rows as a segment; their manifest rows, from what was written."""
    m = index.meta
    path = f"{index.path}/data/{m['segment']}={number}"
    # a list that holds many rows goes to several tasks
    rows.hint("rebalance", m["list"]).write.mode("overwrite").partitionBy(m["list"]).parquet(path)
    schema = StructType([f for f in StructType.fromJson(m["schema"]) if f.name != m["segment"]])
    written = index.spark.read.schema(schema).parquet(path)
    lst = _fresh(m["summarised"], "list")
    written = written.select(F.col(m["list"]).alias(lst), *[F.col(f"`{a}`") for a in m["summarised"]])
    s = summarise(written, [lst], m["summarised"], "rows_", "fields_")
    return _entries(s, LIST, s.schema["fields_"].dataType, segment=F.lit(number), list=F.col(lst), rows=F.col("rows_"), dead=F.lit(0), fields=F.col("fields_"))


def _notes(index: StoredIndex, rows: list[tuple[str, str]]) -> DataFrame:
    return index.spark.createDataFrame([(k, n) for k, n in rows], "kind string, note string").coalesce(1)


def _publish(index: StoredIndex, parts: list[DataFrame]) -> StoredIndex:
    """Make the union of some manifest rows the manifest."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    version = VersionedTable(f"{index.path}/manifest").publish(out.coalesce(1 + index.meta["lists"] // 4096))
    return StoredIndex(index.spark, index.path, version, index.meta, index.model, index.codes)


def _fitted(index: StoredIndex, base: VectorTable) -> StoredIndex:
    """The index with a model of ``base``, written to a folder of its own."""
    m = index.meta
    base = _indexable(base)
    model = kmeans.fit(base, m["lists"], 10, m["seed"], spherical=m["metric"] == "cosine", most=MOST).centroids
    rows = [("centroid", i, c.tolist()) for i, c in enumerate(model.lists)]
    if model.tops is not None:
        rows += [("top", i, c.tolist()) for i, c in enumerate(model.tops)] + [("first", i, [float(n)]) for i, n in enumerate(model.first)]
    codes = None
    if m["parts"]:
        x = _prepared(sample(base), m["metric"])
        codes = ProductQuantiser.fit(x - model.lists[model.assign(x)[0]], m["parts"], m["codes"], m["seed"])
        rows += [("book", i, b.tolist()) for i, b in enumerate(codes.books.reshape(-1, codes.books.shape[2]))] + [("turn", i, r.tolist()) for i, r in enumerate(codes.turn)]
    name = f"model/{uuid.uuid4().hex}"
    index.spark.createDataFrame(rows, MODEL).coalesce(1).write.parquet(f"{index.path}/{name}")
    return StoredIndex(index.spark, index.path, index.version, m | {"model": name}, model, codes)


def _model(spark: SparkSession, path: str, parts: int) -> tuple[Centroids, ProductQuantiser | None]:
    kinds: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("kind", "no").collect():
        kinds.setdefault(r["kind"], []).append(r["vector"])
    matrix = lambda kind: np.array(kinds[kind], dtype=np.float64) if kind in kinds else None
    books, first = matrix("book"), matrix("first")
    codes = None if books is None else ProductQuantiser(matrix("turn"), books.reshape(parts, -1, books.shape[1]))
    return Centroids(matrix("centroid"), matrix("top"), None if first is None else first[:, 0].astype(np.int64)), codes


def build(base: VectorTable, path: str, lists: int, parts: int = 0, codes: int = 256, seed: int = 0, metric: str = "l2") -> StoredIndex:
    """Write an index of ``base`` to a new folder, with product codes of ``parts`` bytes unless 0."""
    spark = base.df.sparkSession
    if metric not in METRICS:
        raise Unsupported(f"no stored index by {metric!r}; there are {', '.join(METRICS)}")
    if VersionedTable(f"{path}/manifest").pointer(spark) is not None:
        raise Unsupported(f"there is an index at {path}")
    names = base.df.columns
    code, lst, seg = (_fresh(names, n) for n in ("row_code", "list_no", "segment_no"))
    attributes = [c for c in names if c not in (base.id_col, base.vector_col)]
    schema = base.df.select(F.col(f"`{base.id_col}`").cast("long").alias(base.id_col), f"`{base.vector_col}`", F.lit(None).cast("binary").alias(code), *[f"`{a}`" for a in attributes], F.lit(0).alias(lst), F.lit(0).cast("long").alias(seg)).schema
    of = [base.id_col, *attributes]
    meta = {
        "id": base.id_col, "vector": base.vector_col, "code": code, "list": lst, "segment": seg, "attributes": attributes, "schema": json.loads(schema.json()),
        "types": {f.name: f.dataType.simpleString() for f in schema}, "summarised": [c for c in summarised(base.df.select(*[f"`{c}`" for c in of])) if c in of],
        "lists": lists, "parts": parts, "codes": codes, "seed": seed, "metric": metric, "model": None,
    }
    index = StoredIndex(spark, path.rstrip("/"), -1, meta, None)
    if _indexable(base).df.limit(1).count():
        index = _fitted(index, base)
        return _publish(index, [_segment(index, _placed(index, base), 0), _notes(index, [(META, json.dumps(index.meta))])])
    empty = summarise(base.df.select(*[f"`{c}`" for c in meta["summarised"]], F.lit(0).alias(lst)).limit(0), [lst], meta["summarised"], "rows_", "fields_")
    return _publish(index, [_entries(empty, LIST, empty.schema["fields_"].dataType), _notes(index, [(META, json.dumps(meta))])])


def load(spark: SparkSession, path: str, version: int | None = None) -> StoredIndex:
    """An index as it stands, or as it stood at a version that is kept; its model alone is read, of a
    size that doesn't depend on the table."""
    path = path.rstrip("/")
    table = VersionedTable(f"{path}/manifest")
    version = table.pointer(spark) if version is None else version
    if version is None:
        raise Unsupported(f"there is no index at {path}")
    meta = json.loads(table.read(spark, version).filter(F.col("kind") == META).first()["note"])
    model, codes = (None, None) if meta["model"] is None else _model(spark, f"{path}/{meta['model']}", meta["parts"])
    return StoredIndex(spark, path, version, meta, model, codes)


# -- changes -----------------------------------------------------------------------------------


def change(index: StoredIndex, more: VectorTable | None = None, gone: DataFrame | None = None, batch: str | None = None, replace: bool = True) -> StoredIndex:
    """The index with rows added and the ids of ``gone`` (id) deleted. With ``replace`` a row stands for
    all older ones with its id. A ``batch`` that has been applied before changes nothing."""
    index = load(index.spark, index.path)
    if batch is not None and index.manifest.filter((F.col("kind") == BATCH) & (F.col("note") == batch)).limit(1).count():
        return index
    some = more is not None and bool(_indexable(more).df.limit(1).count())
    if some and index.model is None:
        index = _fitted(index, more)
    number = 1 + (index.manifest.agg(F.max("segment")).first()[0] if index.manifest.filter("segment IS NOT NULL").limit(1).count() else -1)
    kinds, old = index.manifest.schema["fields"].dataType, index.manifest.filter(F.col("kind") != META)
    parts, ids = [], None if gone is None else gone.select(F.col("id").cast("long").alias("id"))
    if replace and some:
        new = _indexable(more).df.select(F.col(f"`{more.id_col}`").cast("long").alias("id"))
        ids = new if ids is None else ids.union(new)
    if ids is not None:
        hit = _dead_rows(index, ids, number)
        if hit is not None:
            lost = hit.groupBy("dead_segment", "dead_list").agg(F.count("*").alias("lost"))
            old = old.join(lost, (F.col("kind") == LIST) & (F.col("segment") == F.col("dead_segment")) & (F.col("list") == F.col("dead_list")), "left")
            old = old.withColumn("dead", F.col("dead") + F.coalesce("lost", F.lit(0))).select(*MANIFEST)
            parts.append(_entries(hit.groupBy("dead_list").agg(F.count("*").alias("n")), DEAD, kinds, segment=F.lit(number), list=F.col("dead_list"), rows=F.col("n")))
    if some:
        parts.append(_segment(index, _placed(index, more), number))
    notes = [(META, json.dumps(index.meta))] + ([(BATCH, batch)] if batch is not None else [])
    return _publish(index, [old, *parts, _notes(index, notes)])


def _dead_rows(index: StoredIndex, ids: DataFrame, number: int) -> DataFrame | None:
    """Write down which live rows have these ids; their ids, segments and lists."""
    m, spark = index.meta, index.spark
    wanted = ids.dropna().distinct().select(F.col("id").alias("wanted"))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    live = index.read(columns=[m["id"], m["segment"], m["list"]]).toDF("dead_id", "dead_segment", "dead_list")
    hit = live.join(wanted, F.col("dead_id") == F.col("wanted"), "left_semi")
    path = f"{index.path}/dead/change={number}"
    hit.hint("rebalance", "dead_list").write.mode("overwrite").partitionBy("dead_list").parquet(path)
    written = spark.read.schema("dead_id long, dead_segment long, dead_list int").parquet(path)
    return written if written.limit(1).count() else None


def insert(index: StoredIndex, more: VectorTable, batch: str | None = None) -> StoredIndex:
    """The index with more rows, beside those with equal ids."""
    return change(index, more, batch=batch, replace=False)


def settle(index: StoredIndex, share: float = 0.2, segments: int = 8) -> StoredIndex:
    """Rewrite the lists whose dead rows are more than ``share`` of all, or that are in more than
    ``segments`` segments, without their dead rows, in one segment. No other list is touched."""
    index = load(index.spark, index.path)
    by_list = index.lists.groupBy("list").agg(F.sum("rows").alias("n"), F.sum("dead").alias("dead"), F.count("*").alias("m"))
    lists = [r["list"] for r in by_list.filter((F.col("dead") > share * F.col("n")) | (F.col("m") > segments)).select("list").collect()]
    if not lists:
        return index
    number = 1 + index.manifest.agg(F.max("segment")).first()[0]
    columns = [c for c in StructType.fromJson(index.meta["schema"]).names if c != index.meta["segment"]]
    new = _segment(index, index.read(lists, columns), number)
    other = index.manifest.filter(~F.col("kind").isin(LIST, DEAD) | ~F.col("list").isin(lists))
    return _publish(index, [other, new])


def reclaim(index: StoredIndex, keep: int = 2) -> list[str]:
    """Delete all manifests but the newest ``keep``, and the segments, dead rows and models that none of
    these names; the folders deleted."""
    spark, table = index.spark, VersionedTable(f"{index.path}/manifest")
    table.reclaim(spark, keep)
    named: set[str] = set()
    for v in table.versions(spark):
        at = table.read(spark, v)
        named |= {f"data/{index.meta['segment']}={r[0]}" for r in at.filter(F.col("kind") == LIST).select("segment").distinct().collect()}
        named |= {f"dead/change={r[0]}" for r in at.filter(F.col("kind") == DEAD).select("segment").distinct().collect()}
        named |= {str(json.loads(r["note"])["model"]) for r in at.filter(F.col("kind") == META).collect()}
    gone = [p for top in ("data", "dead", "model") for p in table.children(spark, f"{index.path}/{top}") if p.removeprefix(f"{index.path}/") not in named]
    for p in gone:
        table.delete(spark, p)
    return gone


def compact(index: StoredIndex, dead: DataFrame, path: str) -> StoredIndex:
    """The index without the rows that ``dead`` (id) names, in a new folder; nothing is encoded anew."""
    gone = dead.select(F.col("id").cast("long").alias(_fresh(index.meta["types"], "gone"))).distinct()
    m, path = index.meta, path.rstrip("/")
    rows = index.read(columns=[c for c in StructType.fromJson(m["schema"]).names if c != m["segment"]])
    rows = rows.join(gone, F.col(f"`{m['id']}`") == gone[gone.columns[0]], "left_anti")
    if m["model"] is not None:
        index.spark.read.parquet(f"{index.path}/{m['model']}").coalesce(1).write.parquet(f"{path}/{m['model']}")
    new = StoredIndex(index.spark, path, -1, m, index.model, index.codes)
    return _publish(new, [_segment(new, rows, 0), _notes(new, [(META, json.dumps(m))])])


def apply_batch(path: str, batch: DataFrame, batch_id: int, id_col: str, vector_col: str, seq_col: str | None = None, op_col: str | None = None, stream: str = "") -> None:
    """Apply a micro-batch of a stream to the index at ``path``, once however often it comes: rows stand
    for older ones with their ids; of one id's rows in the batch, the one of largest ``seq_col`` counts;
    rows whose ``op_col`` is delete delete."""
    index = load(batch.sparkSession, path)
    if seq_col is not None:
        last = F.max_by(F.struct(*[f"`{c}`" for c in batch.columns]), F.col(seq_col)).alias("last")
        batch = batch.groupBy(F.col(id_col).alias("of")).agg(last).select("last.*")
    gone = None if op_col is None else batch.filter(F.col(op_col) == "delete").select(F.col(id_col).alias("id"))
    rows = batch if op_col is None else batch.filter(F.coalesce(F.col(op_col) != "delete", F.lit(True)))
    change(index, VectorTable(rows, id_col, vector_col), gone, f"{stream}{batch_id}")


# -- reading -----------------------------------------------------------------------------------


def reconstruct(index: StoredIndex) -> DataFrame:
    """(id, vector): what the codes stand for, or the vectors themselves where there are none. Of a
    cosine index these are unit vectors."""
    m = index.meta
    if index.codes is None:
        return index.rows.select(F.col(m["id"]).alias("id"), F.col(m["vector"]).cast("array<double>").alias("vector"))
    centroids, pq = index.centroids, index.codes

    @F.pandas_udf("array<double>")
    def decoded(list_no: pd.Series, code: pd.Series) -> pd.Series:
        if not len(code):
            return pd.Series([], dtype=object)
        return pd.Series(list(centroids[list_no.to_numpy()] + pq.decode(_bytes(code))), dtype=object)

    return index.rows.select(F.col(m["id"]).alias("id"), decoded(m["list"], m["code"]).alias("vector"))


def _bytes(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)


class NearestByCode(knn.Nearest):
    """As ``knn.Nearest``, for product codes of one list at a time: a table of each query's squared
    distances to (or products with) the codebooks' entries, and a sum over a row's code."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, codes: ProductQuantiser, centroids: np.ndarray, products: bool = False):
        super().__init__(ids, vectors, k, "l2_squared")
        self.codes, self.centroids, self.products = codes, centroids, products

    def _table(self, part: np.ndarray, list_no: int) -> tuple[np.ndarray, np.ndarray]:
        q, books = self.vectors[part], self.codes.books
        if self.products:
            turned = (q @ self.codes.turn).reshape(len(part), len(books), -1)
            return np.stack([-(turned[:, m] @ books[m].T) for m in range(len(books))]), -(q @ self.centroids[list_no])[:, None]
        left = ((q - self.centroids[list_no]) @ self.codes.turn).reshape(len(part), len(books), 1, -1)
        return np.stack([((left[:, m] - books[m]) ** 2).sum(axis=2) for m in range(len(books))]), np.zeros((len(part), 1))

    def see_list(self, list_no: int, rows: np.ndarray, code: np.ndarray, asked: np.ndarray) -> None:
        for j in range(0, len(asked), 256):
            part = asked[j : j + 256]
            table, start = self._table(part, list_no)
            for i in range(0, len(rows), knn.TILE_ROWS):
                c = code[i : i + knn.TILE_ROWS]
                d = start + sum(table[m][:, c[:, m]] for m in range(len(table)))
                limit = self.distance[part, -1:]
                if len(c) >= self.k:
                    limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k])
                which, at = np.nonzero(d <= limit + 10.0**-knn.PLACES)
                self.keep(part, which, rows[i : i + knn.TILE_ROWS][at], d[which, at])


def _asked(index: StoredIndex, q: np.ndarray, probes: int, k: int, matches: tuple[np.ndarray, np.ndarray]) -> dict[int, np.ndarray]:
    """Which queries look at each list: a query at its nearest ones, at least ``probes`` and as many as
    hold k matches for certain; lists without a possible match are left out."""
    least, most = matches
    metric = "inner_product" if index.meta["metric"] == "inner_product" else "l2_squared"
    q, lists = _prepared(q, index.meta["metric"]), index.centroids
    who, where = [], []
    step = max(1, TILE // max(1, len(lists)))
    for i in range(0, len(q), step):
        order = np.argsort(np.round(D.kernel(metric, q[i : i + step], lists), 9), axis=1, kind="stable")
        before = np.cumsum(least[order], axis=1) - least[order]
        want = ((np.arange(order.shape[1])[None, :] < probes) | (before < k)) & (most[order] > 0)
        row, at = np.nonzero(want)
        who.append(row + i)
        where.append(order[row, at])
    who, where = np.concatenate(who), np.concatenate(where)
    order = np.lexsort((who, where))
    who, where = who[order], where[order]
    edge = np.flatnonzero(np.diff(where, prepend=-1))
    return {int(where[a]): part for a, part in zip(edge, np.split(who, edge[1:]))} if len(edge) else {}


def search(index: StoredIndex, queries: VectorTable, k: int, probes: int, predicate: Predicate | None = None, pool: int = 10) -> DataFrame:
    """The k nearest rows that pass, by the index's metric, among the lists that each query probes.

    An index with codes scans these for ``pool`` * k candidates a query and computes the candidates'
    distances from their vectors.
    """
    spark, m = index.spark, index.meta
    out = spark.createDataFrame([], knn.RESULT)
    matches = index.matches(predicate)
    if k <= 0 or not matches[1].any():
        return knn.top_k(out, k)
    for ids, q in knn._blocks(queries.rows, index.centroids.shape[1]):
        asked = _asked(index, q, probes, k if index.codes is None else pool * k, matches)
        probed = index.read(sorted(asked))
        probed = probed if predicate is None else probed.filter(predicate(probed))
        near = _scan(index, probed, ids, q, asked, k if index.codes is None else pool * k)
        if index.codes is not None:
            full = VectorTable(probed.select(m["id"], m["vector"]), m["id"], m["vector"])
            near = knn.rerank(knn.top_k(near, pool * k), full, queries, k, m["metric"]).select("query_id", "doc_id", "distance")
        out = out.union(near)
    return knn.top_k(out, k)


def _scan(index: StoredIndex, probed: DataFrame, ids: np.ndarray, q: np.ndarray, asked: dict[int, np.ndarray], k: int) -> DataFrame:
    m = index.meta
    metric, column = m["metric"], m["vector"] if index.codes is None else m["code"]
    centroids = {p: index.centroids[p] for p in asked} if index.codes is not None else None
    shared = index.spark.sparkContext.broadcast((ids, q if index.codes is None else _prepared(q, metric), asked, index.codes, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, asked, codes, centroids = shared.value
        found = knn.Nearest(ids, q, k, metric) if codes is None else NearestByCode(ids, q, k, codes, centroids, metric == "inner_product")
        for b in batches:
            lists = b.column("list").to_numpy()
            order = np.argsort(lists, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1) if len(order) else []:
                p = int(lists[at[0]])
                rows, values = b.column("id").to_numpy()[at], b.column("value").take(pa.array(at))
                if codes is not None:
                    found.see_list(p, rows, _bytes(values.to_pylist()), asked[p])
                else:
                    found.see(rows, knn._matrix(values), asked[p])
        yield found.result()

    return probed.select(F.col(m["id"]).alias("id"), F.col(f"`{column}`").alias("value"), F.col(m["list"]).alias("list")).mapInArrow(run, knn.RESULT)


def looked_at(index: StoredIndex, queries: VectorTable, k: int, probes: int) -> float:
    """The share of the index's rows that a query looks at, on average over the queries."""
    seen = n = 0
    for _, q in knn._blocks(queries.rows, index.centroids.shape[1]):
        seen += sum(len(who) * int(index.sizes[p]) for p, who in _asked(index, q, probes, k, (index.sizes, index.sizes)).items())
        n += len(q)
    return seen / max(1, n * int(index.sizes.sum()))
