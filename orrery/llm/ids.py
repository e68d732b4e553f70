"""Keys that tell documents apart whatever their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import keep


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that isn't a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, key: str = "_key", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with a long ``key`` in the order of documents, and whether rows may share one.

    The key is the id where ids are whole and distinct. Otherwise documents are numbered in order
    of id (nulls first), then of their text's hash, and only repeated rows share a number.
    """
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    most, nulls = docs.groupBy(id_col).count().agg(F.max("count"), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    if (most or 0) <= 1 and not nulls:
        return docs.withColumn(key, F.col(id_col)), False
    t = fresh(docs, "_t")
    marked = docs.withColumn(t, F.xxhash64(text_col))
    d, u = fresh(marked, "_d"), fresh(marked, "_u")
    order = marked.select(F.col(id_col).alias(d), F.col(t).alias(u)).distinct().orderBy(F.asc_nulls_first(d), u)
    order = keep(order.withColumn(key, F.monotonically_increasing_id()), "order")
    joined = marked.join(order, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(t) == F.col(u)))
    return joined.drop(t, d, u), True
