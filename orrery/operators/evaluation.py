"""How good a result is: recall, precision, reciprocal rank, and summaries of them.

Results and truth are (query_id, doc_id, rank); each query of ``queries`` (query_id) gets a row,
also one that nothing was found for.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import VectorError


def _cut(result: DataFrame, k: int) -> DataFrame:
    return result.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()


def _share(queries: DataFrame, hits: DataFrame, of: DataFrame, k: int, name: str) -> DataFrame:
    n = of.groupBy("query_id").agg(F.count("*").alias("_n"))
    h = hits.groupBy("query_id").agg(F.count("*").alias("_h"))
    most = F.least(F.col("_n"), F.lit(k))
    value = F.when(most > 0, F.coalesce("_h", F.lit(0)) / most).otherwise(0.0)
    return queries.select("query_id").distinct().join(n, "query_id", "left").join(h, "query_id", "left").select("query_id", F.coalesce(value, F.lit(0.0)).alias(name))


def recall_at(queries: DataFrame, truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """|truth and result, both to rank k| / min(k, |truth|); 0 without truth."""
    t = _cut(truth, k)
    return _share(queries, _cut(result, k).join(t, ["query_id", "doc_id"], "left_semi"), t, k, "recall")


def precision_at(queries: DataFrame, truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """Distinct hits / min(k, |result|)."""
    r = _cut(result, k)
    return _share(queries, r.join(_cut(truth, k), ["query_id", "doc_id"], "left_semi"), r, k, "precision")


def recall_curve(queries: DataFrame, truth: DataFrame, result: DataFrame, ks: list[int]) -> DataFrame:
    """(k, mean recall) from one pass over the matches."""
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    t, r = (df.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")) for df in (truth, result))
    both = t.join(r.withColumnRenamed("rank", "_r"), ["query_id", "doc_id"]).select("query_id", F.greatest("rank", "_r").alias("_at"))
    n = t.groupBy("query_id").agg(F.count("*").alias("_n"))
    grid = queries.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("_n", F.lit(0)).alias("_n"), k)
    hits = grid.join(both, "query_id", "left").groupBy("query_id", "_n", "k").agg(F.count(F.when(F.col("_at") <= F.col("k"), 1)).alias("_h"))
    most = F.least("_n", "k")
    return hits.groupBy("k").agg(F.round(F.avg(F.when(most > 0, F.col("_h") / most).otherwise(0.0)), 6).alias("recall"))


def mean_recall(per_query: DataFrame, expected: int) -> DataFrame:
    """Mean of a recall table; an error where queries are missing."""
    if (found := per_query.count()) != expected:
        raise VectorError(f"recall of {found} queries, of {expected} asked")
    return per_query.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.count("*").alias("n_queries"))


def sweep(search: Callable[[int], DataFrame], settings: list[int], queries: DataFrame, truth: DataFrame, k: int) -> list[tuple[int, float, float]]:
    """(setting, mean recall, seconds) of a search at each of a few settings; each runs once, and a
    row of it reaches the driver."""
    out = []
    for s in settings:
        begun = time.perf_counter()
        recall = recall_at(queries, truth, search(s), k).agg(F.avg("recall")).first()[0]
        out.append((s, float(recall or 0.0), time.perf_counter() - begun))
    return out


def reciprocal_rank(queries: DataFrame, relevant: DataFrame, result: DataFrame) -> DataFrame:
    """1 / rank of the first relevant document of each query, 0 without one."""
    first = result.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("_r"))
    return queries.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1 / F.col("_r"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """Mean, least, most, population deviation and the 50th, 95th and 99th percentile by index
    floor(n * p). Values are counted before they are put in order, a row for each different one."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("m")).filter("v IS NOT NULL")
    every = W.partitionBy(F.lit(0))
    upto = counts.select("v", "m", F.sum("m").over(every.orderBy("v")).alias("upto"), F.sum("m").over(every).alias("n"))
    at = lambda p: F.round(F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v"))), F.max("v")), 6)
    mean = F.sum(F.col("v") * F.col("m")) / F.max("n")
    spread = F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v") * F.col("m")) / F.max("n") - mean * mean, F.lit(0.0)))
    figures = {"mean": mean, "least": F.min("v"), "most": F.max("v"), "deviation": spread}
    return upto.agg(F.max("n").alias("n"), *[F.round(c, 6).alias(name) for name, c in figures.items()], at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
