"""What a vector set is like: intrinsic dimension, hubness, contrast, dispersion.

Those over neighbours take a result of ``knn_join`` (query_id, doc_id, distance, rank) that leaves
the query itself out, for a stated query set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance as D
from ..schema import VectorTable
from . import knn
from .ranks import ranked

INFINITE = float("inf")


def _round(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def lid(neighbours: DataFrame, k: int = 20) -> DataFrame:
    """Maximum-likelihood local intrinsic dimension of each query, -n / sum(ln(d_i / d_k)) over
    0 < d_i < d_k; infinite where no ratio is left, NaN with fewer than two neighbours."""
    near = neighbours.filter(F.col("rank") <= k)
    far = near.withColumn("_far", F.max("distance").over(W.partitionBy("query_id")))
    ratio = F.when(F.col("_far") > 0, F.col("distance") / F.nullif("_far", F.lit(0.0)))
    log = F.when((ratio > 0) & (ratio < 1), F.log(ratio))
    got = far.groupBy("query_id").agg(F.count("*").alias("_k"), F.count(log).alias("_n"), F.sum(log).alias("_s"))
    value = F.when(F.col("_k") < 2, float("nan")).when((F.col("_n") == 0) | (F.col("_s") == 0), INFINITE).otherwise(-F.col("_n") / F.nullif("_s", F.lit(0.0)))
    return got.select("query_id", _round(value).alias("lid"))


def _finite(c: str) -> Column:
    return ~F.isnan(c) & (F.col(c) != INFINITE) & (F.col(c) != -INFINITE)


def lid_aggregates(lids: DataFrame) -> DataFrame:
    """Mean, median and harmonic mean over finite positive values."""
    good = lids.filter(_finite("lid") & (F.col("lid") > 0))
    return good.agg(F.count("*").alias("n"), _round(F.avg("lid")).alias("mean"), _round(F.percentile("lid", 0.5)).alias("median"), _round(F.count("*") / F.sum(1 / F.col("lid"))).alias("harmonic"))


def lid_categories(lids: DataFrame) -> DataFrame:
    """Low and High beyond median -/+ one population deviation of the finite values, else Normal;
    values that aren't finite are High."""
    stats = lids.filter(_finite("lid")).agg(F.percentile("lid", 0.5).alias("_m"), F.stddev_pop("lid").alias("_s"))
    kind = F.when(~_finite("lid"), "High").when(F.col("lid") > F.col("_m") + F.col("_s"), "High").when(F.col("lid") < F.col("_m") - F.col("_s"), "Low").otherwise("Normal")
    return lids.join(F.broadcast(stats)).select("query_id", "lid", kind.alias("category"))  # stats is one row


def _mu(neighbours: DataFrame) -> DataFrame:
    """Ratio of the second to the first neighbour's distance, one or more and finite."""
    d = neighbours.filter("rank <= 2").groupBy("query_id").agg(F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("_a"), F.min(F.when(F.col("rank") == 2, F.col("distance"))).alias("_b"))
    return d.filter("_a > 0 AND _b IS NOT NULL").select("query_id", (F.col("_b") / F.col("_a")).alias("mu")).filter("mu >= 1")


def two_nn(neighbours: DataFrame, discard: float = 0.1) -> DataFrame:
    """TwoNN dimension: slope through the origin of -ln(1 - F) on ln(mu), F = i / n, without the
    largest ``discard`` of the ratios, F from 0.9999 and mu under 1.0001."""
    used = ranked(_mu(neighbours), "mu", "query_id", "_i", "_n").filter((F.col("_i") <= F.floor(F.col("_n") * (1 - discard))) & (F.col("_i") / F.col("_n") < 0.9999) & (F.col("mu") >= 1.0001))
    x, y = F.log("mu"), -F.log(1 - F.col("_i") / F.col("_n"))
    return used.agg(F.count("*").alias("n_used"), _round(F.sum(x * y) / F.sum(x * x)).alias("dimension"))


def two_nn_interval(neighbours: DataFrame) -> DataFrame:
    """Likelihood TwoNN n / sum(ln mu) with its standard error and 95 % interval from 0 up."""
    x = F.log("mu")
    got = _mu(neighbours).agg(F.count("*").alias("n"), (F.count("*") / F.sum(x)).alias("_d"))
    se = F.col("_d") / F.sqrt("n")
    return got.select("n", _round(F.col("_d")).alias("dimension"), _round(se).alias("error"), _round(F.greatest(F.lit(0.0), F.col("_d") - 1.96 * se)).alias("low"), _round(F.col("_d") + 1.96 * se).alias("high"))


def occurrences(ids: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    """(id, n): how often each row is among the k nearest of a query; rows never so have 0."""
    n = neighbours.filter(F.col("rank") <= k).groupBy("doc_id").agg(F.count("*").alias("_c"))
    return ids.join(n, ids["id"] == n["doc_id"], "left").select("id", F.coalesce("_c", F.lit(0)).alias("n"))


def count_spread(counts: DataFrame, column: str = "n") -> DataFrame:
    """Most, 99th percentile by index, skewness, Gini and share above zero of one count a row.

    The counts are aggregated to one row per value before they are ranked, and ranks of equal
    values are taken together, so no task sorts the rows.
    """
    c = counts.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    s = c.select("v", "m", upto.alias("upto"), F.sum("m").over(W.partitionBy(F.lit(0))).alias("n"), (F.sum(F.col("v") * F.col("m")).over(W.partitionBy(F.lit(0))) / F.sum("m").over(W.partitionBy(F.lit(0)))).alias("mean"))
    rank_sum = F.col("m") * (F.col("upto") - F.col("m")) + F.col("m") * (F.col("m") + 1) / 2
    d = F.col("v") - F.col("mean")
    two, three = F.sum(F.col("m") * d * d) / F.max("n"), F.sum(F.col("m") * d * d * d) / F.max("n")
    p99 = F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.99), F.col("v")))
    g = 2 * F.sum(F.col("v") * rank_sum) / (F.max("n") * F.sum(F.col("v") * F.col("m"))) - (F.max("n") + 1) / F.max("n")
    return s.agg(
        F.max("n").alias("n"), F.max("v").alias("most"), F.coalesce(p99, F.max("v")).alias("p99"), _round(F.when(two > 0, three / F.pow(two, 1.5)).otherwise(0.0)).alias("skew"),
        _round(F.when(F.max("v") > 0, g).otherwise(0.0)).alias("gini"), _round(F.sum(F.when(F.col("v") > 0, F.col("m")).otherwise(0)) / F.max("n")).alias("nonzero"),
    )


def hubness(ids: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    return count_spread(occurrences(ids, neighbours, k))


def dispersion(vectors: DataFrame) -> DataFrame:
    """Population variance of each coordinate, added up, largest, and the effective dimension
    1 / sum(w^2) of their shares w."""
    each = vectors.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return each.agg(F.count("*").alias("n_dimensions"), _round(F.sum("v")).alias("total"), _round(F.max("v")).alias("largest"), _round(F.sum("v") * F.sum("v") / F.sum(F.col("v") * F.col("v"))).alias("effective"))


def duplicate_fraction(vectors: DataFrame) -> DataFrame:
    """1 - distinct vectors / vectors; vectors meet by a hash of 128 bits and 8 bytes a row."""
    n = vectors.select(F.md5(F.to_json("vector")).alias("h"))
    got = n.groupBy("h").count().agg(F.sum("count").alias("n"), F.count("*").alias("n_distinct"))
    return got.select("n", "n_distinct", _round(1 - F.col("n_distinct") / F.col("n")).alias("duplicate_fraction"))


def neighbour_gaps(neighbours: DataFrame, k: int = 10) -> DataFrame:
    """Nearest distance, gap and ratio to the second, and spread to the k-th, of each query."""
    at = lambda r: F.min(F.when(F.col("rank") == r, F.col("distance")))
    got = neighbours.filter(F.col("rank") <= k).groupBy("query_id").agg(at(1).alias("nearest"), at(2).alias("_b"), F.max("distance").alias("_k"))
    return got.select("query_id", _round(F.col("nearest")).alias("nearest"), _round(F.col("_b") - F.col("nearest")).alias("gap"), _round(F.when(F.col("nearest") > 0, F.col("_b") / F.col("nearest"))).alias("ratio"), _round(F.col("_k") - F.col("nearest")).alias("spread"))


def relative_contrast(distances: DataFrame) -> DataFrame:
    """Mean distance to all rows over the distance to the nearest, of each query.

    ``distances`` is (query_id, total, n, nearest), the sums that ``distance_sums`` makes.
    """
    return distances.select("query_id", _round(F.when(F.col("nearest") > 0, F.col("total") / F.col("n") / F.col("nearest"))).alias("contrast"))


def distance_sums(base: VectorTable, queries: VectorTable, nearest: DataFrame) -> DataFrame:
    """(query_id, total, n, nearest): L2 distances from each stated query to all other rows, added up
    in the tasks a tile of rows and queries at a time, and that to the nearest (rank 1 of ``nearest``)."""
    spark = base.df.sparkSession
    parts = spark.createDataFrame([], "query_id long, total double, n long")
    for ids, q in knn._blocks(queries.rows, base.dimension() or 0):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):  # noqa: ANN001, ANN202
            ids, q = shared.value
            total, n = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for b in batches:
                rows, all_x = b.column("id").to_numpy(), knn._matrix(b.column("vector")) if b.num_rows else None
                for i in range(0, len(rows), knn.TILE_ROWS):
                    x = all_x[i : i + knn.TILE_ROWS].astype(np.float64)
                    for j in range(0, len(ids), knn.TILE_QUERIES):
                        part = slice(j, j + knn.TILE_QUERIES)
                        other = ids[part, None] != rows[None, i : i + knn.TILE_ROWS]
                        d = D.kernel("l2", q[part], x)
                        which, at = np.nonzero(d <= 1e-4 * np.sqrt((x * x).sum(axis=1))[None, :])  # digits are lost there
                        d[which, at] = knn._from_differences("l2", q[part], x, d, which, at)
                        total[part] += (d * other).sum(axis=1)
                        n[part] += other.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(n)], names=["query_id", "total", "n"])

        parts = parts.union(base.rows.select("id", "vector").mapInArrow(run, "query_id long, total double, n long"))
    sums = parts.groupBy("query_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.join(nearest.filter("rank = 1").select("query_id", F.col("distance").alias("nearest")), "query_id")


def sizes(parts: DataFrame, n: int) -> DataFrame:
    """(part, n) rows of each of ``n`` parts, empty ones too."""
    every = parts.sparkSession.range(n).select(F.col("id").alias("part"))
    got = parts.groupBy("part").agg(F.count("*").alias("_c"))
    return every.join(got, "part", "left").select("part", F.coalesce("_c", F.lit(0)).alias("n"))


def density(neighbours: DataFrame, k: int = 10, least: int = 8, most: int = 32) -> DataFrame:
    """Local density 1 / (mean distance + 0.1) of each query, and the edge budget it gets: from
    ``least`` to ``most`` in proportion between the smallest and the largest density."""
    d = neighbours.filter(F.col("rank") <= k).groupBy("query_id").agg((1 / (F.avg("distance") + 0.1)).alias("density"))
    ends = d.agg(F.min("density").alias("_lo"), F.max("density").alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("density") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return d.join(F.broadcast(ends)).select("query_id", _round(F.col("density")).alias("density"), F.floor(F.lit(least) + share * (most - least)).cast("int").alias("edges"))  # ends is one row


def marchenko_pastur_edge(n: int, dimensions: int, variance: float = 1.0) -> float:
    """Upper edge of the spectrum of a random covariance matrix."""
    return variance * (1 + math.sqrt(dimensions / n)) ** 2


def spectral_outliers(vectors: DataFrame) -> tuple[int, float]:
    """Eigenvalues of the covariance above the edge that noise of the mean variance would have.

    The covariance is summed in the tasks; only its dimensions squared reach the driver.
    """
    rows = vectors.select("vector")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "p": [(x.T @ x).ravel().tolist()]})

    parts = rows.mapInPandas(run, "n long, s array<double>, p array<double>")
    add = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda z: z[c])
    total = parts.select(F.sum("n").alias("n")).first()[0] or 0
    if not total:
        return 0, 0.0
    s = np.array(parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(add("x")).first()[0])
    p = np.array(parts.select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(add("x")).first()[0]).reshape(len(s), len(s))
    cov = p / total - np.outer(s, s) / total**2
    edge = marchenko_pastur_edge(total, len(s), float(np.trace(cov) / len(s)))
    return int((np.linalg.eigvalsh(cov) > edge).sum()), edge
