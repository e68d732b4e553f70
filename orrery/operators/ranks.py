"""Ranks over a whole table without a task that sorts all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 64


def ranked(df: DataFrame, column: str, tie: str, into: str = "rank", total: str = "n") -> DataFrame:
    """``df`` with the rank of each row from 1 by ``column``, then ``tie``, and the number of rows.

    Approximate quantiles, ``SLICES`` numbers, cut the column into slices; a row's rank is the rows
    of the slices before its own and its place inside it.
    """
    cuts = sorted(set(df.approxQuantile(column, [i / SLICES for i in range(1, SLICES)], 0.005)))
    slice_ = reduce(lambda a, b: a + b, [(F.col(column) >= c).cast("int") for c in cuts], F.lit(0))
    cut = df.withColumn("_slice", slice_)
    sizes = cut.groupBy("_slice").agg(F.count("*").alias("_m"))
    every = W.partitionBy(F.lit(0))  # one row a slice
    before = sizes.select("_slice", (F.sum("_m").over(every.orderBy("_slice")) - F.col("_m")).alias("_before"), F.sum("_m").over(every).alias(total))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(column, tie))
    return cut.withColumn("_inside", inside).join(F.broadcast(before), "_slice").withColumn(into, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before")
