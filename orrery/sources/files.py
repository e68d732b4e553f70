"""Vector files: JSON lines and small binary formats.

Binary ones are read through Spark's binaryFile source, so any store it reads will do. A file is
one record there; sets too large for that belong in Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import VectorError
from ..functions import distance as D


def read_json_vectors(spark: SparkSession, path: str, unit: bool = True) -> DataFrame:
    """(vec_id, embedding) from lines {"id": .., "vec": [..]}; blank lines are skipped."""
    rows = spark.read.schema("id long, vec array<float>").json(path).filter("id IS NOT NULL OR vec IS NOT NULL")
    v = D.normalise(F.col("vec")).cast("array<float>") if unit else F.col("vec")
    return rows.select(F.col("id").alias("vec_id"), v.alias("embedding"))


def write_json_vectors(df: DataFrame, path: str) -> None:
    df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).write.mode("overwrite").json(path)


def _binary(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for content in pdf["content"]:
                yield parse(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _header(data: bytes, magic: bytes, numbers: int) -> list[int]:
    if data[:4] != magic or len(data) < 4 + 4 * numbers:
        raise VectorError(f"this isn't a {magic.decode()} file")
    return np.frombuffer(data, "<u4", numbers, 4).astype(int).tolist()


def parse_vec1(data: bytes) -> pd.DataFrame:
    n, dim = _header(data, b"VEC1", 2)
    x = np.frombuffer(data, "<f4", n * dim, 12).reshape(n, dim)
    return pd.DataFrame({"vec_id": np.arange(n, dtype=np.int64), "embedding": list(x)})


def parse_nbr1(data: bytes) -> pd.DataFrame:
    n, k = _header(data, b"NBR1", 2)
    ids = np.frombuffer(data, "<i4", n * k, 12).astype(np.int64)
    return pd.DataFrame({"query_id": np.repeat(np.arange(n, dtype=np.int64), k), "doc_id": ids, "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), n)})


def parse_lbl1(data: bytes) -> pd.DataFrame:
    (n,) = _header(data, b"LBL1", 1)
    return pd.DataFrame({"vec_id": np.arange(n, dtype=np.int64), "label": np.frombuffer(data, "<u4", n, 8).astype(np.int64)})


def parse_spv1(data: bytes) -> pd.DataFrame:
    (n,) = _header(data, b"SPV1", 1)
    m = int(np.frombuffer(data, "<u8", 1, 8)[0])
    edge = np.frombuffer(data, "<u8", n + 1, 16).astype(np.int64)
    at = 16 + 8 * (n + 1)
    terms, weights = np.frombuffer(data, "<u4", m, at), np.frombuffer(data, "<f4", m, at + 4 * m)
    return pd.DataFrame({"doc_id": np.repeat(np.arange(n, dtype=np.int64), np.diff(edge)), "term": terms.astype(np.int64), "weight": weights.astype(np.float64)})


def read_vec1(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_vec1, "vec_id long, embedding array<float>")


def read_nbr1(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_nbr1, "query_id long, doc_id long, rank int")


def read_lbl1(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_lbl1, "vec_id long, label long")


def read_spv1(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_spv1, "doc_id long, term long, weight double")
